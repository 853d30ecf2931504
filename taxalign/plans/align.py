"""Runs from two checklists to exemplars, theory and report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.names import TOKEN, TOKEN_SHORT
from ..operators import match as M, merge, names, report, theory as T, tree
from ..staging import stage


@dataclass(frozen=True)
class Alignment:
    """Two checklists and what follows from them; each table is computed once, on demand.

    ``version`` 8 compares names and places in a tree more strictly, takes author names of
    two letters, and ties declared objective synonyms.
    """

    a: DataFrame
    b: DataFrame
    motion: str = "family"
    given_exemplars: DataFrame | None = None
    version: int = 7

    def __post_init__(self) -> None:
        if self.version not in (7, 8):
            raise ValueError("version is 7 or 8")

    @cached_property
    def rows(self) -> DataFrame:
        # stored first: row order must not change between the passes that read it; dealt out, as a small
        # file may hold a whole checklist, and parsed here, as links read the table twice
        rows = tree.workspace_rows(self.a, self.b).repartition("nid", "taxonID")
        return stage(names.parse_names(rows, TOKEN if self.version == 7 else TOKEN_SHORT), "rows")

    @cached_property
    def nodes(self) -> DataFrame:
        return tree.build_forest(self.rows)

    @cached_property
    def _records(self) -> DataFrame:
        return stage(M.match_records(self.nodes), "records")

    @cached_property
    def ties(self) -> DataFrame:
        ties = M.homotypic_within(self._records) if self.version == 7 else M.homotypic_within_v8(self._records, self.nodes)
        return stage(ties, "ties")

    @cached_property
    def records(self) -> DataFrame:
        return stage(M.with_specimens(self._records, self.ties), "specimens")

    @cached_property
    def partner_groups(self) -> DataFrame:
        return stage(M.partner_groups(self.records, self.motion, self.version), "groups")

    @cached_property
    def partner_counts(self) -> DataFrame:
        return stage(M.partner_counts(self.partner_groups), "counts")

    @cached_property
    def best(self) -> DataFrame:
        return stage(M.best_matches(self.records, self.motion, self.version), "best")

    @cached_property
    def decisions(self) -> DataFrame:
        return stage(M.match_decisions(self.best, self.nodes, self.ties, self.version), "decisions")

    @cached_property
    def exemplars(self) -> DataFrame:
        if self.given_exemplars is not None:
            return M.read_exemplars(self.given_exemplars, self.nodes)
        return M.exemplars_from(self.records, M.mutual_best(self.decisions), self.nodes)

    @cached_property
    def theory(self) -> T.Theory:
        return T.theorize(self.nodes, self.exemplars)

    @cached_property
    def estimates(self) -> DataFrame:
        return stage(T.estimates(self.theory), "estimates")

    @cached_property
    def relations(self) -> DataFrame:
        return report.pair_relations(self.theory, self.estimates)

    @cached_property
    def merged(self) -> DataFrame:
        return merge.merge_trees(self.theory, self.estimates)

    @cached_property
    def report(self) -> DataFrame:
        return report.alignment(self.theory, self.estimates, self.relations)
