"""What happened to a name or a concept between the two checklists.

Each function takes rows (u, v, relation, homotypic) with NULL for an absent side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rcc5
from ..functions.ranks import rank_number
from .report import join_ends
from .tree import prefixed

# The word for a relation when the two names share a type, and when not.
CONCEPT_WORDS = {
    rcc5.EQ: ("congruent", "congruent"), rcc5.LT: ("expand", "lump"),
    rcc5.GT: ("contract", "split"), rcc5.OVERLAP: ("contract+expand", "split+lump"),
}


def homotypic_pairs(relations: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Add ``homotypic``: the two records are members of one exemplar."""
    e = exemplars.select("nid", "exemplar_id")
    both = F.col("u").isNotNull() & F.col("v").isNotNull()
    out = relations.filter(both).join(e.toDF("u", "_eu"), "u", "left").join(e.toDF("v", "_ev"), "v", "left")
    # a row with one end only has nothing to compare, and would gather with its like in one task
    out = out.unionByName(relations.filter(~both), allowMissingColumns=True)
    return out.select(*relations.columns, F.coalesce(F.col("_eu") == F.col("_ev"), F.lit(False)).alias("homotypic"))


def concept_change(u: Column, v: Column, relation: Column, homotypic: Column) -> Column:
    out = F.lit("should not happen")
    for code, (same, other) in CONCEPT_WORDS.items():
        out = F.when(relation == code, F.when(homotypic, same).otherwise(other)).otherwise(out)
    return F.when(u.isNull(), "new").when(v.isNull(), "gone").otherwise(out)


def _ops(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, word) for test, word in tests]))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def name_change(p: Column, q: Column, p_rank: Column, q_rank: Column) -> Column:
    """Parts of the name that differ, as an array of words."""
    return _ops((_differs(p["genus"], q["genus"]), "change genus"),
                (_differs(p["epithet"], q["epithet"]), "change epithet"),
                (_differs(p["token"], q["token"]), "change author"),
                (_differs(p["year"], q["year"]), "change year"),
                (_differs(p_rank, q_rank), "change rank"))


def rank_change(u_rank: Column, v_rank: Column, u_accepted: Column, v_accepted: Column) -> Column:
    a, b = rank_number(u_rank), rank_number(v_rank)
    return _ops((a < b, "promoted"), (a > b, "demoted"),
                (~u_accepted & v_accepted, "accepted"), (u_accepted & ~v_accepted, "synonymized"))


def name_distance(p: Column, q: Column) -> Column:
    """How many of genus, epithet, author token and year differ."""
    return sum((_differs(p[f], q[f]).cast("int") for f in ("epithet", "token", "year")),
               _differs(p["genus"], q["genus"]).cast("int"))


def describe_changes(relations: DataFrame, exemplars: DataFrame, nodes: DataFrame) -> DataFrame:
    """The relations with concept, name and rank changes."""
    have = ("nid", "taxonID", "parts", "rank", "accepted")
    ends = {p: prefixed(nodes, f"{p}_", *have).withColumnRenamed(f"{p}_nid", p) for p in "uv"}
    out = join_ends(homotypic_pairs(relations, exemplars), ends["u"], ends["v"])
    p, q = F.col("u_parts"), F.col("v_parts")
    both = F.col("u").isNotNull() & F.col("v").isNotNull()
    none = F.array().cast("array<string>")
    return out.select(
        F.col("u_taxonID").alias("a_id"), F.col("v_taxonID").alias("b_id"), "relation", "homotypic",
        concept_change(F.col("u"), F.col("v"), F.col("relation"), F.col("homotypic")).alias("concept_change"),
        F.when(F.col("homotypic"), name_change(p, q, F.col("u_rank"), F.col("v_rank"))).otherwise(none).alias("name_change"),
        F.when(both, rank_change(F.col("u_rank"), F.col("v_rank"), F.col("u_accepted"), F.col("v_accepted"))).otherwise(none).alias("rank_change"),
        F.when(both, name_distance(p, q)).alias("name_distance"))
