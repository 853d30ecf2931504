"""The alignment report: one row per pair of species that share an exemplar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rcc5
from ..staging import stage
from .merge import suppressed
from .numbering import number_within, positions
from .theory import Theory, blocks, compare, equivalents, intersecting_species

# Column headings and phrases of the report.
HEADINGS = {
    "a_id": "A concept taxonID", "a_name": "A concept name", "rcc5": "RCC5",
    "b_id": "B concept taxonID", "b_name": "B concept name",
    "both": "in both A and B concepts", "only_a": "in A concept but not in B concept",
    "only_b": "in B concept but not in A concept",
}
PHRASES = {rcc5.EQ: "is congruent with", rcc5.LT: "is contained in", rcc5.GT: "contains", rcc5.OVERLAP: "overlaps"}


def describe(nodes: DataFrame) -> DataFrame:
    """(nid, taxonID, name): canonical or scientific name, `*` on synonyms."""
    name = F.when(F.col("canonicalName") != "", F.col("canonicalName")).otherwise(F.col("scientificName"))
    return nodes.select("nid", "taxonID", F.concat(name, F.when(F.col("accepted"), "").otherwise("*")).alias("name"))


def relation_field(relation: Column) -> Column:
    """Symbol as written to a sheet: one that starts with `=` gets a leading quote."""
    text = rcc5.symbol(relation)
    return F.when(text.startswith("="), F.concat(F.lit("'"), text)).otherwise(text)


def relation_comment(relation: Column) -> Column:
    out = F.lit("")
    for code, phrase in PHRASES.items():
        out = F.when(relation == code, phrase).otherwise(out)
    return out


def species_pairs(theory: Theory, estimates: DataFrame) -> DataFrame:
    """(u, v): pairs of A and B species, with lone species on one side only."""
    gone = suppressed(equivalents(estimates, theory), theory).select("nid")
    walked = theory.nodes.filter("accepted and rank = 'species'").select("nid", "side").join(gone, "nid", "left_anti")
    partners = intersecting_species(theory).select("nid", "partner")
    seen = walked.join(partners.hint("merge"), "nid", "left")
    a = F.col("side") == "A"
    return seen.select(F.when(a, F.col("nid")).otherwise(F.col("partner")).alias("u"),
                       F.when(a, F.col("partner")).otherwise(F.col("nid")).alias("v")).distinct()


def pair_relations(theory: Theory, estimates: DataFrame) -> DataFrame:
    """(u, v, relation) of the report; the relation of a lone species is NULL."""
    pairs = stage(species_pairs(theory, estimates), "species-pairs")
    paired = compare(pairs.filter("u is not null and v is not null"), theory)
    return stage(paired.unionByName(
        pairs.filter("u is null or v is null").withColumn("relation", F.lit(None).cast("int"))), "relations")


def join_ends(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` joined on u and ``right`` on v.

    Rows with one end only go past the other join: NULL keys would gather in one task.
    """
    u, v = F.col("u").isNotNull(), F.col("v").isNotNull()
    return (pairs.filter(u & v).join(left, "u").join(right, "v")
            .unionByName(pairs.filter(u & ~v).join(left, "u"), allowMissingColumns=True)
            .unionByName(pairs.filter(~u & v).join(right, "v"), allowMissingColumns=True))


def _ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("nid")).filter("nid is not null").distinct()


def _shared(pairs: DataFrame, theory: Theory) -> DataFrame:
    """(u, v, exemplar_id): the exemplars that both concepts of a pair hold.

    Species of A and of B meet in their exemplars, so rows grow with these: a lump of 400
    species gives 400 times their own exemplars, not 400 times its own.
    """
    paired = pairs.filter("u is not null and v is not null").select("u", "v")
    held = stage(blocks(theory.members, _ends_of(paired)), "held")
    a = held.filter("side = 'A'").select(F.col("nid").alias("u"), "exemplar_id")
    b = held.filter("side = 'B'").select(F.col("nid").alias("v"), "exemplar_id")
    return a.join(b, "exemplar_id").join(paired, ["u", "v"], "left_semi")


def exemplar_numbers(theory: Theory) -> DataFrame:
    """(exemplar_id, number): exemplars numbered from 0 as a walk of A meets their representatives."""
    pre = theory.nodes.select(F.col("nid").alias("rep_a"), "pre")
    placed = positions(theory.lookup.join(pre, "rep_a").select("exemplar_id", "pre"), ["pre", "exemplar_id"], "_n")
    return placed.select("exemplar_id", (F.col("_n") - 1).alias("number"))


def _as_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): the numbers of each key as ranges without a gap."""
    numbered = number_within(rows, keys, ["number"], "_n")
    return numbered.groupBy(*keys, (F.col("number") - F.col("_n")).alias("_island")).agg(
        F.min("number").alias("lo"), F.max("number").alias("hi")).drop("_island")


def concept_ranges(concepts: DataFrame, theory: Theory, numbers: DataFrame) -> DataFrame:
    """(nid, lo, hi): the exemplars of each concept (nid) as ranges of numbers; one range where the trees agree."""
    return _as_ranges(blocks(theory.members, concepts).join(numbers, "exemplar_id").select("nid", "number"), ["nid"])


def shared_ranges(pairs: DataFrame, theory: Theory, numbers: DataFrame) -> DataFrame:
    """(u, v, lo, hi): what both concepts of a pair hold, as ranges.

    What only one holds is its own ranges less these, so the three parts of every pair
    follow from two tables that grow with the exemplars.
    """
    return _as_ranges(_shared(pairs, theory).join(numbers, "exemplar_id").select("u", "v", "number"), ["u", "v"])


def alignment_counts(theory: Theory, relations: DataFrame) -> DataFrame:
    """The report with numbers of exemplars in place of their lists; rows are not sorted.

    Numbers are NULL for a species without a partner.
    """
    size = theory.nodes.select("nid", "block_size")
    who = describe(theory.nodes).join(size, "nid")
    both = _shared(relations, theory).groupBy("u", "v").agg(F.count("*").alias("_both"))
    paired = relations.filter("u is not null and v is not null").join(both, ["u", "v"], "left").withColumn("_both", F.coalesce("_both", F.lit(0)))
    rows = paired.unionByName(relations.filter("u is null or v is null"), allowMissingColumns=True)
    rows = join_ends(rows, who.toDF("u", "a_id", "a_name", "_n_a"), who.toDF("v", "b_id", "b_name", "_n_b"))
    rows = rows.withColumns({"rcc5": relation_field(F.col("relation")), "both": F.col("_both"),
                             "only_a": F.col("_n_a") - F.col("_both"), "only_b": F.col("_n_b") - F.col("_both")})
    cells = ("both", "only_a", "only_b")
    return rows.select(*[(F.col(c) if c in cells else F.coalesce(c, F.lit(""))).alias(h) for c, h in HEADINGS.items()])


def venn_rows(pairs: DataFrame, theory: Theory) -> DataFrame:
    """(u, v, exemplar_id, epithet, part): the exemplars of each pair, one per row.

    As the report format asks for; ``concept_ranges`` and ``shared_ranges`` say the same in
    less room where concepts are large.
    """
    paired = pairs.filter("u is not null and v is not null").select("u", "v")
    held = stage(blocks(theory.members, _ends_of(paired)).select("nid", "exemplar_id"), "held")
    sides = (paired.join(held.withColumnRenamed("nid", "u"), "u").withColumn("bit", F.lit(1))
             .unionByName(paired.join(held.withColumnRenamed("nid", "v"), "v").withColumn("bit", F.lit(2))))
    parts = sides.groupBy("u", "v", "exemplar_id").agg(F.sum("bit").alias("bits"))
    part = F.when(F.col("bits") == 3, "both").when(F.col("bits") == 1, "only_a").otherwise("only_b")
    return parts.join(theory.lookup.select("exemplar_id", "epithet"), "exemplar_id").select(
        "u", "v", "exemplar_id", "epithet", part.alias("part"))


def venn_columns(pairs: DataFrame, theory: Theory) -> DataFrame:
    """(u, v, both, only_a, only_b): the same as lists in text, by epithet and id.

    A cell is as long as the concept is large; ``venn_rows`` is the form for big concepts.
    """
    item = F.struct("epithet", "exemplar_id")

    def text(part: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("part") == part, item)))
        return F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["exemplar_id"], x["epithet"])), "; ")

    return venn_rows(pairs, theory).groupBy("u", "v").agg(*[text(p).alias(p) for p in ("both", "only_a", "only_b")])


def alignment(theory: Theory, estimates: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """The eight-column report, by A id and B id."""
    rel = pair_relations(theory, estimates) if relations is None else relations
    who = describe(theory.nodes)
    lists = venn_columns(rel, theory)
    rows = rel.filter("u is not null and v is not null").join(lists, ["u", "v"], "left").unionByName(
        rel.filter("u is null or v is null"), allowMissingColumns=True)
    rows = join_ends(rows, who.toDF("u", "a_id", "a_name"), who.toDF("v", "b_id", "b_name"))
    rows = rows.withColumn("rcc5", relation_field(F.col("relation")))
    return rows.select(*[F.coalesce(c, F.lit("")).alias(h) for c, h in HEADINGS.items()]).orderBy(
        HEADINGS["a_id"], HEADINGS["b_id"])


def relation_counts(relations: DataFrame, tag_a: str = "A", tag_b: str = "B") -> DataFrame:
    """Histogram of the comments of the report's rows; ``tag_a`` and ``tag_b`` are the checklists' names."""
    def alone(here: str, there: str) -> Column:
        return F.lit(f"in {here}; unknown relationship to {there}")

    lone = F.when(F.col("v").isNull(), alone(tag_a, tag_b)).otherwise(alone(tag_b, tag_a))
    comment = F.when(F.col("relation").isNull(), lone).otherwise(relation_comment(F.col("relation")))
    return relations.groupBy(comment.alias("comment")).agg(F.count("*").alias("n"))


def report_metrics() -> dict[str, Column]:
    """Observed metrics of relations (u, v, relation): rows, and how many have each relation.

    ``relations.observe(observation, *metrics)`` gathers them while the report is written.
    """
    out = {"rows": F.count("*"), "relations": F.count("relation"),
           "only in A": F.count_if(F.col("v").isNull()), "only in B": F.count_if(F.col("u").isNull())}
    return out | {rcc5.symbol_of(code): F.count_if(F.col("relation") == code) for code in range(1, 32)}
