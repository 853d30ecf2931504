"""One tree out of two."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rcc5
from ..staging import stage
from .theory import Theory, compare, equivalents


def cosuperiors(estimates: DataFrame, theory: Theory) -> DataFrame:
    """(nid, cos, relation): the would-be parent of each node in the other tree.

    The estimate, lifted to an accepted row; when the two are each other's estimate, that
    row's superior.
    """
    info = theory.nodes.select("nid", "accepted", "sup", F.col("relation").alias("edge"))
    est1 = estimates.join(info.toDF("est", "_acc", "_sup", "_edge"), "est")
    lifted = est1.select(
        "nid", F.when(F.col("_acc"), F.col("est")).otherwise(F.col("_sup")).alias("v"),
        F.when(F.col("_acc"), F.col("relation")).otherwise(rcc5.compose(F.col("relation"), F.col("_edge"))).alias("rel"))
    back = estimates.select(F.col("nid").alias("v"), F.col("est").alias("_back"))
    j = lifted.join(back, "v", "left").join(info.select("nid", "sup", "edge").toDF("v", "_vsup", "_vedge"), "v")
    mutual = F.coalesce(F.col("_back") == F.col("nid"), F.lit(False))
    return j.select(
        "nid", F.when(mutual, F.col("_vsup")).otherwise(F.col("v")).alias("cos"),
        F.when(mutual, rcc5.compose(F.col("rel"), F.col("_vedge"))).otherwise(F.col("rel")).alias("relation")
    ).filter("cos is not null")


def suppressed(equivalents_: DataFrame, theory: Theory) -> DataFrame:
    """(nid, est): B rows that an A row replaces."""
    b = theory.nodes.filter("side = 'B'").select("nid")
    return equivalents_.join(b, "nid", "left_semi")


def merged_superiors(theory: Theory, estimates: DataFrame) -> DataFrame:
    """(nid, side, sup, relation): the links of the merged tree.

    Of a row's own superior and its would-be parent in the other tree the smaller is taken;
    a replaced B row stands for its A equivalent.
    """
    gone = stage(suppressed(equivalents(estimates, theory), theory), "suppressed")
    own = theory.nodes.select("nid", "side", "sup", F.col("relation").alias("own_rel"))
    own = own.join(gone.select("nid"), "nid", "left_anti")
    cos = cosuperiors(estimates, theory).select("nid", "cos", F.col("relation").alias("cos_rel"))
    both = stage(own.join(cos, "nid", "left"), "superiors")
    pairs = both.filter("sup is not null and cos is not null").select(F.col("sup").alias("u"), F.col("cos").alias("v"))
    rel = compare(pairs.distinct(), theory).select(F.col("u").alias("sup"), F.col("v").alias("cos"), F.col("relation").alias("_r"))
    open_ = both.filter("sup is null or cos is null").withColumn("_r", F.lit(None).cast("int"))
    j = both.filter("sup is not null and cos is not null").join(rel, ["sup", "cos"], "left").unionByName(open_)
    take_cos = F.coalesce(F.col("_r").isin(rcc5.GT, rcc5.GE), F.lit(False)) | F.col("sup").isNull()
    j = j.select("nid", "side", F.when(take_cos, F.col("cos")).otherwise(F.col("sup")).alias("_sup"),
                 F.when(take_cos, F.col("cos_rel")).otherwise(F.col("own_rel")).alias("relation"))
    swap = gone.select(F.col("nid").alias("_sup"), F.col("est").alias("_eq"))
    # replacing a row by its equal leaves the relation as it is
    return j.join(swap, "_sup", "left").select("nid", "side", F.coalesce("_eq", "_sup").alias("sup"), "relation")


def merge_trees(theory: Theory, estimates: DataFrame) -> DataFrame:
    """Rows of the merged tree with keys `A!id` / `B!id`."""
    links = merged_superiors(theory, estimates)
    key = theory.nodes.select("nid", F.concat_ws("!", "side", "taxonID").alias("key"), "canonicalName", "rank", "accepted")
    sup = key.select(F.col("nid").alias("sup"), F.col("key").alias("superior"))
    return links.join(key, "nid").join(sup, "sup", "left").select(
        "key", "canonicalName", "rank", "accepted", "superior", rcc5.symbol(F.col("relation")).alias("relation"))
