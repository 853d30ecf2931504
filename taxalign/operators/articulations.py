"""Alignment as articulations between uniquely named taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rcc5
from ..functions.names import known
from .numbering import number_within


def base_name(canonical: Column, managed: Column, taxon_id: Column) -> Column:
    name = F.coalesce(known(canonical), known(managed), taxon_id)
    return F.replace(F.translate(name, " .", "__"), F.lit("__"), F.lit("_"))


def unique_names(nodes: DataFrame) -> DataFrame:
    """(nid, side, unique_name) of accepted taxa down to species; repeats are numbered in walk order."""
    rows = nodes.filter("path is not null and accepted and (species_nid is null or species_nid = nid)").select(
        "nid", "side", "path", base_name(F.col("canonicalName"), F.col("managed_id"), F.col("taxonID")).alias("base"))
    counts = rows.groupBy("side", "base").agg(F.count("*").alias("_total"))
    numbered = number_within(rows, ["side", "base"], ["path"], "_n").join(counts, ["side", "base"])
    return numbered.select("nid", "side", F.when(F.col("_total") > 1, F.concat_ws("_", "base", "_n")).otherwise(F.col("base")).alias("unique_name"))


def taxonomy_edges(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(side, parent, child) of the taxa above species."""
    parent = names.select(F.col("nid").alias("sup"), F.col("unique_name").alias("parent"))
    child = names.select("nid", "side", F.col("unique_name").alias("child"))
    real = nodes.filter("accepted and sup > 0").select("nid", "sup")
    above = nodes.filter("rank <> 'species'").select(F.col("nid").alias("sup"))
    return real.join(above, "sup", "left_semi").join(parent, "sup").join(child, "nid").select("side", "parent", "child")


def articulations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(a_name, relation, b_name) of related pairs; unions are listed in braces."""
    n = names.select("nid", "side", "unique_name")
    label = F.concat_ws(".", "side", "unique_name")
    out = (relations.filter("relation is not null")
           .join(n.select(F.col("nid").alias("u"), label.alias("a_name")), "u")
           .join(n.select(F.col("nid").alias("v"), label.alias("b_name")), "v"))
    listed = F.array_join(F.transform(rcc5.members(F.col("relation")), rcc5.symbol), " ")
    one = F.size(rcc5.members(F.col("relation"))) == 1
    return out.select("a_name", F.when(one, listed).otherwise(F.concat(F.lit("{"), listed, F.lit("}"))).alias("relation"), "b_name")
