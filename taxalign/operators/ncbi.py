"""A taxonomy dump as a checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .table import stable_hash

# Columns of the result, and ranks that say nothing.
COLUMNS = ("taxonID managed_id parentNameUsageID taxonRank acceptedNameUsageID scientificName "
           "canonicalName taxonomicStatus nomenclaturalStatus").split()
NO_RANK = ("clade", "no rank")


def clean_rank(rank: Column) -> Column:
    return F.when(~rank.isin(*NO_RANK), rank)


def _order(names: DataFrame) -> Column:
    """Place of a name in its file, where the reader has given one."""
    return F.col("_ord") if "_ord" in names.columns else F.col("name_txt")


def dedupe_names(names: DataFrame) -> DataFrame:
    """One row per taxon and (name, class, unique name), the first in the file.

    Adds ``spin``, a short hash of these.  Different names of a taxon that share a hash are
    numbered by value, the second with ``-2`` after it.
    """
    spin = stable_hash("name_txt", "name_class", "unique_name")
    values = ["name_txt", "name_class", "unique_name"]
    first = names.groupBy("tax_id", *values).agg(F.min(_order(names)).alias("_ord")).withColumn("spin", spin)
    clash = F.row_number().over(Window.partitionBy("tax_id", "spin").orderBy(*values))  # names of one hash: a few at most
    return first.withColumn("_n", clash).withColumn(
        "spin", F.when(F.col("_n") > 1, F.concat_ws("-", "spin", "_n")).otherwise(F.col("spin"))).drop("_n")


def collate_names(names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synonyms, scientific names, authorities that extend them).

    Of several scientific names or extending authorities the last in the file counts.
    """
    last = F.max_by("name_txt", _order(names))
    sci = names.filter("name_class = 'scientific name'").groupBy("tax_id").agg(last.alias("sci"))
    rest = names.filter("name_class <> 'scientific name'").join(sci, "tax_id", "left")
    extends = (F.col("name_class") == "authority") & F.col("name_txt").startswith(F.col("sci"))
    extends = F.coalesce(extends, F.lit(False))
    authorities = rest.filter(extends).groupBy("tax_id").agg(last.alias("authority"))
    synonyms = rest.filter(~extends).select("tax_id", "name_txt", "name_class", "spin")
    return synonyms, sci, authorities


def ncbi_to_dwc(nodes: DataFrame, names: DataFrame, merged: DataFrame, compat: bool = False) -> DataFrame:
    """Accepted nodes, synonyms and merged ids as one checklist.

    The name goes to canonicalName and name with authority to scientificName; ``compat``
    exchanges the two for accepted rows.
    """
    synonyms, sci, authorities = collate_names(dedupe_names(names))
    managed = lambda c: F.concat(F.lit("ncbi:"), c)

    def rows(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*[values.get(c, F.lit(None)).cast("string").alias(c) for c in COLUMNS])

    full, bare = F.col("authority"), F.col("sci")
    if compat:
        full, bare = bare, full
    accepted = rows(
        nodes.join(sci, "tax_id", "left").join(authorities, "tax_id", "left"),
        taxonID=F.col("tax_id"), managed_id=managed("tax_id"), parentNameUsageID=F.col("parent_tax_id"),
        taxonRank=clean_rank(F.col("rank")), scientificName=full, canonicalName=bare, taxonomicStatus=F.lit("accepted"))
    authority = F.col("name_class") == "authority"
    other = rows(
        synonyms, taxonID=F.concat_ws(".", "tax_id", "spin"), acceptedNameUsageID=F.col("tax_id"),
        scientificName=F.when(authority, F.col("name_txt")), canonicalName=F.when(~authority, F.col("name_txt")),
        taxonomicStatus=F.lit("synonym"), nomenclaturalStatus=F.when(F.col("name_class") != "synonym", F.col("name_class")))
    old = rows(
        merged, taxonID=F.col("old_tax_id"), managed_id=managed("old_tax_id"), acceptedNameUsageID=F.col("new_tax_id"),
        canonicalName=F.concat(F.lit("deprecated taxon that had taxid "), "old_tax_id"),
        taxonomicStatus=F.lit("synonym"), nomenclaturalStatus=F.lit("merged id"))
    return accepted.unionByName(other).unionByName(old)
