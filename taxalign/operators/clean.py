"""Cleaning of a raw checklist; every rule but key minting is one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.names import SUBGENUS, SUBGENUS_AT_START
from ..staging import stage
from .numbering import number_within

# Headers that are renamed, and names of landmark codes.
HEADERS = {"taxonId": "taxonID", "Landmark": "landmark_status"}
LANDMARKS = {"1": "minimal", "2": "abbreviated", "3": "extended", "4": "full"}
# Replacements in a scientific name, applied in this order.
REPLACEMENTS = ((" and ", " & "), (",,", ","), ("  ", " "), (" *", " "))


def normalize_headers(df: DataFrame) -> DataFrame:
    def fixed(name: str) -> str:
        name = name.removeprefix("﻿").removeprefix("dwc:")
        return HEADERS.get(name, name)
    return df.toDF(*[fixed(c) for c in df.columns])


def fill_missing(df: DataFrame) -> DataFrame:
    """NULL strings become ''."""
    return df.select(*[F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
                       for f in df.schema.fields])


def drop_senior_synonyms(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("taxonomicStatus") != "senior synonym", F.lit(True)))


def _normalizes() -> Column:
    """Whether ``normalize_accepted`` changes a row."""
    linked = F.col("acceptedNameUsageID") != ""
    return linked & ((F.col("acceptedNameUsageID") == F.col("taxonID")) | (F.col("parentNameUsageID") != ""))


def normalize_accepted(df: DataFrame) -> DataFrame:
    """An accepted id equal to the row's own is cleared; else a synonym's parent is."""
    own = (F.col("acceptedNameUsageID") != "") & (F.col("acceptedNameUsageID") == F.col("taxonID"))
    synonym = (F.col("acceptedNameUsageID") != "") & ~own
    return df.withColumns({
        "acceptedNameUsageID": F.when(own, "").otherwise(F.col("acceptedNameUsageID")),
        "parentNameUsageID": F.when(synonym, "").otherwise(F.col("parentNameUsageID"))})


def status_conflicts(df: DataFrame) -> DataFrame:
    """Rows whose status disagrees with having an accepted id."""
    status = F.lower("taxonomicStatus")
    by_status = (status.startswith("accepted") | status.startswith("valid") | status.startswith("dubious")
                 | status.endswith("accepted"))
    by_link = (F.col("acceptedNameUsageID") == "") | (F.col("acceptedNameUsageID") == F.col("taxonID"))
    return df.filter(by_status != by_link).select("taxonID", "acceptedNameUsageID", "taxonomicStatus")


def recode_landmark(code: Column) -> Column:
    out = F.lit("")
    for number, word in LANDMARKS.items():
        out = F.when(F.trim(code) == number, word).otherwise(out)
    return out


def first_source(source: Column) -> Column:
    return F.substring_index(source, ",", 1)


def remove_subgenus(name: Column) -> Column:
    """`Genus (Genus) epithet` at the start -> `Genus epithet`."""
    return F.regexp_replace(name, SUBGENUS_AT_START, "$1 $2")


def tidy_authorship(author: Column) -> Column:
    text = F.trim(author)
    return F.when(text.endswith(")."), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _erase_subgenus(name: Column) -> Column:
    """The first parenthesised capitalised word between blanks."""
    found = F.regexp_extract(name, SUBGENUS, 0)
    at = F.instr(name, found)
    rest = F.substr(name, at + F.length(found))
    return F.when(found != "", F.concat(F.substring(name, F.lit(1), at - 1), F.lit(" "), rest)).otherwise(name)


def clean_names(df: DataFrame, compat: bool = False, changed: str | None = None) -> DataFrame:
    """Make scientificName = canonicalName + authorship and tidy all three.

    ``compat`` leaves authorship out of account.  The column ``changed``, if named, becomes
    whether a row was changed.
    """
    c = F.col
    given = F.trim("scientificNameAuthorship") if not compat else F.lit("")
    out = df.withColumns({"_s0": F.trim("scientificName"), "_c0": F.trim("canonicalName"), "_a": given})
    out = out.withColumns({"_s": _erase_subgenus(c("_s0")), "_c": _erase_subgenus(c("_c0"))})
    suffix = (c("_s") != "") & (c("_c") == "") & (c("_a") != "") & c("_s").endswith(c("_a"))
    prefix = (c("_s") != "") & (c("_a") == "") & (c("_c") != "") & c("_s").startswith(c("_c"))
    out = out.withColumns({
        "_s1": F.when(c("_s") != "", c("_s")).when((c("_c") != "") & (c("_a") != ""), F.concat_ws(" ", "_c", "_a")).otherwise(c("_c")),
        "_c1": F.when(suffix, F.trim(F.substring("_s", F.lit(1), F.length("_s") - F.length("_a")))).otherwise(c("_c")),
        "_a1": F.when(prefix, F.trim(F.substr("_s", F.length("_c") + 1))).otherwise(c("_a"))})
    text = c("_s1")
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    out = out.withColumn("_s2", text)
    ended = F.when(c("_s2").endswith(")."), F.substring("_s2", F.lit(1), F.length("_s2") - 1)).otherwise(c("_s2"))
    values = {"scientificName": remove_subgenus(F.replace(ended, F.lit(" ,"), F.lit(","))), "canonicalName": c("_c1")}
    if not compat:
        values["scientificNameAuthorship"] = tidy_authorship(F.replace(c("_a1"), F.lit(" ,"), F.lit(",")))
    if changed:
        differs = [~v.eqNullSafe(F.col(n)) for n, v in values.items()]
        out = out.withColumn(changed, F.array_contains(F.array(*differs), True))
    return out.withColumns(values).select(*df.columns)


def duplicate_keys(df: DataFrame, pk: str = "taxonID") -> DataFrame:
    return df.filter(F.col(pk) != "").groupBy(pk).agg(F.count("*").alias("n")).filter("n > 1")


def mint_keys(df: DataFrame, pk: str = "taxonID", order_col: str = "_ord", digits: int = 16, compat: bool = False,
              row_as_read: str | None = None) -> DataFrame:
    """Give rows with a blank or already used key a hash of the row as key.

    Of rows that share a key the first keeps it.  Equal rows get an occurrence number, so
    minted keys are unique; ``compat`` gives the 8-digit key that equal rows share, of the
    text in ``row_as_read`` where that is given, a column that is then dropped.  The
    first use of a key is an aggregate over repeated keys only, so neither the blank key
    nor a popular one is gathered in a task.
    """
    values = [F.coalesce(c, F.lit("")) for c in df.columns if c != order_col]
    again = df.filter(F.col(pk) != "").groupBy(pk).agg(F.count("*").alias("_n"), F.min(order_col).alias("_first"))
    key = F.when(F.col(pk) == "", F.concat(F.lit("\u0001"), F.col(order_col).cast("string"))).otherwise(F.col(pk))
    first = again.filter("_n > 1").select(F.col(pk).alias("_key"), "_first")
    joined = df.withColumn("_key", key).join(first, "_key", "left")
    repeated = F.coalesce(F.col("_first") != F.col(order_col), F.lit(False))
    if compat:
        text = F.array_join(F.split(F.col(row_as_read) if row_as_read else F.concat_ws("^", *values), ""), "^")
        minted = F.when((F.col(pk) == "") | repeated, F.substring(F.sha1(text), 1, 8)).otherwise(F.col(pk))
        return joined.withColumn(pk, minted).select(*[c for c in df.columns if c != row_as_read])
    marked = stage(joined.select(*df.columns, ((F.col(pk) == "") | repeated).alias("_mint"),
                                 F.substring(F.sha1(F.concat_ws("^", *values)), 1, digits).alias("_hash")), "keys")
    numbered = number_within(marked.filter("_mint"), ["_hash"], [order_col], "_n")
    fresh = F.when(F.col("_n") == 1, F.col("_hash")).otherwise(F.concat_ws(".", "_hash", "_n"))
    return marked.filter("not _mint").select(*df.columns).unionByName(
        numbered.withColumn(pk, fresh).select(*df.columns))


def add_managed_id(df: DataFrame, prefix: str, column: str) -> DataFrame:
    return df.withColumn("managed_id", F.when(F.col(column) != "", F.concat(F.lit(prefix + ":"), column)).otherwise(""))


def long_fields(df: DataFrame, limit: int = 10000) -> DataFrame:
    """(taxonID, field, chars) of fields longer than a limit."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.length(c).alias("chars")) for c in text])
    return df.select("taxonID", F.inline(F.filter(cells, lambda x: x["chars"] > limit)))


def clean_metrics(df: DataFrame) -> DataFrame:
    """One row of counts about a raw checklist (with standard columns)."""
    senior = F.col("taxonomicStatus") == "senior synonym"
    return df.agg(
        F.count_if(~senior).alias("records"), F.count_if(senior).alias("senior"),
        F.count_if(~senior & (F.col("taxonID") == "")).alias("blank_keys"),
        F.count_if(~senior & _normalizes()).alias("normalized"))


#: Columns by which ``clean`` counts what it does to a row.
_FLAGS = ("_senior", "_blank", "_normalized", "_cleaned", "_managed")


def clean_counters() -> dict[str, Column]:
    """Metrics over rows with ``_FLAGS``; all but senior leave the senior synonyms out."""
    stays = ~F.col("_senior")
    named = {"minted": "_blank", "normalized": "_normalized", "cleaned": "_cleaned", "managed": "_managed"}
    return {"records": F.count_if(stays), "senior": F.count_if(F.col("_senior"))} | {
        name: F.count_if(stays & F.col(flag)) for name, flag in named.items()}


def clean(df: DataFrame, pk: str = "taxonID", managed: str | None = None, names: bool = True, compat: bool = False,
          observation: Observation | None = None) -> DataFrame:
    """All cleaning rules; ``managed`` is ``prefix:column``.

    An ``observation`` gathers ``clean_counters`` in the pass that cleans the rows.
    """
    out = fill_missing(normalize_headers(df))
    read = [c for c in out.columns if c != "_ord"]
    for column in (pk, "scientificName", "canonicalName"):
        if column not in out.columns:
            out = out.withColumn(column, F.lit(""))
    have = set(out.columns)
    no = F.lit(False)
    flags = {"_senior": F.col("taxonomicStatus") == "senior synonym" if "taxonomicStatus" in have else no, "_blank": F.col(pk) == "",
             "_normalized": no, "_cleaned": no, "_managed": no}
    linked = {"acceptedNameUsageID", "parentNameUsageID", "taxonID"} <= have
    if linked:
        flags["_normalized"] = _normalizes()
    out = out.withColumns(flags)
    if linked:
        out = normalize_accepted(out)
    if compat:
        out = out.withColumn("_read", F.concat_ws("^", *read))
    if "landmark_status" in have:
        out = out.withColumn("landmark_status", recode_landmark(F.col("landmark_status")))
    if "source" in have:
        out = out.withColumn("source", first_source(F.col("source")))
    if names:
        absent = "scientificNameAuthorship" not in have
        out = clean_names(out.withColumn("scientificNameAuthorship", F.lit("")) if absent else out, compat, "_cleaned")
        out = out.drop("scientificNameAuthorship") if absent else out
    if managed:
        prefix, column = managed.split(":")
        out = add_managed_id(out, prefix, column).withColumn("_managed", F.lit(True))
    if observation is not None:
        # one pass, as a plan that reads the rows twice would count them twice
        out = stage(out.observe(observation, *[c.alias(n) for n, c in clean_counters().items()]), "cleaned")
    out = out.filter(~F.col("_senior")).drop(*_FLAGS)
    return mint_keys(out, pk, compat=compat, row_as_read="_read" if compat else None)
