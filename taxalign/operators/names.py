"""Names of checklist rows: extraction, join with parser output, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names as N
from .tree import with_columns_present

_TEXT = ("scientificName canonicalName scientificNameAuthorship nomenclaturalStatus "
         "genericName specificEpithet infraspecificEpithet taxonRank").split()


def extracted_name(columns=lambda n: F.col(n)) -> Column:
    """The string to hand to a name parser, from the columns of a cleaned row."""
    c = columns
    sci, author = c("scientificName"), c("scientificNameAuthorship")
    built = (F.when(c("taxonRank") == "species", F.concat(c("genericName"), F.lit(" "), c("specificEpithet")))
             .when(c("taxonRank") == "subspecies",
                   F.concat(c("genericName"), F.lit(" "), c("specificEpithet"), F.lit(" "), c("infraspecificEpithet")))
             .otherwise(""))
    built = F.when((c("genericName") == "") & (c("specificEpithet") == ""), "").otherwise(built)
    name = F.when(sci != "", sci).when(c("canonicalName") != "", c("canonicalName")).otherwise(built)
    add = ((name != "") & ~F.regexp_like(sci, F.lit(N.YEAR)) & F.regexp_like(author, F.lit(N.YEAR))
           & F.regexp_like(F.substring(author, 1, 2), F.lit(r"\p{Lu}")))
    name = F.when(add, F.concat_ws(" ", name, author)).otherwise(name)
    name = F.when(c("nomenclaturalStatus").contains("common"), "").otherwise(name)
    name = F.replace(name, F.lit(" [sic]"), F.lit(""))
    at = F.instr(name, " sensu ")
    name = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)
    lead = name.startswith("? ") | (name == "?")
    name = F.when(lead, F.concat(F.lit("Xyzzy"), F.substr(name, F.lit(2)))).otherwise(name)
    return F.replace(name, F.lit("?"), F.lit("xyzzy"))


def extract_names(df: DataFrame) -> DataFrame:
    """Add ``name_to_parse``."""
    return with_columns_present(df, _TEXT).withColumn("name_to_parse", extracted_name())


def restore_question_marks(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "^Xyzzy", "?"), F.lit("xyzzy"), F.lit("?"))


def join_gnparse(df: DataFrame, parsed: DataFrame) -> DataFrame:
    """Add the parser's full form, stem and authorship to the rows they belong to.

    The parser is a function of the line, so its output is joined on the line, once per
    distinct line.  Rows the parser was not given keep empty fields.
    """
    fields = {"Verbatim": "gn_verbatim", "CanonicalFull": "gn_canonical_full",
              "CanonicalStem": "gn_canonical_stem", "Authorship": "gn_authorship", "Quality": "gn_quality"}
    df = df.drop(*fields.values())  # what an earlier parser said counts no longer
    named = extract_names(df)
    table = parsed.select(F.col("Verbatim").alias("name_to_parse"), *[F.col(k).alias(v) for k, v in fields.items()])
    table = table.dropDuplicates(["name_to_parse"])
    key = F.when(F.col("name_to_parse") == "", F.concat(F.lit("\u0001"), F.xxhash64(*df.columns))).otherwise(F.col("name_to_parse"))
    out = named.withColumn("_key", key).join(table.withColumnRenamed("name_to_parse", "_key"), "_key", "left")
    fixed = {v: restore_question_marks(F.coalesce(v, F.lit(""))) for v in list(fields.values())[:4]}
    full, stem = fixed["gn_canonical_full"], fixed["gn_canonical_stem"]
    fixed["gn_canonical_stem"] = F.when(full.endswith("ii") & stem.endswith("i"),
                                        F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
    out = out.withColumns(fixed)
    fill = lambda c, other: F.when(F.col(c) == "", F.col(other)).otherwise(F.col(c))
    out = out.withColumns({"canonicalName": fill("canonicalName", "gn_canonical_full"),
                           "scientificName": fill("scientificName", "gn_verbatim")})
    kept = list(dict.fromkeys([*df.columns, "canonicalName", "scientificName",
                               "gn_canonical_full", "gn_canonical_stem", "gn_authorship", "gn_quality"]))
    return out.select(*kept)


def rejected_names(prepared: DataFrame) -> DataFrame:
    """Rows without a full form or a stem."""
    return prepared.filter("gn_canonical_full = '' or gn_canonical_stem = ''").select(
        "taxonID", "scientificName", "gn_quality")


def parse_names(df: DataFrame, token_pattern: str = N.TOKEN) -> DataFrame:
    """Add the ``parts`` struct; every expression runs in the JVM."""
    have = with_columns_present(df)
    c = F.col
    best = F.coalesce(*[N.known(c(n)) for n in ("scientificName", "canonicalName", "managed_id", "taxonID")])
    author = F.trim("scientificNameAuthorship")
    out = have.withColumns({
        "_v": F.replace(best, F.lit("  "), F.lit(" ")), "_can": N.known(F.trim("canonicalName")), "_aut": author,
        "_full": N.known(c("gn_canonical_full")), "_stem": N.known(c("gn_canonical_stem"))})
    out = out.withColumn("_aut", F.when(c("scientificNameAuthorship") == "", c("gn_authorship"))
                         .when(c("_aut").endswith("."), F.substring("_aut", F.lit(1), F.length("_aut") - 1)).otherwise(c("_aut")))
    out = out.withColumn("_given", c("_can").isNotNull() & ~(c("_aut").endswith(")") & ~c("_aut").startswith("(")))
    cut = N.split_name(c("_v"))
    out = out.withColumns({"_own": F.when(c("_given"), c("_can")).otherwise(cut["canonical"]),
                           "_by": F.when(c("_given"), c("_aut")).otherwise(cut["authorship"])})
    out = out.withColumn("_by", F.regexp_replace("_by", "^[, ]+|[, ]+$", ""))
    out = out.withColumn("_used", F.when(c("_full").isNull(), c("_by")).otherwise(N.known(c("gn_authorship"))))
    out = N.recover_canonical(out, "_full", "_stem", "_own", "_n_")
    out = N.analyze_authorship(out, "_used", "_p_", token_pattern)
    out = N.analyze_authorship(out, "_by", "_q_", token_pattern)
    wild = lambda name: F.when(c(name) != "?", c(name))
    parts = F.struct(
        c("_v").alias("scientific"), c("_n_canonical").alias("canonical"), wild("_n_genus").alias("genus"),
        wild("_n_middle").alias("middle"), wild("_n_epithet").alias("epithet"), c("_used").alias("authorship"),
        F.coalesce("_p_token", "_q_token").alias("token"), F.least("_p_year", "_q_year").alias("year"),
        F.coalesce("_q_protonymp", "_p_protonymp").alias("protonymp"))
    # a generator with one row: filters on parts stop here instead of being rewritten, with all
    # the steps above spelled out in each, down to the scan
    return out.select(*have.columns, F.explode(F.array(parts)).alias("parts"))
