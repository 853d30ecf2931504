"""Checklists derived from the driver's star-schema tables.

The rules are those of FIXTURES.md; every table grows with its source table.
``_ord`` is the row order inside a checklist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_KIND = 1_000_000_000_000
COLUMNS = (
    "_ord taxonID parentNameUsageID acceptedNameUsageID taxonRank taxonomicStatus "
    "canonicalName scientificNameAuthorship scientificName"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def cap(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def _rows(df: DataFrame, kind: int, number: Column, **values) -> DataFrame:
    """A block of checklist rows; absent fields are the empty string."""
    values.setdefault("taxonomicStatus", F.lit("accepted"))
    fields = {c: values.get(c, F.lit("")) for c in COLUMNS[1:-1]}
    name = F.trim(F.concat_ws(" ", fields["canonicalName"], fields["scientificNameAuthorship"]))
    return df.select(
        (F.lit(kind * _KIND) + number.cast("bigint")).alias("_ord"),
        *[c.alias(n) for n, c in fields.items()],
        name.alias("scientificName"),
    )


def _segment_number(segment: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment) - 1).cast("int")


def _segment_name(number: Column) -> Column:
    return cap(F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), number + 1))


def checklist_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checklist(spark, sf_dir, edited=False)


def checklist_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checklist(spark, sf_dir, edited=True)


def _checklist(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    p = "b" if edited else ""
    k, n = F.col("k"), F.col("n")
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    # dealt out while rows are narrow: a file of a few MB is one task, and names are made of its rows
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").alias("n"),
        _segment_number(F.col("c_mktsegment")).alias("seg"),
    ).repartition("k")
    key = F.col("n_nationkey")
    home = F.col("n_regionkey")
    year = 1800 + k % 200
    moved = F.lit(False)
    status, accepted = F.lit("accepted"), F.lit("")
    if edited:
        home = F.when(key % 10 == 0, (home + 1) % 5).otherwise(home)
        customer = customer.filter("k % 13 <> 0")
        moved = k % 17 == 0
        customer = customer.withColumn("seg", F.when(moved, (F.col("seg") + 1) % 5).otherwise(F.col("seg")))
        year = F.when((k % 19 == 0) & ~moved, year + 1).otherwise(year)
        synonym = (k % 11 == 0) & (k > 0) & ((k - 1) % 13 != 0)
        status = F.when(synonym, "synonym").otherwise("accepted")
        accepted = F.when(synonym, F.concat(F.lit("bS"), k - 1)).otherwise("")
    author = F.concat(F.lit("Smith"), letters(n), F.lit(", "), year)
    if edited:
        author = F.when(moved, F.concat(F.lit("("), author, F.lit(")"))).otherwise(author)
        author = F.when(k % 23 == 0, "").otherwise(author)
    genus_id = F.concat(F.lit(p + "G"), n, F.lit("_"), F.col("seg"))
    genus = _segment_name(F.col("seg"))
    parts = [
        _rows(region, 1, F.col("r_regionkey"), taxonID=F.concat(F.lit(p + "R"), "r_regionkey"),
              taxonRank=F.lit("order"), canonicalName=cap(F.col("r_name"))),
        _rows(nation, 2, key, taxonID=F.concat(F.lit(p + "N"), key),
              parentNameUsageID=F.concat(F.lit(p + "R"), home),
              taxonRank=F.lit("family"), canonicalName=F.concat(F.lit("Natio"), letters(key))),
        _rows(customer.select("n", "seg").distinct(), 3, n * 10 + F.col("seg"), taxonID=genus_id,
              parentNameUsageID=F.concat(F.lit(p + "N"), n),
              taxonRank=F.lit("genus"), canonicalName=genus),
        _rows(customer, 4, k, taxonID=F.concat(F.lit(p + "S"), k),
              parentNameUsageID=F.when(status == "accepted", genus_id).otherwise(""),
              acceptedNameUsageID=accepted, taxonomicStatus=status,
              taxonRank=F.lit("species"), canonicalName=F.concat_ws(" ", genus, letters(k)),
              scientificNameAuthorship=author),
    ]
    if not edited:
        parts.append(
            _rows(customer.filter("k % 7 = 0"), 5, k, taxonID=F.concat(F.lit("T"), k),
                  parentNameUsageID=F.concat(F.lit("S"), k), taxonRank=F.lit("subspecies"),
                  canonicalName=F.concat_ws(" ", genus, letters(k), letters(k)),
                  scientificNameAuthorship=author))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def homonyms(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Checklist whose names repeat: families are part types (A) or brands (B)."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    brand = F.split("p_brand", "#")[1]
    family = F.col("p_type") if side == "A" else F.concat(F.lit("Brand"), letters(brand))
    part = part.select(
        F.col("p_partkey").alias("k"), cap(words[0]).alias("genus"), F.regexp_replace("p_name", "^[^ ]+ ", "").alias("epithet"),
        cap(F.concat(F.lit("brand"), letters(brand))).alias("author"),
        (1900 + F.col("p_size")).cast("string").alias("year"), cap(family).alias("family"))
    fam, gen = F.col("family"), F.col("genus")
    author = F.concat_ws(", ", "author", "year")
    # a family or genus is numbered by its first part, which is in no other
    families = part.groupBy("family").agg(F.min("k").alias("k"))
    genera = part.groupBy("family", "genus").agg(F.min("k").alias("k"))
    return (
        _rows(families, 1, F.col("k"), taxonID=F.concat(F.lit("F"), fam),
              taxonRank=F.lit("family"), canonicalName=fam)
        .unionByName(_rows(genera, 2, F.col("k"),
                           taxonID=F.concat_ws("_", F.lit("G"), fam, gen),
                           parentNameUsageID=F.concat(F.lit("F"), fam),
                           taxonRank=F.lit("genus"), canonicalName=gen))
        .unionByName(_rows(part, 3, F.col("k"), taxonID=F.concat(F.lit("P"), "k"),
                           parentNameUsageID=F.concat_ws("_", F.lit("G"), fam, gen),
                           taxonRank=F.lit("species"), canonicalName=F.concat_ws(" ", "genus", "epithet"),
                           scientificNameAuthorship=author))
    )


def guessed(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Checklist with unknown parts: neighbours share epithets, `?`, Someone and 1111 stand for what is unknown.

    Side B has other authors, years, genera and middle parts here and there, and fewer rows.
    """
    p, b = ("", F.lit(False)) if side == "A" else ("b", F.lit(True))
    k, n = F.col("k"), F.col("n")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), _segment_number(F.col("c_mktsegment")).alias("seg"))
    rows = rows.filter(~b | (k % 23 != 0)).withColumn("seg", F.when(b & (k % 10 == 7), (F.col("seg") + 1) % 5).otherwise(F.col("seg")))
    genus = F.when(k % 11 == 3, "?").otherwise(_segment_name(F.col("seg")))
    epithet = F.when(k % 13 == 5, "?").otherwise(letters((k / 4).cast("bigint")))
    middle = F.when(k % 18 == 2, "?").when(k % 18 == 11, letters(k % 7 + F.when(b & (k % 4 == 1), 1).otherwise(0)))
    name = F.concat_ws(" ", genus, middle, epithet)
    token = F.when(k % 16 == 7, "Someone").when(b & (k % 17 == 4), "Weber").when(k % 5 == 1, "Li").otherwise(F.concat(F.lit("Smith"), letters(n % 3)))
    year = F.when(k % 14 == 9, 1111).otherwise(1800 + (k / 4).cast("bigint") % 50 + F.when(b & (k % 19 == 6), 1).otherwise(0))
    author = F.concat(token, F.lit(", "), year)
    author = F.when((k % 8 == 3) | (b & (k % 20 == 17)), F.concat(F.lit("("), author, F.lit(")"))).otherwise(author)
    synonym = (k % 6).isin(1, 5) & (k > 0) & ~(b & ((k - 1) % 23 == 0))
    genus_id = F.concat(F.lit(p + "G"), n, F.lit("_"), F.col("seg"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    return (
        _rows(nation, 2, n, taxonID=F.concat(F.lit(p + "N"), n), taxonRank=F.lit("family"), canonicalName=F.concat(F.lit("Natio"), letters(n)))
        .unionByName(_rows(rows.select("n", "seg").distinct(), 3, n * 10 + F.col("seg"), taxonID=genus_id, parentNameUsageID=F.concat(F.lit(p + "N"), n),
                           taxonRank=F.lit("genus"), canonicalName=_segment_name(F.col("seg"))))
        .unionByName(_rows(rows, 4, k, taxonID=F.concat(F.lit(p + "S"), k), parentNameUsageID=F.when(synonym, "").otherwise(genus_id),
                           acceptedNameUsageID=F.when(synonym, F.concat(F.lit(p + "S"), k - 1)).otherwise(""),
                           taxonomicStatus=F.when(~synonym, "accepted").when(k % 6 == 1, "objective synonym").otherwise("synonym"),
                           taxonRank=F.when(middle.isNull(), "species").otherwise("subspecies"), canonicalName=name, scientificNameAuthorship=author)))


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklist A with faults: chains of synonyms, orphans, rings, bad ranks, odd statuses, repeated ids."""
    a = checklist_a(spark, sf_dir)
    k = F.substr("taxonID", F.lit(2)).cast("bigint")
    species = F.col("taxonRank") == "species"
    a = a.withColumn("k", F.when(species, k))
    k = F.col("k")

    def change(column: str, *rules) -> Column:
        out = F.col(column)
        for test, value in rules:
            out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
        return out

    inner = k < table(spark, sf_dir, "customer").agg(F.max("c_custkey") - 3).scalar()
    chain = inner & (k % 29).isin(1, 2)
    orphan, lost, loose = k % 31 == 5, k % 37 == 6, k % 47 == 10
    ring_up, ring_down = inner & (k % 86 == 8), inner & (k % 86 == 9)
    nxt = F.concat(F.lit("S"), k + 1)
    # a second row with the same id, far down in the file
    again = F.when(species & (k % 61 == 17), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    a = a.withColumn("_again", F.explode(again))
    return a.select(
        (F.col("_ord") + F.col("_again") * _KIND).alias("_ord"), "taxonID",
        change("parentNameUsageID", (orphan, F.concat(F.lit("X"), k)), (ring_up, nxt),
               (ring_down, F.concat(F.lit("S"), k - 1)), (chain | lost, F.lit(""))).alias("parentNameUsageID"),
        change("acceptedNameUsageID", (chain, nxt), (lost & ~chain, F.concat(F.lit("Y"), k))).alias("acceptedNameUsageID"),
        change("taxonRank", (k % 41 == 7, F.lit("genus")), (k % 53 == 11, F.lit("family"))).alias("taxonRank"),
        change("taxonomicStatus", (k % 5 == 4, F.lit("valid")), (k % 59 == 3, F.lit("provisionally accepted name")),
               (chain | lost | loose, F.lit("synonym"))).alias("taxonomicStatus"),
        "canonicalName", "scientificNameAuthorship", "scientificName",
        F.when(k.isNotNull(), (1800 + k * 7 % 150).cast("string")).otherwise("").alias("namePublishedInYear"))


def varied_names(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """One name per customer, in many spellings, some with parser output; ``customers`` may be a stream."""
    c = table(spark, sf_dir, "customer") if customers is None else customers
    k = F.col("c_custkey")
    g, e = _segment_name(_segment_number(F.col("c_mktsegment"))), letters(k)
    base = F.concat_ws(" ", g, e)
    year = (1750 + k % 260).cast("string")
    i = k % 16
    spelled = {
        0: [base, F.lit(" (Smith, "), year, F.lit(")")], 1: [base, F.lit(" J. R. Miller & Jones, "), year],
        2: [base, F.lit(" Someone, 1111")], 3: [base, F.lit(" × "), g, F.lit(" minor")],
        4: [F.lit("? "), e, F.lit(" Gray, "), year], 5: [base, F.lit("  "), e, F.lit(" Gray, ("), year, F.lit(")")],
        6: [g], 7: [base, F.lit(" Li, "), year], 8: [base, F.lit(" [sic] Weber sensu Daniel, 1884")],
        9: [base, F.lit(" Fitz-Gibbon in O'Neil, "), year, F.lit(".")], 10: [g, F.lit(" ("), g, F.lit(") "), e],
        11: [base, F.lit(" Linnaeus, "), year, F.lit(" (Gervais, 1847)")], 12: [g, F.lit(" ?")],
        13: [base, F.lit(" minor major Thomas "), year], 14: [F.lit("")], 15: [base, F.lit(" de Winton, "), year],
    }
    sci = F.lit("")
    for n, pieces in spelled.items():
        sci = F.when(i == n, F.concat(*pieces)).otherwise(sci)
    has_can, has_auth, has_gn = (k % 3 == 0) | (i == 14), k % 4 < 2, (k % 5 == 2) & ~i.isin(4, 12)
    author = F.when(k % 7 == 0, F.concat(F.lit("Brown, "), year, F.lit(". "))).when(
        k % 7 == 1, F.concat(F.lit("(A. Brown, "), year, F.lit(")"))).when(
        k % 7 == 2, F.concat(F.lit("Brown, 1895 (Gervais, "), year, F.lit(")"))).otherwise(F.concat(F.lit("Brown, "), year))
    author = F.when(has_auth, author).otherwise("")
    full = F.when(has_gn & (i == 3), F.concat(base, F.lit(" × "), g, F.lit(" minor"))).when(
        has_gn & (i == 13), F.concat(base, F.lit(" minor"))).when(has_gn & (i == 6), g).when(has_gn, base).otherwise("")
    stem = F.when(full.contains(" "), F.substring(full, F.lit(1), F.length(full) - 1)).otherwise(full)
    return c.select(
        k.alias("_ord"), F.concat(F.lit("V"), k).alias("taxonID"), sci.alias("scientificName"),
        F.when(has_can, base).otherwise("").alias("canonicalName"), author.alias("scientificNameAuthorship"),
        F.when(k % 11 == 0, "species").when(k % 11 == 1, "subspecies").otherwise("").alias("taxonRank"),
        F.when(k % 17 == 3, "common name").otherwise("").alias("nomenclaturalStatus"),
        F.when(k % 2 == 0, g).otherwise("").alias("genericName"), F.when(k % 2 == 0, e).otherwise("").alias("specificEpithet"),
        F.when(k % 2 == 0, e).otherwise("").alias("infraspecificEpithet"),
        full.alias("gn_canonical_full"), stem.alias("gn_canonical_stem"),
        F.when(has_gn & (k % 2 == 0), F.concat(F.lit("Brown "), year)).otherwise("").alias("gn_authorship"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklist A as dirty rows: faults that cleaning repairs, in a table with foreign headers."""
    a = checklist_a(spark, sf_dir)
    k, species = F.col("_ord") % _KIND, F.col("taxonRank") == "species"
    word, rest = F.split("canonicalName", " ")[0], F.regexp_replace("canonicalName", "^[^ ]+ ", "")
    several = F.col("canonicalName").contains(" ")
    name = F.when(several & (k % 6 == 0), F.concat(word, F.lit(" ("), word, F.lit(") "), rest)).when(
        several & (k % 6 == 1), F.concat(word, F.lit("  "), rest)).otherwise(F.col("canonicalName"))
    author = F.col("scientificNameAuthorship")
    spelled = (F.when(author == "", "").when(k % 5 == 0, F.concat(F.lit("("), author, F.lit(").")))
               .when(k % 5 == 1, F.concat(F.lit("Gray and "), author)).when(k % 5 == 2, F.replace(author, F.lit(", "), F.lit(" ,, ")))
               .otherwise(author))
    return a.select(
        "_ord",
        F.when(k % 29 == 4, "").when(species & (k % 31 == 7), F.concat(F.lit("S"), k - 1)).otherwise(F.col("taxonID")).alias("taxonId"),
        F.col("parentNameUsageID").alias("dwc:parentNameUsageID"),
        F.when(k % 8 == 0, F.col("taxonID")).when(species & (k % 8 == 1), F.concat(F.lit("S"), k + 1)).otherwise("").alias("dwc:acceptedNameUsageID"),
        F.col("taxonRank").alias("dwc:taxonRank"),
        F.when(k % 23 == 5, "senior synonym").when(k % 8 == 1, "synonym").when(k % 8 == 2, "Dubious").when(
            k % 8 == 3, "provisionally accepted").when(k % 8 == 4, "unplaced").otherwise("accepted").alias("dwc:taxonomicStatus"),
        F.when(k % 9 < 6, F.concat_ws(" ", name, spelled)).otherwise("").alias("dwc:scientificName"),
        F.when(k % 9 != 2, name).otherwise(F.when(k % 2 == 0, "")).alias("canonicalName"),
        F.when(k % 4 < 3, spelled).otherwise("").alias("scientificNameAuthorship"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise((k % 6).cast("string")).alias("Landmark"),
        F.concat_ws(",", F.concat(F.lit("src"), k % 3), F.concat(F.lit("old"), k % 5)).alias("source"))
