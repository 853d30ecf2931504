import itertools

from pyspark.sql import functions as F

from taxalign.functions import homotypy as H, names as N
from taxalign.operators.names import parse_names, restore_question_marks

CASES = {
    "Mus musculus (Linnaeus, 1758)": ("Mus", "", "musculus", "Linnaeus", "1758", False),
    "Mus musculus W. E. Smith, 1900": ("Mus", "", "musculus", "Smith", "1900", True),
    "Mus musculus Gray, (1867) & al.": ("Mus", "", "musculus", "Gray", "1867", True),
    "Mus musculus Someone, 1111": ("Mus", "", "musculus", None, None, True),
    "Mus": ("Mus", "", "", None, None, None),
    "Mus a b": ("Mus", "a", "b", None, None, None),
    "Mus a × b": ("Mus a × b", "", "", None, None, None),
}


def test_scientific_names(spark):
    df = spark.createDataFrame([(s,) for s in CASES], "scientificName string").withColumn("taxonID", F.lit("t"))
    for r in parse_names(df).collect():
        p = r.parts
        assert (p.genus, p.middle, p.epithet, p.token, p.year, p.protonymp) == CASES[r.scientificName], r.scientificName


def test_given_authorship(spark):
    rows = [("Mus a Gray, 1850", "Mus a", "Gray, 1850."), ("Mus a Gray, 1850", "Mus a", "X, 1895 (Y, 1847)"), ("Mus a Gray, 1850", "Mus a", "")]
    df = spark.createDataFrame(rows, "scientificName string, canonicalName string, scientificNameAuthorship string").withColumn("taxonID", F.lit("t"))
    got = [(r.parts.authorship, r.parts.token) for r in parse_names(df).collect()]
    # an ill-formed authorship falls back on the name; a blank one is not looked for in it
    assert got == [("Gray, 1850", "Gray"), ("Gray, 1850", "Gray"), ("", None)]


def test_stem_is_used_only_when_complete(spark):
    rows = [("Mus maximus Gray", "Mus maximus", "Mus maxim"), ("Mus aa bb cc Gray", "Mus aa", "Mus a")]
    df = spark.createDataFrame(rows, "scientificName string, gn_canonical_full string, gn_canonical_stem string").withColumn("taxonID", F.lit("t"))
    got = [(r.parts.epithet, r.parts.canonical) for r in parse_names(df).collect()]
    assert got == [("maxim", "Mus maximus"), ("cc", "Mus aa bb cc")]


def test_filter_on_parts_stays_above_the_parser(spark):
    df = spark.createDataFrame([("Mus a Gray, 1850",)], "scientificName string").withColumn("taxonID", F.lit("t"))
    kept = parse_names(df).filter("parts.genus is not null").select(N.unparse(F.col("parts")).alias("n"))
    assert kept.first().n == "Mus a Gray, 1850"
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_question_marks(spark):
    row = spark.range(1).select(restore_question_marks(F.lit("Xyzzy foo xyzzy")).alias("a")).first()
    assert row.a == "? foo ?"


def test_all_81_combinations(spark):
    value = {1: ("x", "x"), -1: ("x", "z"), 0: ("x", None)}
    rows = []
    for e, g, t, y in itertools.product((1, -1, 0), repeat=4):
        p = [value[k] for k in (g, e, t, y)]
        rows.append(((e, g, t, y), tuple(a for a, _ in p), tuple(b for _, b in p)))
    part = "struct<genus:string,epithet:string,token:string,year:string>"
    df = spark.createDataFrame(rows, f"k array<int>, p {part}, q {part}".replace("array<int>", "struct<e:int,g:int,t:int,y:int>"))
    df = df.withColumns({"p": F.col("p").withField("middle", F.lit("")), "q": F.col("q").withField("middle", F.lit(""))})
    for r in df.select("k", H.compare_names(F.col("p"), F.col("q")).alias("c")).collect():
        e, g, t, y = r.k
        want = (0 if e != 1 or (t, y) == (-1, -1) else (10 if g == 1 else 8) if (t, y) == (1, 1)
                else (9 if g == 1 else 2) if 1 in (t, y) else 5 if (t, y) == (0, 0) else 2)
        assert r.c == want, (e, g, t, y, r.c, want)
