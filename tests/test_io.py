import pytest
from pyspark.sql import functions as F

from taxalign import staging
from taxalign.operators import clean as C, names as NM
from taxalign.sources import readers, writers
from taxalign.streaming.prepare import prepare_stream


def test_tsv_with_bom_quotes_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('﻿dwc:taxonId\tscientificName\tsource\n1\tAus "x" bus\ta,b\n2\tAus\n3\tAus\tc\textra\n', encoding="utf-8")
    df = readers.read_checklist(spark, str(path))
    assert df.columns == ["taxonID", "scientificName", "source", "_ord"]
    assert [(r.taxonID, r.scientificName, r.source) for r in df.orderBy("_ord").collect()] == [("1", 'Aus "x" bus', "a,b"), ("2", "Aus", ""), ("3", "Aus", "c")]
    counts = readers.ragged_counts(spark, str(path)).first()
    assert (counts.trimmed, counts.short) == (1, 1)


def test_csv_round_trip_keeps_quotes_and_blanks(spark, tmp_path):
    rows = [(0, "1", 'a "q", b', ""), (1, "2", "x\ny", "z")]
    df = spark.createDataFrame(rows, "_ord bigint, taxonID string, scientificName string, source string")
    path = str(tmp_path / "out.csv")
    writers.write_csv(df, path)
    back = readers.read_checklist(spark, path)
    assert sorted(map(tuple, back.drop("_ord").collect())) == sorted(r[1:] for r in rows)


def test_csv_is_split_whatever_its_values_hold(spark, tmp_path):
    rows = [(str(i), f'a ""q"", {i}') for i in range(400)]
    whole = "taxonID,scientificName\n" + "".join(f'{i},"{v}"\n' for i, v in rows)
    tails = {"plain": '"""","",""', "over": '400,"x\ny"', "open": '4"0,"x\ny"', "empty": '400,"""\ny"'}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name, tail in tails.items():
            path = tmp_path / f"{name}.csv"
            path.write_text(whole + tail + "\n")
            df = readers.read_checklist(spark, str(path))
            got = [(r.taxonID, r.scientificName) for r in df.orderBy("_ord").collect()]
            assert got[:400] == [(i, v.replace('""', '"')) for i, v in rows]
            want = {"plain": ('"', ""), "over": ("400", "x\ny"), "open": ('4"0', "x\ny"), "empty": ("400", '"\ny')}
            assert got[400:] == [want[name]]
            assert df.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parser_output_must_have_its_columns(spark, tmp_path):
    good = tmp_path / "gn.csv"
    good.write_text("Id,Verbatim,Cardinality,CanonicalStem,CanonicalSimple,CanonicalFull,Authorship,Year,Quality\n1,Aus ii Gray,2,Aus ii,Aus ii,Aus ii,Gray,,1\n")
    parsed = readers.read_gnparse(spark, str(good))
    rows = spark.createDataFrame([("1", "Aus ii Gray", "")], "taxonID string, scientificName string, canonicalName string")
    out = NM.join_gnparse(rows, parsed).first()
    assert (out.gn_canonical_full, out.gn_canonical_stem, out.canonicalName) == ("Aus ii", "Aus i", "Aus ii")
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_gnparse(spark, str(bad))


def test_blank_and_repeated_keys(spark):
    rows = [(0, "", "x"), (1, "", "x"), (2, "k", "a"), (3, "k", "b"), (4, "k", "b"), (5, "m", "c")] + [(i, "", "hot") for i in range(10, 210)]
    df = spark.createDataFrame(rows, "_ord bigint, taxonID string, v string")
    out = C.mint_keys(df).collect()
    assert len({r.taxonID for r in out}) == len(rows)
    kept = {r._ord: r.taxonID for r in out}
    assert (kept[2], kept[5]) == ("k", "m") and kept[3] != "k"
    shared = {r._ord: r.taxonID for r in C.mint_keys(df, compat=True).collect()}
    assert shared[0] == shared[1] and len(shared[0]) == 8


def test_clean_without_a_key_column(spark):
    df = spark.createDataFrame([(0, "Aus (Bus) cus Gray, 1850")], "_ord bigint, scientificName string")
    row = C.clean(df).first()
    assert row.scientificName == "Aus cus Gray, 1850" and len(row.taxonID) == 16


def test_scatter(spark, tmp_path):
    df = spark.createDataFrame([("add", "1"), ("add", "2"), ("remove", "3")], "mode string, taxonID string")
    counts = {r["mode"]: r.n for r in writers.scatter(df, str(tmp_path / "s")).collect()}
    assert counts == {"add": 2, "remove": 1}
    assert spark.read.csv(str(tmp_path / "s" / "mode=add"), header=True).columns == ["taxonID"]


def test_staged_tables_live_in_the_shared_folder(spark, tmp_path):
    df = staging.stage(spark.range(5), "t")
    assert df.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(staging.shared_folder(spark).removeprefix("file:").lstrip("/"))
    assert df.count() == 5


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(str(i), f"Aus {'abcde'[i % 5]} Gray and Weber, 18{i:02d}", "senior synonym" if i % 7 == 0 else "accepted") for i in range(40)]
    df = spark.createDataFrame(rows, "taxonID string, scientificName string, taxonomicStatus string")
    df.write.json(str(source))
    stream = prepare_stream(spark.readStream.schema(df.schema).json(str(source)), managed="x:taxonID")
    q = stream.writeStream.format("memory").queryName("prepared").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = prepare_stream(df, managed="x:taxonID")
    columns = ["taxonID", "managed_id", "name_to_parse", "parts"]
    assert sorted(map(str, spark.table("prepared").select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_dump_names_by_value_and_file_order(spark, tmp_path):
    from taxalign.operators import ncbi
    from taxalign.sources import readers

    def line(*cells):
        return "\t|\t".join(cells) + "\t|"

    # the first two share the short hash; of the authorities the last in the file counts
    names = [line("7", "Aus n85730", "", "synonym"), line("7", "Aus n86026", "", "synonym"), line("7", "Aus n86026", "", "synonym"),
             line("7", "Aus", "", "scientific name"), line("7", "Aus Zed, 1900", "", "authority"), line("7", "Aus Ames, 1850", "", "authority")]
    for name, rows in (("nodes", [line("7", "1", "genus")]), ("names", names), ("merged", [line("8", "7")])):
        (tmp_path / f"{name}.dmp").write_text("\n".join(rows) + "\n")
    nodes, read, merged = readers.read_ncbi(spark, str(tmp_path))
    found = {(r.name_txt, r.spin) for r in ncbi.dedupe_names(read).filter("name_class = 'synonym'").collect()}
    assert len(found) == 2 and len({spin for _, spin in found}) == 2
    out = ncbi.ncbi_to_dwc(nodes, read, merged).collect()
    assert [r.scientificName for r in out if r.taxonID == "7"] == ["Aus Ames, 1850"]
    assert sorted(r.canonicalName for r in out if r.nomenclaturalStatus is None and r.taxonomicStatus == "synonym") == ["Aus n85730", "Aus n86026"]


def _write_parts(path, text, n):
    """One file of a folder, so that a small split size cuts it anywhere."""
    path.mkdir()
    (path / "part.csv").write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("size", [64, 257, 4096])
def test_quoted_records_read_in_splits(spark, tmp_path, size):
    """Every kind of line against Python's reader, whatever the splits."""
    import csv
    import io
    import random

    rnd = random.Random(size)
    values = ["plain", "", "a,b", 'say "hi"', "two\nlines", '\n\n"', '"', '""', ',"\n,', "x" * 90, 'end"\n', "\n", 'a""b\n"c",', " blank "]
    rows = [[str(i), rnd.choice(values), rnd.choice(values)] for i in range(300)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["taxonID", "scientificName", "source"], *rows])
    path = _write_parts(tmp_path / "in.csv", out.getvalue(), size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = readers.read_checklist(spark, path)
        assert sorted(tuple(r) for r in df.drop("_ord").collect()) == sorted(map(tuple, rows))
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        assert [r.taxonID for r in df.orderBy("_ord").collect()] == [r[0] for r in rows]
        counts = readers.ragged_quoted(spark, path).first()
        assert (counts.trimmed, counts.short) == (0, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_records_of_several_files_and_ragged_ones(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('taxonID,scientificName\n1,"x\ny"\n2,p,more\n3\n', newline="")
    (folder / "b.csv").write_text('taxonID,scientificName\r\n4,"u\r\nv"\r\n5,"w"\r\n', newline="")
    df = readers.read_checklist(spark, str(folder))
    assert sorted((r.taxonID, r.scientificName) for r in df.collect()) == [("1", "x\ny"), ("2", "p"), ("3", ""), ("4", "u\r\nv"), ("5", "w")]
    counts = readers.ragged_quoted(spark, str(folder)).first()
    assert (counts.trimmed, counts.short) == (1, 1)


def test_counters_are_observed_in_one_pass(spark):
    from pyspark.sql import Observation

    rows = [(0, "", "", "", "a", "Aus bus  Gray"), (1, "k", "k", "p", "a", "Aus"), (2, "m", "n", "p", "a", "Bus"), (3, "o", "", "", "senior synonym", "Cus and Dus")]
    df = spark.createDataFrame(rows, "_ord bigint, taxonID string, acceptedNameUsageID string, parentNameUsageID string, taxonomicStatus string, scientificName string")
    seen = Observation("c")
    out = C.clean(df, managed="x:taxonID", observation=seen)
    assert out.count() == 3 and "_senior" not in out.columns
    assert seen.get == {"records": 3, "senior": 1, "minted": 1, "normalized": 2, "cleaned": 1, "managed": 3}


def test_compat_keys_hash_the_row_as_read(spark):
    import hashlib

    df = spark.createDataFrame([(0, "", "Aus  bus", "x,y"), (1, "k", "Cus", "z")], "_ord bigint, taxonID string, scientificName string, source string")
    out = {r.scientificName: r.taxonID for r in C.clean(df, compat=True).collect()}
    assert out == {"Aus bus": hashlib.sha1("^".join("^Aus  bus^x,y").encode()).hexdigest()[:8], "Cus": "k"}


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    """Two runs over growing input with one checkpoint give what a batch gives, each row once."""
    from taxalign.streaming.prepare import write_prepared

    schema = "taxonID string, scientificName string, canonicalName string"
    rows = [(str(i), f"Aus {'abcde'[i % 5]}us Gray, 18{i:02d}" if i % 3 else "", "") for i in range(60)]
    table = spark.createDataFrame([("Aus aus Gray, 1800", "Aus aii", "Aus ai", "Gray", "1")] + [
        (s, "Aus b", "Aus b", "Gray", "1") for _, s, _ in rows if "bus" in s], "Verbatim string, CanonicalFull string, CanonicalStem string, Authorship string, Quality string")
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        write_prepared(prepare_stream(stream, parsed=table), out, progress).awaitTermination(120)

    spark.createDataFrame(rows[:30], schema).repartition(2).write.json(source)
    run()
    half = spark.read.parquet(out).count()
    spark.createDataFrame(rows[30:], schema).repartition(2).write.mode("append").json(source)
    run()
    got = spark.read.parquet(out)
    want = prepare_stream(spark.createDataFrame(rows, schema), parsed=table)
    columns = ["taxonID", "name_to_parse", "gn_canonical_full", "parts"]
    assert half == 30 and sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_nested_text(spark):
    from taxalign.operators import nested

    texts = {"a": "(Bus b,Cus c*,(Dus d e)Eus)Aus", "b": "Solo", "c": "((x,y)z)", "d": "(,(,)q,)r"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {}
    for r in nested.read_nested(df, "k", "t").collect():
        got.setdefault(r.k, []).append((int(r.taxonID), r.canonicalName, r.parentNameUsageID, r.acceptedNameUsageID, r.taxonRank))
    assert sorted(got["a"]) == [(1, "Aus", "", "", ""), (2, "Bus b", "1", "", "species"), (3, "Cus c", "", "1", "species"),
                                (4, "Eus", "1", "", ""), (5, "Dus d e", "4", "", "subspecies")]
    assert got["b"] == [(1, "Solo", "", "", "")]
    assert sorted(got["c"]) == [(1, "", "", "", ""), (2, "z", "1", "", ""), (3, "x", "2", "", ""), (4, "y", "2", "", "")]
    assert sorted(x[:3] for x in got["d"]) == [(1, "r", ""), (2, "", "1"), (3, "q", "1"), (4, "", "3"), (5, "", "3"), (6, "", "1")]
    bad = spark.createDataFrame([("x", "(a"), ("y", "a)b"), ("z", "(a)b")], "k string, t string")
    assert sorted(r.k for r in nested.unbalanced(bad, "k", "t").collect()) == ["x", "y"]
