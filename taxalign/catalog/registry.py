"""Every registered query: its Spark form and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .. import fixtures as fx
from ..functions import homotypy as H, names as N, rcc5
from ..functions.ranks import rank_number
from ..operators import (articulations as art, changes, clean as C, diff, match as M, merge, names as NM, ncbi, nested,
                         report, table as TB, theory as TH, tree as T)
from ..plans import prepare as P
from ..plans.align import Alignment
from ..sources import readers, writers
from ..streaming import prepare as streaming
from ..staging import has_staged, new_path, stage
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_runs: dict[tuple, object] = {}


def forget() -> None:
    """Drop remembered runs, so that the next query starts from the tables."""
    _runs.clear()


def _once(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if not has_staged(spark):
        forget()  # the folder was emptied behind our back
    if key not in _runs:
        _runs[key] = build()
    return _runs[key]


def star(spark: SparkSession, sf_dir: str) -> Alignment:
    """Alignment of the checklists from region, nation and customer."""
    return _once(spark, sf_dir, "star", lambda: Alignment(fx.checklist_a(spark, sf_dir), fx.checklist_b(spark, sf_dir)))


def homonym(spark: SparkSession, sf_dir: str) -> Alignment:
    """Alignment of the checklists from part, whose names repeat."""
    return _once(spark, sf_dir, "homonym", lambda: Alignment(fx.homonyms(spark, sf_dir, "A"), fx.homonyms(spark, sf_dir, "B")))


def guessed(spark: SparkSession, sf_dir: str) -> Alignment:
    """Alignment by version 8 of the checklists whose names have unknown parts."""
    return _once(spark, sf_dir, "guessed", lambda: Alignment(fx.guessed(spark, sf_dir, "A"), fx.guessed(spark, sf_dir, "B"), version=8))


def tangled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identified rows of the faulty checklist, with parsed names."""
    return _once(spark, sf_dir, "tangled rows", lambda: stage(NM.parse_names(T.identify(fx.tangled(spark, sf_dir))), "rows"))


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table of the faulty checklist."""
    return _once(spark, sf_dir, "tangled", lambda: T.build_forest(tangled_rows(spark, sf_dir)))


def query(name: str, select: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if select is not None:
            SQL[name] = O.query(select)
        return fn
    return add


_ROW = "taxonID, parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, canonicalName, scientificNameAuthorship, scientificName"
_ROWS = [c.strip() for c in _ROW.split(",")]


def _ids(df: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Replace nid columns by taxon ids: new name -> nid column."""
    names = nodes.select("nid", "taxonID")
    for new, old in columns.items():
        df = df.join(names.toDF(old, new), old, "left").drop(old)
    return df


# -- sources, sinks, tables -------------------------------------------------------------------


@query("checklist_csv_round_trip", f"select {_ROW} from x_a")
def _(spark, d):
    path = new_path(spark, "checklist") + ".csv"
    a = fx.checklist_a(spark, d)
    writers.write_csv(a.withColumnsRenamed({c: "dwc:" + c for c in _ROWS}), path)
    return readers.read_checklist(spark, path).select(*_ROWS)


@query("quoted_line_breaks", "select cast(doc_id as varchar) doc_id, coalesce(text, '') text, coalesce(source, '') source from documents")
def _(spark, d):
    path = new_path(spark, "texts") + ".csv"
    writers.write_csv(fx.table(spark, d, "documents").select("doc_id", "text", "source"), path)
    return readers.read_checklist(spark, path).drop("_ord")


def _ragged(spark: SparkSession, d: str, sep: str) -> str:
    """A file in which some customers have a field too many or too few, and some a line break in a value."""
    k = F.col("c_custkey")
    quoted = F.when(k % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('\n""x"", y"'))).otherwise(F.col("c_name")) if sep == "," else F.col("c_name")
    cells = F.when(k % 7 == 0, F.array(k.cast("string"), quoted, F.lit("s"), F.lit("more"))).when(
        k % 11 == 0, F.array(k.cast("string"), quoted)).otherwise(F.array(k.cast("string"), quoted, F.lit("s")))
    rows = fx.table(spark, d, "customer").orderBy("c_custkey").select(F.array_join(cells, sep).alias("value"))
    path = new_path(spark, "ragged") + (".csv" if sep == "," else ".tsv")
    head = sep.join(("taxonID", "scientificName", "source"))
    # every part file begins with the header
    parts = rows.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    heads = parts.select("_p").distinct().select(F.lit(head).alias("value"), "_p", F.lit(-1).cast("long").alias("_n"))
    parts.unionByName(heads).repartition("_p").sortWithinPartitions("_p", "_n").drop("_n").write.partitionBy("_p").text(path)
    return path


_RAGGED_NAME = "case when c_custkey % 5 = 0 then c_name || chr(10) || '\"x\", y' else c_name end"


@query("ragged_checklist", f"select cast(c_custkey as varchar) taxonID, {_RAGGED_NAME} scientificName, case when c_custkey % 7 <> 0 and c_custkey % 11 = 0 then '' else 's' end source from customer")
def _(spark, d):
    return readers.read_checklist(spark, _ragged(spark, d, ",") + "/_p=*").select("taxonID", "scientificName", "source")


@query("ragged_counts", "select kind, count(*) filter (c_custkey % 7 = 0) trimmed, count(*) filter (c_custkey % 7 <> 0 and c_custkey % 11 = 0) short from customer, (values ('csv'), ('tsv')) t(kind) group by kind")
def _(spark, d):
    counts = readers.ragged_quoted(spark, _ragged(spark, d, ",") + "/_p=*").withColumn("kind", F.lit("csv"))
    return counts.unionByName(readers.ragged_counts(spark, _ragged(spark, d, "\t") + "/_p=*").withColumn("kind", F.lit("tsv")))


@query("scatter_rows", f"select taxonRank, {', '.join(c for c in _ROWS if c != 'taxonRank')} from x_a")
def _(spark, d):
    dest = new_path(spark, "scatter")
    writers.scatter(fx.checklist_a(spark, d).drop("_ord"), dest, "taxonRank")
    return C.fill_missing(spark.read.csv(dest, header=True, quote='"', escape='"')).select(*_ROWS)


@query("scatter_by_rank", "select taxonRank, count(*) n from x_a group by taxonRank")
def _(spark, d):
    return writers.scatter(fx.checklist_a(spark, d), new_path(spark, "scatter"), "taxonRank")


@query("exemplar_file", """select e.exemplar_id "exemplar id", l.epithet, e.side checklist, t.taxonID, t.canonicalName
 from s_ex e join s_label l on l.exemplar_id = e.exemplar_id join s_tree t on t.nid = e.nid where e.exemplar_id >= 0""")
def _(spark, d):
    al = star(spark, d)
    return M.exemplar_table(al.exemplars, al.theory.lookup, al.nodes)


@query("project_columns", "select taxonRank, taxonID from x_a")
def _(spark, d):
    return TB.project(fx.checklist_a(spark, d), ["taxonRank", "colour", "taxonID", "scientificName"], ["scientificName"])


@query("sort_rows", f"select {_ROW} from x_a order by taxonRank, canonicalName, taxonID")
def _(spark, d):
    return TB.sort_rows(fx.checklist_a(spark, d).drop("_ord"), ["taxonRank", "canonicalName"])


@query("conform_columns", "select '' managed_id, scientificName, taxonID from x_b")
def _(spark, d):
    return TB.conform(fx.checklist_b(spark, d), ["managed_id", "scientificName", "taxonID"])


@query("stable_hash", "select taxonID, substr(sha1(taxonID || '^' || scientificName || '^' || taxonRank), 1, 8) h from x_a")
def _(spark, d):
    return fx.checklist_a(spark, d).select("taxonID", TB.stable_hash("taxonID", "scientificName", "taxonRank").alias("h"))


def _given_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Exemplar rows from the keys two customers share, with extra ids that tie neighbours."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    row = lambda side, taxon, sid: F.struct(F.lit(side).alias("checklist"), taxon.alias("taxonID"), sid.alias("exemplar id"))
    rows = c.select(F.inline(F.array(
        row("A", F.concat(F.lit("S"), "k"), F.col("k")), row("1", F.concat(F.lit("bS"), "k"), F.col("k")),
        row("A", F.concat(F.lit("S"), F.col("k") + 1), F.when(F.col("k") % 10 == 3, F.col("k"))))))
    return rows.filter("`exemplar id` is not null")


_GIVEN = """with g as (select 'A' side, 'S' || c_custkey taxonID, c_custkey sid from customer union select 'B', 'bS' || c_custkey, c_custkey from customer
  union select 'A', 'S' || (c_custkey + 1), c_custkey from customer where c_custkey % 10 = 3)"""
O.define("x_given", _GIVEN.replace("with g as (", "").rstrip()[:-1])
O.define("x_known", "select g.* from x_given g join s_all t on t.side = g.side and t.taxonID = g.taxonID")
O.define("x_gcomp", """select sid, sid other from x_known union select c.sid, b.sid from x_gcomp c
  join x_known a on a.sid = c.other join x_known b on b.side = a.side and b.taxonID = a.taxonID""")
O.define("x_gmin", "select sid, min(other) exemplar_id from x_gcomp group by sid")


@query("given_exemplars", """select distinct m.exemplar_id, k.side, k.taxonID from x_known k join x_gmin m on m.sid = k.sid where m.exemplar_id in (
  select m2.exemplar_id from x_known k2 join x_gmin m2 on m2.sid = k2.sid group by 1 having count(distinct k2.side) = 2)
  union all select -1, 'A', '⊤' union all select -1, 'B', '⊤'""")
def _(spark, d):
    al = star(spark, d)
    return _ids(M.read_exemplars(_given_exemplars(spark, d), al.nodes), al.nodes, taxonID="nid")


@query("unknown_exemplars", "select g.* from x_given g where not exists (select 1 from s_all t where t.side = g.side and t.taxonID = g.taxonID)")
def _(spark, d):
    return M.unknown_exemplars(_given_exemplars(spark, d), star(spark, d).nodes)


# -- cleaning ---------------------------------------------------------------------------------

O.define("x_raw0", """select *, _ord % 1000000000000 k, split_part(canonicalName, ' ', 1) g, regexp_replace(canonicalName, '^[^ ]+ ', '') rest,
  contains(canonicalName, ' ') two, taxonRank = 'species' spc, scientificNameAuthorship au from x_a""")
O.define("x_raw1", """select *, case when two and k % 6 = 0 then g || ' (' || g || ') ' || rest when two and k % 6 = 1 then g || '  ' || rest else canonicalName end nm,
  case when au = '' then '' when k % 5 = 0 then '(' || au || ').' when k % 5 = 1 then 'Gray and ' || au when k % 5 = 2 then replace(au, ', ', ' ,, ') else au end sp from x_raw0""")
O.define("x_raw", """select _ord, case when k % 29 = 4 then '' when spc and k % 31 = 7 then 'S' || (k - 1) else taxonID end taxonID,
  parentNameUsageID, case when k % 8 = 0 then taxonID when spc and k % 8 = 1 then 'S' || (k + 1) else '' end acceptedNameUsageID,
  taxonRank, case when k % 23 = 5 then 'senior synonym' when k % 8 = 1 then 'synonym' when k % 8 = 2 then 'Dubious'
    when k % 8 = 3 then 'provisionally accepted' when k % 8 = 4 then 'unplaced' else 'accepted' end taxonomicStatus,
  case when k % 9 < 6 then nm || ' ' || sp else '' end scientificName, case when k % 9 <> 2 then nm else '' end canonicalName,
  case when k % 4 < 3 then sp else '' end scientificNameAuthorship, case when k % 13 = 0 then '' else cast(k % 6 as varchar) end landmark_status,
  'src' || (k % 3) || ',old' || (k % 5) source from x_raw1""")
O.define("x_norm", """select * replace (case when acceptedNameUsageID = taxonID then '' else acceptedNameUsageID end as acceptedNameUsageID,
  case when acceptedNameUsageID <> '' and acceptedNameUsageID <> taxonID then '' else parentNameUsageID end as parentNameUsageID)
  from x_raw where taxonomicStatus <> 'senior synonym'""")
O.define("x_nm1", r"""select *, regexp_replace(trim(scientificName), ' \(\p{Lu}\p{L}+\) ', ' ') s, regexp_replace(trim(canonicalName), ' \(\p{Lu}\p{L}+\) ', ' ') c,
  trim(scientificNameAuthorship) a from x_norm""")
O.define("x_nm2", """select *, case when s <> '' then s when c <> '' and a <> '' then c || ' ' || a else c end s1,
  case when s <> '' and c = '' and a <> '' and ends_with(s, a) then trim(substr(s, 1, length(s) - length(a))) else c end c1,
  case when s <> '' and a = '' and c <> '' and starts_with(s, c) then trim(substr(s, length(c) + 1)) else a end a1 from x_nm1""")
O.define("x_nm3", r"""select *, replace(replace(replace(replace(s1, ' and ', ' & '), ',,', ','), '  ', ' '), ' *', ' ') s2, trim(replace(a1, ' ,', ',')) a2 from x_nm2""")
O.define("x_names", r"""select * replace (
  regexp_replace(replace(case when ends_with(s2, ').') then substr(s2, 1, length(s2) - 1) else s2 end, ' ,', ','),
     '^(\p{Lu}[\p{Ll}-]+) \(\p{Lu}[\p{Ll}-]+\) ([\p{Ll}-]+)', '\1 \2') as scientificName, c1 as canonicalName,
  case when ends_with(a2, ').') then substr(a2, 1, length(a2) - 1) else a2 end as scientificNameAuthorship) from x_nm3""")
_CLEAN = """parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, scientificName, canonicalName, scientificNameAuthorship"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_missing(C.normalize_headers(fx.raw_rows(spark, d)))


@query("clean_headers", f"select taxonID, {_CLEAN}, landmark_status, source from x_raw")
def _(spark, d):
    return _raw(spark, d).drop("_ord")


@query("drop_senior_synonyms", "select taxonID, taxonomicStatus from x_raw where taxonomicStatus <> 'senior synonym'")
def _(spark, d):
    return C.drop_senior_synonyms(_raw(spark, d)).select("taxonID", "taxonomicStatus")


@query("normalize_accepted", "select taxonID, acceptedNameUsageID, parentNameUsageID from x_norm")
def _(spark, d):
    return C.normalize_accepted(C.drop_senior_synonyms(_raw(spark, d))).select("taxonID", "acceptedNameUsageID", "parentNameUsageID")


@query("status_conflicts", """select taxonID, acceptedNameUsageID, taxonomicStatus from x_norm where (acceptedNameUsageID in ('', taxonID)) <>
  (regexp_matches(lower(taxonomicStatus), '^(accepted|valid|dubious)') or ends_with(lower(taxonomicStatus), 'accepted'))""")
def _(spark, d):
    return C.status_conflicts(C.normalize_accepted(C.drop_senior_synonyms(_raw(spark, d))))


@query("recode_landmark", """select taxonID, case landmark_status when '1' then 'minimal' when '2' then 'abbreviated' when '3' then 'extended' when '4' then 'full' else '' end landmark_status,
  split_part(source, ',', 1) source from x_raw""")
def _(spark, d):
    return _raw(spark, d).select("taxonID", C.recode_landmark(F.col("landmark_status")).alias("landmark_status"), C.first_source(F.col("source")).alias("source"))


@query("clean_names", "select taxonID, scientificName, canonicalName, scientificNameAuthorship from x_names")
def _(spark, d):
    rows = C.clean_names(C.drop_senior_synonyms(_raw(spark, d)))
    return rows.select("taxonID", "scientificName", "canonicalName", "scientificNameAuthorship")


@query("remove_subgenus", r"""select taxonID, regexp_replace(scientificName, '^(\p{Lu}[\p{Ll}-]+) \(\p{Lu}[\p{Ll}-]+\) ([\p{Ll}-]+)', '\1 \2') scientificName,
  case when ends_with(trim(scientificNameAuthorship), ').') then rtrim(trim(scientificNameAuthorship), '.') else trim(scientificNameAuthorship) end author from x_raw""")
def _(spark, d):
    return _raw(spark, d).select("taxonID", C.remove_subgenus(F.col("scientificName")).alias("scientificName"),
                                 C.tidy_authorship(F.col("scientificNameAuthorship")).alias("author"))


@query("duplicate_keys", "select taxonID, count(*) n from x_raw where taxonID <> '' group by taxonID having count(*) > 1")
def _(spark, d):
    return C.duplicate_keys(_raw(spark, d))


_MINT = """case when taxonID = '' or again then h || case when n > 1 then '.' || n else '' end else taxonID end taxonID"""


def _minted(source: str, text: str) -> str:
    return f"""select *, row_number() over (partition by h, taxonID = '' or again order by _ord) n from (
  select *, substr(sha1({text}), 1, 16) h, taxonID <> '' and row_number() over (partition by taxonID order by _ord) > 1 again from {source})"""


O.define("x_mint", _minted("x_few", "taxonID || '^' || canonicalName"))
O.define("x_few", "select _ord, taxonID, split_part(canonicalName, ' ', 1) canonicalName from x_raw")
O.define("x_clean", _minted(
    "(select _ord, taxonID, parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, scientificName, canonicalName, scientificNameAuthorship, "
    "case landmark_status when '1' then 'minimal' when '2' then 'abbreviated' when '3' then 'extended' when '4' then 'full' else '' end landmark_status, "
    "split_part(source, ',', 1) source, case when taxonID <> '' then 'test:' || taxonID else '' end managed_id from x_names)",
    "concat_ws('^', taxonID, parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, scientificName, canonicalName, "
    "scientificNameAuthorship, landmark_status, source, managed_id)"))


@query("mint_keys", f"select {_MINT}, canonicalName from x_mint")
def _(spark, d):
    few = _raw(spark, d).select("_ord", "taxonID", F.split("canonicalName", " ")[0].alias("canonicalName"))
    return C.mint_keys(few).drop("_ord")


@query("managed_ids", "select taxonID, case when taxonID <> '' then 'test:' || taxonID else '' end managed_id from x_raw")
def _(spark, d):
    return C.add_managed_id(_raw(spark, d), "test", "taxonID").select("taxonID", "managed_id")


@query("long_fields", """select 'D' || doc_id taxonID, 'text' field, length(text) chars from documents where length(text) > 10000""")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("taxonID"), "text", "source")
    return C.long_fields(docs)


@query("clean_metrics", """select count(*) filter (not sen) records, count(*) filter (sen) senior, count(*) filter (not sen and taxonID = '') blank_keys,
  count(*) filter (not sen and (acceptedNameUsageID <> '' and (acceptedNameUsageID = taxonID or parentNameUsageID <> ''))) normalized
  from (select *, taxonomicStatus = 'senior synonym' sen from x_raw)""")
def _(spark, d):
    return C.clean_metrics(_raw(spark, d))


@query("clean_checklist", f"select {_MINT}, {_CLEAN}, landmark_status, source, managed_id from x_clean")
def _(spark, d):
    return C.clean(fx.raw_rows(spark, d), managed="test:taxonID").drop("_ord")


O.define("x_compat", """select *, substr(sha1(array_to_string(string_split(concat_ws('^', taxonID, parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, scientificName,
   canonicalName, scientificNameAuthorship, landmark_status, source), ''), '^')), 1, 8) h, taxonID <> '' and row_number() over (partition by taxonID order by _ord) > 1 again from x_norm""")


@query("mint_keys_compat", "select case when taxonID = '' or again then h else taxonID end taxonID, taxonRank, source0 source from (select *, split_part(source, ',', 1) source0 from x_compat)")
def _(spark, d):
    return C.clean(fx.raw_rows(spark, d), compat=True).select("taxonID", "taxonRank", "source")


@query("clean_counters", """select count(*) filter (not sen) records, count(*) filter (sen) senior, count(*) filter (not sen and taxonID = '') minted,
  count(*) filter (not sen and acceptedNameUsageID <> '' and (acceptedNameUsageID = taxonID or parentNameUsageID <> '')) normalized, count(*) filter (not sen and edited) cleaned,
  count(*) filter (not sen) managed from (select r.*, r.taxonomicStatus = 'senior synonym' sen,
    n.scientificName <> r.scientificName or n.canonicalName <> r.canonicalName or n.scientificNameAuthorship <> r.scientificNameAuthorship edited from x_raw r left join x_names n on n._ord = r._ord)""")
def _(spark, d):
    seen = Observation("cleaning")
    C.clean(fx.raw_rows(spark, d), managed="test:taxonID", observation=seen)
    return spark.createDataFrame([seen.get], ", ".join(f"{name} long" for name in C.clean_counters()))


# -- names ------------------------------------------------------------------------------------

_Y = "(1750 + k % 260)"
O.define("x_var0", f"select k, k % 16 i, {O.segname('seg')} g, {O.letters('k')} e, cast({_Y} as varchar) y from x_cust")
O.define("x_var1", """select *, g || ' ' || e base, k % 3 = 0 or i = 14 hc, k % 4 < 2 ha, k % 5 = 2 and i not in (4, 12) hg from x_var0""")
O.define("x_var2", """select *, case i when 0 then base || ' (Smith, ' || y || ')' when 1 then base || ' J. R. Miller & Jones, ' || y when 2 then base || ' Someone, 1111'
   when 3 then base || ' × ' || g || ' minor' when 4 then '? ' || e || ' Gray, ' || y when 5 then base || '  ' || e || ' Gray, (' || y || ')' when 6 then g
   when 7 then base || ' Li, ' || y when 8 then base || ' [sic] Weber sensu Daniel, 1884' when 9 then base || ' Fitz-Gibbon in O''Neil, ' || y || '.'
   when 10 then g || ' (' || g || ') ' || e when 11 then base || ' Linnaeus, ' || y || ' (Gervais, 1847)' when 12 then g || ' ?'
   when 13 then base || ' minor major Thomas ' || y when 14 then '' else base || ' de Winton, ' || y end sci,
  case when not hg then '' when i = 3 then base || ' × ' || g || ' minor' when i = 13 then base || ' minor' when i = 6 then g else base end gf from x_var1""")
O.define("x_var", """select k _ord, 'V' || k taxonID, sci scientificName, case when hc then base else '' end canonicalName,
  case when not ha then '' when k % 7 = 0 then 'Brown, ' || y || '. ' when k % 7 = 1 then '(A. Brown, ' || y || ')' when k % 7 = 2 then 'Brown, 1895 (Gervais, ' || y || ')' else 'Brown, ' || y end scientificNameAuthorship,
  case k % 11 when 0 then 'species' when 1 then 'subspecies' else '' end taxonRank, case when k % 17 = 3 then 'common name' else '' end nomenclaturalStatus,
  case when k % 2 = 0 then g else '' end genericName, case when k % 2 = 0 then e else '' end specificEpithet, case when k % 2 = 0 then e else '' end infraspecificEpithet,
  gf gn_canonical_full, case when contains(gf, ' ') then substr(gf, 1, length(gf) - 1) else gf end gn_canonical_stem,
  case when hg and k % 2 = 0 then 'Brown ' || y else '' end gn_authorship from x_var2""")
O.parse("x_parts", "x_var", gn=True)
O.define("x_ext1", r"""select *, case when scientificName <> '' then scientificName when canonicalName <> '' then canonicalName
   when genericName = '' and specificEpithet = '' then '' when taxonRank = 'species' then genericName || ' ' || specificEpithet
   when taxonRank = 'subspecies' then genericName || ' ' || specificEpithet || ' ' || infraspecificEpithet else '' end n0 from x_var""")
O.define("x_ext2", r"""select *, replace(case when contains(nomenclaturalStatus, 'common') then '' when n0 <> '' and not regexp_matches(scientificName, '\b([12][0-9]{3})\b')
   and regexp_matches(scientificNameAuthorship, '\b([12][0-9]{3})\b') and regexp_matches(substr(scientificNameAuthorship, 1, 2), '\p{Lu}') then n0 || ' ' || scientificNameAuthorship else n0 end, ' [sic]', '') n1 from x_ext1""")
O.define("x_ext3", "select *, case when contains(n1, ' sensu ') then substr(n1, 1, instr(n1, ' sensu ') - 1) else n1 end n2 from x_ext2")
O.define("x_ext", "select *, replace(case when starts_with(n2, '? ') or n2 = '?' then 'Xyzzy' || substr(n2, 2) else n2 end, '?', 'xyzzy') name_to_parse from x_ext3")


@query("extract_names", "select taxonID, name_to_parse from x_ext")
def _(spark, d):
    return NM.extract_names(fx.varied_names(spark, d)).select("taxonID", "name_to_parse")


def _parser_output(spark: SparkSession, d: str) -> DataFrame:
    """What a parser could say about four lines in five."""
    lines = NM.extract_names(fx.varied_names(spark, d)).filter("_ord % 5 <> 0")
    words = F.split("name_to_parse", " ")
    full = F.when(F.size(words) > 1, F.concat(words[0], F.lit(" "), F.get(words, F.lit(1)), F.when(F.col("_ord") % 3 == 0, "ii").otherwise("")))
    full = F.when(F.col("_ord") % 10 == 4, "").otherwise(F.coalesce(full, words[0]))
    return lines.select("_ord", F.col("name_to_parse").alias("Verbatim"), full.alias("CanonicalFull"),
                        F.when(full.endswith("ii"), F.substring(full, F.lit(1), F.length(full) - 1)).otherwise(full).alias("CanonicalStem"),
                        F.lit("Auth").alias("Authorship"), (F.col("_ord") % 5).cast("string").alias("Quality"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    # one row per line, as the same line always parses the same
    table = _parser_output(spark, d)
    one = table.groupBy("Verbatim").agg(*[F.min_by(c, "_ord").alias(c) for c in ("CanonicalFull", "CanonicalStem", "Authorship", "Quality")])
    rows = fx.varied_names(spark, d).drop("gn_canonical_full", "gn_canonical_stem", "gn_authorship")
    return NM.join_gnparse(rows, one)


O.define("x_gn0", """select _ord, name_to_parse vb, string_split(name_to_parse, ' ') ws from x_ext where _ord % 5 <> 0""")
O.define("x_gn1", """select *, case when _ord % 10 = 4 then '' when len(ws) > 1 then ws[1] || ' ' || ws[2] || case when _ord % 3 = 0 then 'ii' else '' end else ws[1] end f from x_gn0""")
O.define("x_gn", """select vb, arg_min(f, _ord) f, arg_min(case when ends_with(f, 'ii') then substr(f, 1, length(f) - 1) else f end, _ord) s, arg_min(cast(_ord % 5 as varchar), _ord) q from x_gn1 group by vb""")
_FIX = "replace(regexp_replace(coalesce({0}, ''), '^Xyzzy', '?'), 'xyzzy', '?')"
O.define("x_prep0", f"""select e.*, {_FIX.format('g.f')} full_, {_FIX.format('g.s')} stem_, {_FIX.format('g.vb')} vb_, case when g.vb is null then '' else 'Auth' end auth_, g.q
  from x_ext e left join x_gn g on g.vb = e.name_to_parse and e.name_to_parse <> ''""")
O.define("x_prep", """select taxonID, case when canonicalName = '' then full_ else canonicalName end canonicalName, case when scientificName = '' then vb_ else scientificName end scientificName,
  full_ gn_canonical_full, case when ends_with(full_, 'ii') and ends_with(stem_, 'i') then substr(stem_, 1, length(stem_) - 1) else stem_ end gn_canonical_stem, auth_ gn_authorship, q gn_quality from x_prep0""")


@query("join_parser_output", "select * from x_prep")
def _(spark, d):
    return _prepared(spark, d).select("taxonID", "canonicalName", "scientificName", "gn_canonical_full", "gn_canonical_stem", "gn_authorship", "gn_quality")


@query("prepared_from_file", """select p.taxonID, p.gn_canonical_full, p.gn_canonical_stem, p.gn_authorship, p.gn_quality from x_prep p""")
def _(spark, d):
    rows = fx.varied_names(spark, d).drop("gn_canonical_full", "gn_canonical_stem", "gn_authorship")
    lines, path = new_path(spark, "lines"), new_path(spark, "parsed") + ".csv"
    P.hand_over(rows, lines)
    given = spark.read.text(lines).withColumnRenamed("value", "Verbatim")
    # the parser's file: one row for each line that it was given and could read
    said = _parser_output(spark, d)
    one = said.groupBy("Verbatim").agg(*[F.min_by(c, "_ord").alias(c) for c in ("CanonicalFull", "CanonicalStem", "Authorship", "Quality")])
    blank = F.lit("")
    table = given.join(one, "Verbatim").select(
        F.sha1("Verbatim").alias("Id"), "Verbatim", F.size(F.split("CanonicalFull", " ")).alias("Cardinality"), "CanonicalStem",
        F.col("CanonicalFull").alias("CanonicalSimple"), "CanonicalFull", "Authorship", blank.alias("Year"), "Quality")
    writers.write_csv(table, path)
    out = P.prepare_from_file(spark, rows, path)
    return out.select("taxonID", "gn_canonical_full", "gn_canonical_stem", "gn_authorship", "gn_quality")


@query("rejected_names", "select taxonID, scientificName, gn_quality from x_prep where gn_canonical_full = '' or gn_canonical_stem = ''")
def _(spark, d):
    return NM.rejected_names(_prepared(spark, d))


@query("split_names", r"""select taxonID, nullif(trim(case when ends_with(s, ')') and contains(s, '(') then substr(s, 1, instr(s, '(') - 1)
   when x <> '' then regexp_extract(s, '^(.+?) (\(?\p{Lu}[\p{L}.''-]+.*)$', 1) else s end), '') canonical,
  nullif(trim(case when ends_with(s, ')') and contains(s, '(') then substr(s, instr(s, '(')) else x end), '') authorship
  from (select taxonID, scientificName s, regexp_extract(scientificName, '^(.+?) (\(?\p{Lu}[\p{L}.''-]+.*)$', 2) x from x_var)""")
def _(spark, d):
    cut = N.split_name(F.col("scientificName"))
    return fx.varied_names(spark, d).select("taxonID", *[c.alias(n) for n, c in cut.items()])


@query("authorship_parts", "select taxonID, z_token token, z_year \"year\", z_protonymp protonymp from (" + O.nest(O.authorship("x_var", "scientificNameAuthorship", "z_")) + ")")
def _(spark, d):
    out = N.analyze_authorship(fx.varied_names(spark, d), "scientificNameAuthorship", "z_")
    return out.select("taxonID", F.col("z_token").alias("token"), F.col("z_year").alias("year"), F.col("z_protonymp").alias("protonymp"))


_PART = "genus middle epithet token year protonymp canonical".split()


def _flat(parts: str = "parts") -> list[Column]:
    return [F.col(f"{parts}.{c}").alias(c) for c in [*_PART, "scientific", "authorship"]]


@query("parse_names", "select taxonID, " + ", ".join(f'p_{c} "{c}"' for c in _PART) + ", v scientific, used authorship from x_parts")
def _(spark, d):
    return NM.parse_names(fx.varied_names(spark, d)).select("taxonID", *_flat())


@query("recovered_canonicals", "select taxonID, p_genus genus, p_middle middle, p_epithet epithet, p_canonical canonical, how = 'stem' stemmed from x_parts where gfull is not null")
def _(spark, d):
    rows = NM.parse_names(fx.varied_names(spark, d)).filter("gn_canonical_full <> ''")
    own = F.coalesce(N.known(F.trim("canonicalName")), N.split_name(F.col("parts.scientific"))["canonical"])
    ill = F.col("scientificNameAuthorship").endswith(")") & ~F.col("scientificNameAuthorship").startswith("(")
    own = F.when(ill | (F.col("canonicalName") == ""), N.split_name(F.col("parts.scientific"))["canonical"]).otherwise(own)
    full = F.col("gn_canonical_full")
    kept = own.isNull() | (F.size(F.split(full, " ")) >= F.size(F.split(own, " ")))
    return rows.select("taxonID", *[F.col("parts." + c).alias(c) for c in ("genus", "middle", "epithet", "canonical")],
                       (N.is_polynomial(full) & kept).alias("stemmed"))


# the stream cleans names before it reads them
for _old, _new, _from in (("x_nm1", "x_sn1", ("x_norm", "x_var")), ("x_nm2", "x_sn2", ("x_nm1", "x_sn1")), ("x_nm3", "x_sn3", ("x_nm2", "x_sn2")), ("x_names", "x_sn", ("x_nm3", "x_sn3")),
                         ("x_ext1", "x_sx1", ("x_var", "x_sn")), ("x_ext2", "x_sx2", ("x_ext1", "x_sx1")), ("x_ext3", "x_sx3", ("x_ext2", "x_sx2")), ("x_ext", "x_sx", ("x_ext3", "x_sx3"))):
    O.define(_new, O.PARTS[_old].replace(f"from {_from[0]}", f"from {_from[1]}"))
O.parse("x_sp", "x_sn", gn=True)


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a stream of files."""
    source, customers = new_path(spark, "arriving"), fx.table(spark, d, "customer")
    customers.repartition(4, "c_custkey").write.parquet(source)
    return spark.readStream.schema(customers.schema).option("maxFilesPerTrigger", 2).parquet(source)


@query("prepare_stream", "select e.taxonID, e.name_to_parse, " + ", ".join(f'p.p_{c} "{c}"' for c in _PART) + " from x_sx e join x_sp p on p._ord = e._ord")
def _(spark, d):
    stream = streaming.prepare_stream(fx.varied_names(spark, d, _arriving(spark, d)))
    path = new_path(spark, "prepared")
    streaming.write_prepared(stream.select("taxonID", "name_to_parse", "parts"), path, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path).select("taxonID", "name_to_parse", *_flat()).drop("scientific", "authorship")


@query("unparse_names", """select taxonID, case when p_token is null and p_year is null then c else c || ' ' || case when p_protonymp = false then '(' || a || ')' else a end end name from (
  select *, case when p_epithet is null then p_genus || ' ?' when p_epithet = '' then p_genus when p_middle = '' then p_genus || ' ' || p_epithet else p_genus || ' ' || coalesce(p_middle, '?') || ' ' || p_epithet end c,
   concat_ws(', ', coalesce(p_token, '?'), p_year) a from x_parts) where p_genus is not null""")
def _(spark, d):
    rows = NM.parse_names(fx.varied_names(spark, d)).filter("parts.genus is not null")
    return rows.select("taxonID", N.unparse(F.col("parts")).alias("name"))


@query("type_keys", "select p_epithet epithet, p_token token, p_year \"year\", count(*) n from x_parts group by all")
def _(spark, d):
    rows = NM.parse_names(fx.varied_names(spark, d)).select(N.type_key(F.col("parts")).alias("t"))
    return rows.groupBy("t.epithet", "t.token", "t.year").agg(F.count("*").alias("n"))


@query("same_parts", """select x.taxonID, (x.p_genus is not distinct from y.p_genus and x.p_middle is not distinct from y.p_middle and x.p_epithet is not distinct from y.p_epithet
   and x.p_token is not distinct from y.p_token and x.p_year is not distinct from y.p_year) same from x_parts x join x_parts y on y._ord = x._ord - x._ord % 2""")
def _(spark, d):
    rows = stage(NM.parse_names(fx.varied_names(spark, d)).select("_ord", "taxonID", "parts"))
    other = rows.select(F.col("_ord").alias("_o"), F.col("parts").alias("q"))
    return rows.join(other, F.col("_o") == F.col("_ord") - F.col("_ord") % 2).select("taxonID", N.same_parts(F.col("parts"), F.col("q")).alias("same"))


@query("typelike_names", """select taxonID, case when len(w) > 2 and w[len(w)] = w[len(w) - 1] then 0 when len(w) < 2 then 1 else 10 end grade
  from (select taxonID, string_split(canonicalName, ' ') w from x_a)""")
def _(spark, d):
    return fx.checklist_a(spark, d).select("taxonID", N.typelike(F.col("canonicalName")).alias("grade"))


# -- hierarchy --------------------------------------------------------------------------------


@query("resolve_superiors", """select l.taxonID, l.relation, coalesce(t.taxonID, case when l.sup < 0 then '⊤' end) superior, l.note from t_link l left join t_id t on t.nid = l.sup""")
def _(spark, d):
    rows = stage(T.identify(fx.tangled(spark, d)))
    links = T.resolve_superiors(rows).select("taxonID", "relation", "sup", "note")
    names = rows.select("nid", "taxonID").unionByName(spark.range(1).select(F.lit(-2).cast("bigint").alias("nid"), F.lit(T.TOP).alias("taxonID")))
    return _ids(links, names, superior="sup")


@query("skip_synonym_superiors", "select n.taxonID, n.relation, s.taxonID superior, n.note from t_all n left join t_all s on s.nid = n.sup where n.taxonID <> '⊤'")
def _(spark, d):
    nodes = tangled(spark, d)
    return _ids(nodes.filter("nid <> -2").select("taxonID", "relation", "sup", "note"), nodes, superior="sup")


@query("check_ranks", 'select taxonID, "rank", rank_problem from t_all')
def _(spark, d):
    return tangled(spark, d).select("taxonID", "rank", "rank_problem")


@query("accepted_flags", f"select taxonID, taxonomicStatus, {O.accepted('taxonomicStatus')} accepted from x_tangled")
def _(spark, d):
    return fx.tangled(spark, d).select("taxonID", "taxonomicStatus", T.is_accepted(F.col("taxonomicStatus")).alias("accepted"))


@query("accepted_of", "select n.taxonID, a.taxonID accepted_id from (select u.nid, arg_min(u.ancestor, u.distance) acc from t_up u join t_all t on t.nid = u.ancestor and t.accepted group by u.nid) g join t_all n on n.nid = g.nid join t_all a on a.nid = g.acc")
def _(spark, d):
    nodes = tangled(spark, d)
    rows = T.accepted_of(nodes.filter("path is not null"))
    return _ids(rows, nodes, taxonID="nid", accepted_id="accepted_nid")


@query("levels", 'select taxonID, "level" from t_all')
def _(spark, d):
    return tangled(spark, d).select("taxonID", "level")


@query("ancestor_closure", "select n.taxonID, a.taxonID ancestor_id, u.distance from t_up u join t_all n on n.nid = u.nid join t_all a on a.nid = u.ancestor")
def _(spark, d):
    nodes = tangled(spark, d)
    return _ids(T.ancestor_closure(nodes), nodes, taxonID="nid", ancestor_id="ancestor")


@query("walk_order", "select taxonID, row_number() over (order by path) position from t_all where path is not null")
def _(spark, d):
    from ..operators.numbering import number_within
    rows = tangled(spark, d).filter("path is not null").select("taxonID", "path", F.lit(1).alias("tree"))
    return number_within(rows, ["tree"], ["path"], "position").select("taxonID", "position")


@query("inferior_counts", "select t.taxonID, k.n_children, k.n_synonyms from t_kids k join t_all t on t.nid = k.nid")
def _(spark, d):
    nodes = tangled(spark, d)
    return _ids(T.inferior_counts(nodes.filter("sup is not null")), nodes, taxonID="nid")


O.define("t_read", "select w.taxonID, w.accepted, case when w.acceptedNameUsageID <> '' then w.acceptedNameUsageID else w.parentNameUsageID end above from t_id w")
O.define("t_meant", "select taxonID, arg_min(accepted, _ord) accepted, count(*) n from t_id group by taxonID")


@query("validate", """select 'unreachable' problem, taxonID from t_all where path is null
 union all select 'unresolved accepted id', taxonID from t_all where sup is null and taxonID <> '⊤'
 union all select 'synonym without accepted id', taxonID from t_all where not accepted and acceptedNameUsageID = ''
 union all select 'rank out of order', taxonID from t_all where rank_problem
 union all select 'unknown parent', taxonID from t_all where note = 'inferior of top' and parentNameUsageID <> ''
 union all select distinct 'synonym with child', m.taxonID from t_read r join t_meant m on m.taxonID = r.above where not m.accepted and r.accepted
 union all select distinct 'synonym with synonym', m.taxonID from t_read r join t_meant m on m.taxonID = r.above where not m.accepted and not r.accepted
 union all select 'repeated key', taxonID from t_meant where n > 1
 union all select 'root', taxonID from t_all where sup < 0
 union all select 'row count', 'A' from (select count(*) n from t_id) where n <> (select count(*) from t_all where path is not null and nid >= 0)
   or n <> (select count(*) from t_all where sup is not null and nid >= 0)""")
def _(spark, d):
    return T.validate(tangled_rows(spark, d), tangled(spark, d))


@query("reconcile", """select 'A' side, (select count(*) from t_id) "read", count(*) filter (sup is not null) linked, count(*) filter (path is not null) reachable,
   count(*) filter (sup is null or path is null) = 0 same from t_all where nid >= 0
 union all select side, count(*), count(*), count(*), true from s_id group by side""")
def _(spark, d):
    al = star(spark, d)
    return T.reconcile(tangled_rows(spark, d), tangled(spark, d)).unionByName(T.reconcile(al.rows, al.nodes))


O.define("t_span", """select a.nid, a.taxonID, row_number() over (order by a.path) pre, z.n, len(a.path) d from t_all a join (select ancestor, count(*) n from t_up group by ancestor) z on z.ancestor = a.nid
  where a.path is not null""")


@query("postorder", 'select taxonID, pre, pre + n - 1 "last", pre + n - d post from t_span')
def _(spark, d):
    return tangled(spark, d).filter("path is not null").select("taxonID", "pre", "last", "post")


@query("subtree_by_interval", "select n.taxonID, n.\"level\" from t_up u join t_all a on a.nid = u.ancestor join t_all n on n.nid = u.nid where a.taxonID = 'N3'")
def _(spark, d):
    return T.below(tangled(spark, d), "N3").select("taxonID", "level")


def _tree_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of taxa of the faulty checklist: each with its neighbour in the file and all above it, both ways round."""
    nodes = tangled(spark, d).filter("path is not null")
    kind = (F.col("_ord") / 1000000000000).cast("bigint").alias("kind")
    near = nodes.filter("_ord >= 0").select("nid", "_ord", kind)
    nxt = near.select(F.col("nid").alias("y"), (F.col("_ord") - 1).alias("_ord"), "kind")
    own = nodes.select(F.col("nid").alias("x"), F.explode("path").alias("y"))
    return (near.join(nxt, ["_ord", "kind"]).select(F.col("nid").alias("x"), "y")
            .unionByName(own).unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())


O.define("t_pairs", """select a.nid x, b.nid y from t_all a join t_all b on b._ord = a._ord + 1 and b._ord // 1000000000000 = a._ord // 1000000000000 where a.path is not null and b.path is not null and a._ord >= 0
 union select nid, ancestor from t_up union select ancestor, nid from t_up""")


def _pair_ids(df: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    out = _ids(df, nodes, x_id="x", y_id="y")
    return _ids(out, nodes, **{m + "_id": m for m in more})


@query("compare_in_tree", f"""select x.taxonID x_id, y.taxonID y_id, {O.in_tree('x', 'y')} relation, m.taxonID mrca_id from t_pairs p join t_all x on x.nid = p.x join t_all y on y.nid = p.y
  join t_all m on m.nid = list_last(list_sort(list_filter(x.path, lambda e: list_contains(y.path, e)), 'asc')) or false
  where m.nid = x.path[len(list_filter(x.path, lambda e: list_contains(y.path, e)))]""".replace(
    "join t_all m on m.nid = list_last(list_sort(list_filter(x.path, lambda e: list_contains(y.path, e)), 'asc')) or false\n  where m.nid =",
    "join t_all m on m.nid ="))
def _(spark, d):
    nodes = tangled(spark, d)
    return _pair_ids(T.compare_in_tree(_tree_pairs(spark, d), nodes), nodes, "mrca")


@query("tree_predicates", f"""select x_id, y_id, le, le and x_id <> y_id lt, ge, ge and x_id <> y_id gt, descends, (rel & 8) = 0 intersects from (
  select x.taxonID x_id, y.taxonID y_id, {O.prefix('y.path', 'x.path')} le, {O.prefix('x.path', 'y.path')} ge, len(y.path) < len(x.path) descends, {O.in_tree('x', 'y')} rel
  from t_pairs p join t_all x on x.nid = p.x join t_all y on y.nid = p.y)""")
def _(spark, d):
    nodes = tangled(spark, d)
    return _pair_ids(T.tree_predicates(_tree_pairs(spark, d), nodes), nodes)


O.define("t_sums", """select u.nid, sum(case when a.relation = 1 then 1 else 0 end) n_lt, sum(case when a.relation = 5 then 1 else 0 end) n_le,
  sum(case when a.sup is null then 0 else cast(floor(log2(greatest(k.n_children, 1)) + 1e-9) as bigint) end) weight from t_up u join t_all a on a.nid = u.ancestor left join t_kids k on k.nid = a.sup group by u.nid""")
O.define("t_v8", """select x.taxonID x_id, y.taxonID y_id, x3.nid x3, y3.nid y3, case when xs.n_lt > x3s.n_lt then 1 when xs.n_le > x3s.n_le then 5 else 4 end rx,
   case when ys.n_lt > y3s.n_lt then 1 when ys.n_le > y3s.n_le then 5 else 4 end ry from t_pairs p join t_all x on x.nid = p.x join t_all y on y.nid = p.y
   join t_all x3 on x3.nid = x.path[least(len(x.path), len(y.path))] join t_all y3 on y3.nid = y.path[least(len(x.path), len(y.path))]
   join t_sums xs on xs.nid = x.nid join t_sums ys on ys.nid = y.nid join t_sums x3s on x3s.nid = x3.nid join t_sums y3s on y3s.nid = y3.nid""")


@query("compare_in_tree_v8", "select x_id, y_id, " + O.compose(O.compose("rx", "case when x3 = y3 then 4 when rx <> 5 and ry <> 5 then 8 else 31 end"), O.reverse("ry")) + " relation from t_v8")
def _(spark, d):
    nodes = tangled(spark, d)
    return _pair_ids(T.compare_in_tree_v8(_tree_pairs(spark, d), nodes.filter("path is not null")), nodes)


@query("lineage_distance", """select x.taxonID x_id, y.taxonID y_id, m.taxonID mrca_id, cast(case when x.nid = m.nid then 0 else xs.weight - ms.weight - 1 end + case when y.nid = m.nid then 0 else ys.weight - ms.weight - 1 end as bigint) distance
  from t_pairs p join t_all x on x.nid = p.x join t_all y on y.nid = p.y join t_all m on m.nid = x.path[len(list_filter(x.path, lambda e: list_contains(y.path, e)))]
  join t_sums xs on xs.nid = x.nid join t_sums ys on ys.nid = y.nid join t_sums ms on ms.nid = m.nid""")
def _(spark, d):
    nodes = tangled(spark, d)
    return _pair_ids(T.lineage_distance(_tree_pairs(spark, d), nodes.filter("path is not null")), nodes, "mrca")


O.define("s_lot", """select side || (_ord % 97) g, path from s_all where "level" > 1""")


@query("group_mrca", """select g, m.taxonID mrca_id from (select g, arg_max(anc, l) mrca from (
   select g, anc, l, count(*) c from (select g, unnest(path) anc, unnest(range(1, len(path) + 1)) l from s_lot) group by g, anc, l)
   join (select g, count(*) n from s_lot group by g) using (g) where c = n group by g) q join s_all m on m.nid = q.mrca""")
def _(spark, d):
    nodes = star(spark, d).nodes
    groups = nodes.filter("level > 1").select(F.concat("side", F.col("_ord") % 97).alias("g"), "nid")
    return _ids(T.group_mrca(groups, nodes, "g"), nodes, mrca_id="mrca")


O.define("x_below", """select 'N3' id union select a.taxonID from x_a a join x_below b on (a.acceptedNameUsageID = b.id and a.acceptedNameUsageID <> '') or (a.parentNameUsageID = b.id and a.parentNameUsageID <> '')""")
O.define("x_belowb", """select 'bN3' id union select a.taxonID from x_b a join x_belowb b on (a.acceptedNameUsageID = b.id and a.acceptedNameUsageID <> '') or (a.parentNameUsageID = b.id and a.parentNameUsageID <> '')""")


@query("subset_by_id", f"""select {_ROW.replace('parentNameUsageID', "case when parentNameUsageID in (select id from x_belowb) then parentNameUsageID else '' end parentNameUsageID")
  .replace('acceptedNameUsageID', "case when acceptedNameUsageID in (select id from x_belowb) then acceptedNameUsageID else '' end acceptedNameUsageID")} from x_b where taxonID in (select id from x_belowb)""")
def _(spark, d):
    return T.subset(fx.checklist_b(spark, d), "bN3").select(*_ROWS)


@query("subset_by_name", f"""select {_ROW.replace('parentNameUsageID', "case when parentNameUsageID in (select id from x_below) then parentNameUsageID else '' end parentNameUsageID")} from x_a where taxonID in (select id from x_below)""")
def _(spark, d):
    return T.subset(fx.checklist_a(spark, d), "Natiod").select(*_ROWS)


@query("export_checklist", """select n.taxonID, n.canonicalName, n.scientificName, '' canonicalStem, '' managed_id, n."rank" taxonRank, case when n.accepted then s.taxonID else '' end parentNameUsageID,
   case when n.accepted then '' else coalesce(a.taxonID, '') end acceptedNameUsageID,
   case when n.accepted and not starts_with(st, 'accepted') then 'accepted ' || st when not n.accepted and starts_with(st, 'accepted') then '*' || st else st end taxonomicStatus
  from (select *, case when taxonomicStatus = '' then '?' else taxonomicStatus end st from t_all where path is not null) n left join t_all s on s.nid = n.sup
  left join (select u.nid, arg_min(u.ancestor, u.distance) acc from t_up u join t_all t on t.nid = u.ancestor and t.accepted group by u.nid) g on g.nid = n.nid left join t_all a on a.nid = g.acc where n."level" > 1""")
def _(spark, d):
    return T.export_checklist(tangled(spark, d).filter("path is not null"))


@query("nearest_ranked", """select n.taxonID, a.taxonID family_id, s.taxonID species_id from t_tree n left join t_all a on a.nid = n.family_nid left join t_all s on s.nid = n.species_nid where n.path is not null""")
def _(spark, d):
    nodes = tangled(spark, d)
    family, species = T.nearest_ranked(nodes, "family"), T.nearest_ranked(nodes, "species", accepted_only=True)
    out = nodes.filter("path is not null").select("nid", "taxonID").join(family.toDF("nid", "fam"), "nid", "left").join(species.toDF("nid", "spc"), "nid", "left")
    return _ids(out, nodes, family_id="fam", species_id="spc").drop("nid")


@query("near_enough", """select a.taxonID a_id, b.taxonID b_id, coalesce(a.family = b.family, false) near from s_rec a join s_rec b on a.side = 'A' and b.side = 'B' and b._ord = a._ord""")
def _(spark, d):
    rec = star(spark, d).records
    a = rec.filter("side = 'A'").select("_ord", F.col("taxonID").alias("a_id"), F.col("family").alias("fa"))
    b = rec.filter("side = 'B'").select("_ord", F.col("taxonID").alias("b_id"), F.col("family").alias("fb"))
    return a.join(b, "_ord").select("a_id", "b_id", F.coalesce(F.col("fa") == F.col("fb"), F.lit(False)).alias("near"))


@query("rank_numbers", f"select taxonID, {O.rankno('taxonRank')} n from x_tangled")
def _(spark, d):
    return fx.tangled(spark, d).select("taxonID", rank_number("taxonRank").alias("n"))


@query("workspace", "select side, side || '!' || taxonID key, accepted from s_id")
def _(spark, d):
    rows = T.workspace_rows(fx.checklist_b(spark, d), fx.checklist_a(spark, d))
    return T.workspace_key(T.swap(rows)).select("side", "key", "accepted")


O.define("h_dups", """select r.side, coalesce(r.family, '') fam, coalesce(p_genus, '?') g, coalesce(p_epithet, '?') e, coalesce(p_middle, '?') m, coalesce(p_token, '?') t, coalesce(p_year, '?') y, r."rank" rk, r.taxonID, r.n_children,
   {'a': case when r.accepted then 0 else 1 end, 'c': -r.n_children, 'l': levenshtein(r.canonicalName, coalesce(s.canonicalName, '')), 'k': r.taxonID} o from h_rec r left join h_all s on s.nid = r.sup""")


@query("duplicate_records", """select side, taxonID, best, n_children from (select *, first_value(taxonID) over (partition by side, fam, g, e, m, t, y, rk order by o) best from h_dups) where best <> taxonID""")
def _(spark, d):
    return T.duplicate_records(homonym(spark, d).nodes)


@query("senior_synonyms", """select n.side, n.taxonID, s.taxonID accepted_id from (select a.*, x.namePublishedInYear yr from t_all a join x_tangled x on x.taxonID = a.taxonID and x._ord = a._ord) n
  join (select a.*, x.namePublishedInYear yr from t_all a join x_tangled x on x.taxonID = a.taxonID and x._ord = a._ord) s on s.nid = n.sup where not n.accepted and n.yr <> '' and s.yr <> '' and n.yr <= s.yr""")
def _(spark, d):
    return T.senior_synonyms(tangled(spark, d))


# -- relation algebra -------------------------------------------------------------------------


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of relation codes spread over the line items."""
    return fx.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 32).cast("int").alias("r"), (F.col("l_suppkey") % 32).cast("int").alias("s")).agg(F.count("*").alias("n"))


O.define("x_codes", "select cast(l_partkey % 32 as int) r, cast(l_suppkey % 32 as int) s, count(*) n from lineitem group by all")


@query("rcc5_symbols", f"select r, s, n, {O.symbol('r')} symbol, r parsed, {O.reverse('r')} reversed from x_codes")
def _(spark, d):
    r = F.col("r")
    return _codes(spark, d).select("r", "s", "n", rcc5.symbol(r).alias("symbol"), rcc5.parse(rcc5.symbol(r)).alias("parsed"), rcc5.reverse(r).alias("reversed"))


@query("rcc5_composition", f"""select r, s, n, {O.compose('r', 's')} composed, r & s "both", array_to_string(list_filter([1, 2, 4, 8, 16], lambda b: (r & b) <> 0), ' ') members from x_codes""")
def _(spark, d):
    r, s = F.col("r"), F.col("s")
    return _codes(spark, d).select("r", "s", "n", rcc5.compose(r, s).alias("composed"), rcc5.both(r, s).alias("both"), F.array_join(rcc5.members(r), " ").alias("members"))


@query("predicate_composition", f"""select n.taxonID, {O.compose('n.relation', 's.relation')} relation, g.taxonID target, case n.relation when 5 then 1 when 4 then 0 else 2 end + case s.relation when 5 then 1 when 4 then 0 else 2 end span,
   case when n.note = s.note then n.note else n.note || '; ' || s.note end note, {O.reverse(O.compose('n.relation', 's.relation'))} back, '←' || case when n.note = s.note then n.note else n.note || '; ' || s.note end back_note
  from t_all n join t_all s on s.nid = n.sup join t_all g on g.nid = s.sup""")
def _(spark, d):
    nodes = tangled(spark, d)
    p = nodes.filter("sup is not null").select(F.col("taxonID"), "sup", rcc5.predicate(F.col("relation"), F.col("sup"), F.col("span"), F.col("note")).alias("p"))
    q = nodes.filter("sup is not null").select(F.col("nid").alias("sup"), rcc5.predicate(F.col("relation"), F.col("sup"), F.col("span"), F.col("note")).alias("q"))
    j = p.join(q, "sup").select("taxonID", rcc5.compose_predicates(F.col("p"), F.col("q")).alias("c"))
    j = j.select("taxonID", "c", rcc5.reverse_predicate(F.col("taxonID"), F.col("c")).alias("b"))
    out = j.select("taxonID", "c.relation", F.col("c.target").alias("_t"), "c.span", "c.note", F.col("b.relation").alias("back"), F.col("b.note").alias("back_note"))
    return _ids(out, nodes, target="_t")


# -- matching ---------------------------------------------------------------------------------


@query("subproblems", """select key, count(*) filter (side = 'A') n_a, count(*) filter (side = 'B') n_b from h_rec group by key having count(distinct side) = 2""")
def _(spark, d):
    return M.subproblems(homonym(spark, d).records)


@query("importance_order", """select side, key, arg_min(taxonID, {'s': case when accepted then 1 else 2 end, 'f': form, 'c': -n_children, 'y': -n_synonyms, 'n': scientificName, 't': taxonID}) first_id, count(*) n from s_rec group by side, key""")
def _(spark, d):
    return star(spark, d).records.groupBy("side", "key").agg(F.min_by("taxonID", "importance").alias("first_id"), F.count("*").alias("n"))


def _same_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names side by side: each varied name with the next one's parts, so that all classes occur."""
    rows = stage(NM.parse_names(fx.varied_names(spark, d)).select("_ord", "taxonID", "parts"))
    other = rows.select((F.col("_ord") - 80).alias("_ord"), F.col("parts").alias("q"))
    same = rows.select("_ord", F.col("parts").alias("q"))
    epithet = F.col("p.epithet")
    joined = rows.withColumnRenamed("parts", "p").join(other, "_ord")
    # the partner takes over the epithet for three rows in four
    q = F.when(F.col("_ord") % 4 < 3, F.col("q").withField("epithet", epithet)).otherwise(F.col("q"))
    return joined.select("taxonID", "p", q.alias("q"))


O.define("x_pp", """select x.*, case when x.p_epithet = '' and x.p_genus <> '' then lower(x.p_genus) else x.p_epithet end ep from x_parts x""")
O.define("x_qq", """select y.* replace (case when x._ord % 4 < 3 then x.p_epithet else y.p_epithet end as p_epithet,
   case when (case when x._ord % 4 < 3 then x.p_epithet else y.p_epithet end) = '' and y.p_genus <> '' then lower(y.p_genus) else case when x._ord % 4 < 3 then x.p_epithet else y.p_epithet end end as ep), x.taxonID xid
  from x_pp x join x_pp y on y._ord = x._ord + 80""")
O.define("x_mask", f"select x.taxonID, {O.masks('x', 'y', 'misses')} misses, {O.masks('x', 'y', 'hits')} hits from x_pp x join x_qq y on y.xid = x.taxonID")
_WORDS = "array_to_string(list_filter([case when {0} & 1 > 0 then 'middle' end, case when {0} & 2 > 0 then 'genus' end, case when {0} & 4 > 0 then 'token' end, case when {0} & 8 > 0 then 'year' end, case when {0} & 16 > 0 then 'vicinity' end, case when {0} & 32 > 0 then 'epithet' end], lambda z: z is not null), ', ')"


@query("parts_comparison", f"select taxonID, misses, hits, 'hits(' || {_WORDS.format('hits')} || ') misses(' || {_WORDS.format('misses')} || ')' explained from x_mask")
def _(spark, d):
    masks = _same_key_pairs(spark, d).select("taxonID", H.parts_comparison(F.col("p"), F.col("q")).alias("m"))
    m = F.col("m.misses"), F.col("m.hits")
    return masks.select("taxonID", m[0].alias("misses"), m[1].alias("hits"), H.explain_masks(*m).alias("explained"))


@query("name_classes", f"select taxonID, cls, case cls when 10 then 'homotypic' when 9 then 'correction' when 8 then 'motion' when 5 then 'authorless' when 2 then 'review' when 0 then 'heterotypic' end word from (select taxonID, {O.classify('misses', 'hits')} cls from x_mask)")
def _(spark, d):
    rows = _same_key_pairs(spark, d).select("taxonID", H.compare_names(F.col("p"), F.col("q")).alias("cls"))
    return rows.withColumn("word", H.explain_class(F.col("cls")))


@query("name_classes_v8", """select taxonID, cast(case when e0 then 0 when mis > 1 then 1 when unk >= 2 then 5 when gd and prot then 7 when gd then 8 when md then 8.5 when mis > 0 then 9 else 10 end as double) cls from (
  select *, cast(td as int) + cast(yd as int) + cast(md or gd as int) mis from (select x.taxonID, coalesce(x.p_epithet <> y.p_epithet, false) e0, coalesce(x.p_token <> y.p_token, false) td, coalesce(x.p_year <> y.p_year, false) yd,
   coalesce(x.p_genus <> y.p_genus, false) gd, coalesce(x.p_protonymp and y.p_protonymp, false) prot,
   coalesce(case when x.p_middle = '' and x.ep is not null then x.ep else x.p_middle end <> case when y.p_middle = '' and y.ep is not null then y.ep else y.p_middle end, false) md,
   cast(x.p_token is null or y.p_token is null as int) + cast(x.p_year is null or y.p_year is null as int) + cast(coalesce(x.p_epithet = y.p_epithet, false) as int) unk
  from x_pp x join x_qq y on y.xid = x.taxonID))""")
def _(spark, d):
    return _same_key_pairs(spark, d).select("taxonID", H.classify_v8(F.col("p"), F.col("q")).alias("cls"))


@query("homotypic_within", """select x.side, x.taxonID, y.taxonID first_id from s_ties t join s_all x on x.nid = t.nid join s_all y on y.nid = t."first" """)
def _(spark, d):
    al = star(spark, d)
    return _ids(al.ties, al.nodes.select("nid", "taxonID"), first_id="first").join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "first_id")


@query("declared_homotypic", "select n.taxonID, s.taxonID superior from t_all n join t_all s on s.nid = n.sup where n.sup > 0 and contains(case when n.taxonomicStatus = 'synonym' then 'objective synonym' else n.taxonomicStatus end, 'objective')")
def _(spark, d):
    nodes = tangled(spark, d)
    marked = nodes.withColumn("taxonomicStatus", F.when(F.col("taxonomicStatus") == "synonym", "objective synonym").otherwise(F.col("taxonomicStatus")))
    return _ids(M.declared_homotypic(marked), nodes, taxonID="nid", superior="sup")


O.for_guessed("")
for _name, _p, _run in (("star", "s", star), ("homonym", "h", homonym), ("v8", "e", guessed)):
    @query(f"candidate_matches_{_name}", f"select x.side, x.taxonID, p.cls, count(*) n_partners from {_p}_pairs p join {_p}_all x on x.nid = p.nid group by all")
    def _(spark, d, run=_run):
        al = run(spark, d)
        out = (M.candidate_matches if al.version == 7 else M.candidate_matches_v8)(al.records)
        return out.join(al.nodes.select("nid", "taxonID"), "nid").select("side", "taxonID", "cls", "n_partners")

    @query(f"best_matches_{_name}", f"""select b.side, x.taxonID spec_id, b.cls, y.taxonID first_id, z.taxonID second_id from {_p}_best b join {_p}_all x on x.nid = b.spec join {_p}_all y on y.nid = b."first" left join {_p}_all z on z.nid = b."second" """)
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(al.best, al.nodes, spec_id="spec", first_id="first", second_id="second")

    @query(f"partner_counts_{_name}", f"select c.side, x.taxonID spec_id, c.cls, count(*) n_partners from {_p}_cand c join {_p}_best b on b.side = c.side and b.spec = c.spec and b.cls = c.cls join {_p}_all x on x.nid = c.spec group by all")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(al.best.join(al.partner_counts, ["side", "spec"]).select("side", "spec", "cls", "n_partners"), al.nodes, spec_id="spec")

    @query(f"mutual_best_{_name}", f"select x.taxonID a_id, y.taxonID b_id from {_p}_edge e join {_p}_all x on x.nid = e.u join {_p}_all y on y.nid = e.v")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(M.mutual_best(al.decisions), al.nodes, a_id="u", b_id="v")

    @query(f"match_review_{_name}", f"select x.taxonID spec_id, d.cls, d.outcome from {_p}_dec d join {_p}_all x on x.nid = d.spec where d.outcome not in ('match', 'double A', 'double B')")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(M.match_review(al.decisions), al.nodes, spec_id="spec")

    @query(f"review_counts_{_name}", f"select x.taxonID spec_id, d.outcome, count(*) n_partners from {_p}_dec d join {_p}_all x on x.nid = d.spec join {_p}_cand c on c.side = 'A' and c.spec = d.spec and c.cls = d.cls where d.outcome not in ('match', 'double A', 'double B') group by all")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(M.review_counts(al.decisions, al.partner_counts).select("spec", "outcome", "n_partners"), al.nodes, spec_id="spec")

    @query(f"exemplars_{_name}", f"select e.exemplar_id, e.side, x.taxonID from {_p}_ex e join {_p}_all x on x.nid = e.nid")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(al.exemplars, al.nodes, taxonID="nid")

    @query(f"exemplar_stats_{_name}", f"""select s.side, count(*) records, count(distinct s.spec) specimens, count(e.exemplar_id) with_exemplar, count(distinct e.exemplar_id) exemplars from {_p}_spec s left join {_p}_ex e on e.nid = s.nid group by s.side""")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return M.exemplar_stats(al.records, al.exemplars)


for _name, _p, _run in (("star", "s", star), ("homonym", "h", homonym)):
    O.define(f"{_p}_way", f"""select distinct side, spec, key, epithet, u.* from (select side, spec, key, epithet, unnest([
      case when genus is not null and token is not null and year is not null then {{'cls': 10, 'genus': genus, 'token': token, 'year': year, 'family': ''}} end,
      case when genus is not null and token is not null then {{'cls': 9, 'genus': genus, 'token': token, 'year': '', 'family': ''}} end,
      case when genus is not null and year is not null then {{'cls': 9, 'genus': genus, 'token': '', 'year': year, 'family': ''}} end,
      case when token is not null and year is not null and family is not null then {{'cls': 8, 'genus': '', 'token': token, 'year': year, 'family': family}} end]) u
     from (select side, spec, key, ep epithet, p_genus genus, p_token token, p_year "year", family from {_p}_spec) where epithet is not null) where u is not null""")
    O.define(f"{_p}_met", f"""select w.*, y.n from {_p}_way w join (select side, key, epithet, cls, genus, token, "year", family, count(*) n from {_p}_way group by all) y
     on y.side <> w.side and y.key = w.key and y.epithet = w.epithet and y.cls = w.cls and y.genus = w.genus and y.token = w.token and y."year" = w."year" and y.family = w.family""")

    @query(f"partner_groups_{_name}", f"""select m.side, x.taxonID spec_id, m.key, m.epithet, m.cls, m.genus, m.token, m."year", m.family, m.n, m.cls = max(m.cls) over (partition by m.side, m.spec) top from {_p}_met m join {_p}_all x on x.nid = m.spec""")
    def _(spark, d, run=_run):
        al = run(spark, d)
        return _ids(al.partner_groups, al.nodes, spec_id="spec")


@query("homotypic_within_v8", """select x.side, x.taxonID, y.taxonID first_id from e_ties t join e_all x on x.nid = t.nid join e_all y on y.nid = t."first" """)
def _(spark, d):
    al = guessed(spark, d)
    return _ids(al.ties, al.nodes.select("nid", "taxonID"), first_id="first").join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "first_id")


@query("exemplar_lookup", "select l.exemplar_id, a.taxonID a_id, b.taxonID b_id, l.epithet from s_label l join s_all a on a.nid = l.rep_a join s_all b on b.nid = l.rep_b")
def _(spark, d):
    al = star(spark, d)
    return _ids(al.theory.lookup, al.nodes, a_id="rep_a", b_id="rep_b")


O.define("x_cce", "select -o_custkey - 1 s, l_suppkey t from orders join lineitem on l_orderkey = o_orderkey union select l_suppkey, -o_custkey - 1 from orders join lineitem on l_orderkey = o_orderkey")
# every node takes the least label around it, until a round moves none
O.define("x_ccr", """select 0 round, s node, min(t) label, true moved from x_cce group by s
 union all select round + 1, node, least(label, near), near < label from (
   select r.round, r.node, r.label, min(q.label) near from x_ccr r join x_cce e on e.s = r.node join x_ccr q on q.node = e.t
   where (select bool_or(moved) from x_ccr) group by r.round, r.node, r.label)""")


@query("connected_components", "select node, least(node, min(label)) component from x_ccr group by node")
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (-F.col("o_custkey") - 1).alias("u"))
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"))
    return M.connected_components(o.join(li, "k").select("u", "v"))


# -- theory -----------------------------------------------------------------------------------


@query("blocks", "select b.side, t.taxonID, b.exemplar_id from s_block b join s_all t on t.nid = b.nid")
def _(spark, d):
    al = star(spark, d)
    return _ids(TH.blocks(al.theory.members), al.nodes, taxonID="nid")


@query("monotypic_nodes", "select t.side, t.taxonID from s_mono m join s_all t on t.nid = m.nid")
def _(spark, d):
    return star(spark, d).theory.nodes.filter("mono").select("side", "taxonID")


@query("cross_mrca", "select t.side, t.taxonID, c.taxonID cross_id, t.block_size, t.uniq from s_th t join s_all c on c.nid = t.cross_nid")
def _(spark, d):
    al = star(spark, d)
    out = al.theory.nodes.filter("block_size > 0").select("side", "taxonID", "cross_nid", "block_size", F.col("unique").alias("uniq"))
    return _ids(out, al.nodes, cross_id="cross_nid")


@query("central_nodes", "select t.side, t.taxonID, c.taxonID central_id, t.central_relation from s_th2 t join s_all c on c.nid = t.central")
def _(spark, d):
    al = star(spark, d)
    return _ids(al.theory.nodes.select("side", "taxonID", "central", "central_relation"), al.nodes, central_id="central")


def _family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A higher taxa with B higher taxa of the same rank and neighbouring number, and species with same key."""
    n = star(spark, d).nodes.filter("level > 1").select("nid", "side", "_ord")
    a, b = n.filter("side = 'A'").select(F.col("nid").alias("u"), "_ord"), n.filter("side = 'B'").select(F.col("nid").alias("v"), F.col("_ord").alias("o"))
    return a.select("u", F.explode(F.array(F.col("_ord"), F.col("_ord") + 1)).alias("o")).join(b, "o").select("u", "v")


O.compared("s_fam", "select a.nid u, b.nid v from s_all a join s_all b on a.side = 'A' and b.side = 'B' and b._ord in (a._ord, a._ord + 1) and a._ord > 0")


@query("compare_concepts", f"""select a.taxonID a_id, b.taxonID b_id, {O.symbol('c.relation')} relation, c.relation in (1, 5, 9) cross_lt, c.relation in (1, 4, 5, 9) cross_le from s_fam c join s_all a on a.nid = c.u join s_all b on b.nid = c.v""")
def _(spark, d):
    al = star(spark, d)
    out = TH.cross_tests(TH.compare(_family_pairs(spark, d), al.theory)).withColumn("relation", rcc5.symbol(F.col("relation")))
    return _ids(out, al.nodes, a_id="u", b_id="v")


@query("block_relations", """select distinct a.taxonID a_id, b.taxonID b_id, c.n_u, c.n_v, c.n_both, case when n_both = n_u and n_both = n_v then 7 when n_both = n_u then 1 when n_both = n_v then 2 when n_both = 0 then 8 else 16 end relation
  from s_fam c join s_th2 x on x.nid = c.u and x.block_size > 0 join s_th2 y on y.nid = c.v and y.block_size > 0 join s_all a on a.nid = c.u join s_all b on b.nid = c.v""")
def _(spark, d):
    al = star(spark, d)
    sized = al.theory.nodes.filter("block_size > 0")
    pairs = (_family_pairs(spark, d).join(sized.select(F.col("nid").alias("u")), "u", "left_semi").join(sized.select(F.col("nid").alias("v")), "v", "left_semi"))
    out = TH.compare_central(pairs, al.theory)
    sets = TH.block_relation(F.col("n_u"), F.col("n_v"), F.col("n_both"))
    return _ids(out.withColumn("relation", sets), al.nodes, a_id="u", b_id="v")


@query("estimates", f"select x.side, x.taxonID, y.taxonID est_id, {O.symbol('e.relation')} relation from s_est e join s_all x on x.nid = e.nid join s_all y on y.nid = e.est")
def _(spark, d):
    al = star(spark, d)
    out = al.estimates.join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "est", rcc5.symbol(F.col("relation")).alias("relation"))
    return _ids(out, al.nodes, est_id="est")


@query("equivalents", "select x.side, x.taxonID, y.taxonID est_id from s_equiv e join s_all x on x.nid = e.nid join s_all y on y.nid = e.est")
def _(spark, d):
    al = star(spark, d)
    out = TH.equivalents(al.estimates, al.theory).join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "est")
    return _ids(out, al.nodes, est_id="est")


@query("intersecting_species", "select p.side, x.taxonID, y.taxonID partner_id from s_partner p join s_all x on x.nid = p.nid join s_all y on y.nid = p.partner")
def _(spark, d):
    al = star(spark, d)
    return _ids(TH.intersecting_species(al.theory), al.nodes, taxonID="nid", partner_id="partner")


@query("buddies", """select x.side, x.taxonID, b.taxonID buddy_id from (select e.exemplar_id, e.nid, case when u."rank" <> w."rank" and u."rank" = q."rank" then w.sup else w.nid end buddy
    from s_ex e join s_look l on l.exemplar_id = e.exemplar_id join s_all u on u.nid = e.nid join s_all v0 on v0.nid = case when e.side = 'A' then l.rep_b else l.rep_a end
    join s_all w on w.nid = case when v0.accepted then v0.nid else v0.sup end left join s_all q on q.nid = w.sup) g
  join s_ex s on s.nid = g.buddy and s.exemplar_id = g.exemplar_id join s_all x on x.nid = g.nid join s_all b on b.nid = g.buddy""")
def _(spark, d):
    al = star(spark, d)
    out = TH.buddies(al.theory).join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "buddy")
    return _ids(out, al.nodes, buddy_id="buddy")


@query("same_protonym", "select a.taxonID a_id, b.taxonID b_id, coalesce(x.exemplar_id = y.exemplar_id, false) same from s_all a join s_all b on a.side = 'A' and b.side = 'B' and b._ord in (a._ord, a._ord + 1) and a._ord > 0 left join s_ex x on x.nid = a.nid left join s_ex y on y.nid = b.nid")
def _(spark, d):
    al = star(spark, d)
    return _ids(TH.same_protonym(_family_pairs(spark, d), al.exemplars), al.nodes, a_id="u", b_id="v")


def _tangled_specimens(spark: SparkSession, d: str) -> DataFrame:
    records = M.match_records(tangled(spark, d).filter("path is not null"))
    return M.with_specimens(records, M.homotypic_within(records))


O.define("t_walk", "select a.nid, a.sup, a.accepted, s.spec, row_number() over (partition by a.sup order by a.nid) n from t_all a join t_spec s on s.nid = a.nid where a.path is not null and a.sup is not null")
O.define("t_sib", """select x.nid x, f.y from t_walk x join (select sup, spec, min(nid) y from t_walk group by sup, spec) f on f.sup = x.sup and f.spec = x.spec where not x.accepted and x.nid <> f.y
 union select x.nid, y.nid from t_walk x join t_walk y on y.sup = x.sup and y.n + 1 = x.n where not x.accepted union select nid, sup from t_walk where not accepted and sup > 0""")


@query("compare_locally", f"""select x.taxonID x_id, y.taxonID y_id, case when r <> 31 then r when s.spec = t.spec then 4 else 27 end relation from (
   select p.x xn, p.y yn, {O.in_tree('x', 'y')} r from t_sib p join t_all x on x.nid = p.x join t_all y on y.nid = p.y)
  join t_all x on x.nid = xn join t_all y on y.nid = yn join t_spec s on s.nid = xn join t_spec t on t.nid = yn""")
def _(spark, d):
    nodes = tangled(spark, d).filter("path is not null")
    specimens = _tangled_specimens(spark, d)
    pairs = stage(TH.siblings_that_meet(nodes, specimens))
    return _pair_ids(TH.compare_locally(T.compare_in_tree(pairs, nodes).drop("mrca"), specimens), nodes)


@query("sibling_relations", """select t.taxonID, count(*) n_siblings, count(*) filter (x.spec = y.spec) n_same, count(*) filter (x.spec <> y.spec) n_other from t_walk x join t_walk y on y.sup = x.sup and y.nid <> x.nid
  join t_all t on t.nid = x.nid where not x.accepted group by x.nid, t.taxonID""")
def _(spark, d):
    nodes = tangled(spark, d).filter("path is not null")
    out = TH.sibling_relations(nodes, _tangled_specimens(spark, d)).filter("n_siblings > 0")
    return _ids(out, nodes, taxonID="nid")


# -- merge and report -------------------------------------------------------------------------


@query("cosuperiors", f"select x.side, x.taxonID, y.taxonID cos_id, {O.symbol('c.relation')} relation from s_cos c join s_all x on x.nid = c.nid join s_all y on y.nid = c.cos")
def _(spark, d):
    al = star(spark, d)
    out = merge.cosuperiors(al.estimates, al.theory).join(al.nodes.select("nid", "side", "taxonID"), "nid").select("side", "taxonID", "cos", rcc5.symbol(F.col("relation")).alias("relation"))
    return _ids(out, al.nodes, cos_id="cos")


@query("suppressed_rows", "select x.taxonID, y.taxonID est_id from s_gone e join s_all x on x.nid = e.nid join s_all y on y.nid = e.est")
def _(spark, d):
    al = star(spark, d)
    return _ids(merge.suppressed(TH.equivalents(al.estimates, al.theory), al.theory), al.nodes, taxonID="nid", est_id="est")


@query("merged_tree", f"""select x.side || '!' || x.taxonID key, x.canonicalName, x."rank", x.accepted, y.side || '!' || y.taxonID superior, {O.symbol('m.relation')} relation from s_merged m join s_all x on x.nid = m.nid left join s_all y on y.nid = m.sup""")
def _(spark, d):
    return star(spark, d).merged


_NAME = "case when {0}.nid is null then '' else case when {0}.canonicalName <> '' then {0}.canonicalName else {0}.scientificName end || case when {0}.accepted then '' else '*' end end"
_LIST = "coalesce((select string_agg(v.exemplar_id || ' ' || v.epithet, '; ' order by v.epithet, v.exemplar_id) from s_venn v where v.u = r.u and v.v = r.v and v.part = '{0}'), '')"


_REPORT = f"""select coalesce(a.taxonID, '') "A concept taxonID", {_NAME.format('a')} "A concept name",
  case when r.relation is null then '' when starts_with({O.symbol('r.relation')}, '=') then '''' || {O.symbol('r.relation')} else {O.symbol('r.relation')} end "RCC5",
  coalesce(b.taxonID, '') "B concept taxonID", {_NAME.format('b')} "B concept name", {_LIST.format('both')} "in both A and B concepts",
  {_LIST.format('only_a')} "in A concept but not in B concept", {_LIST.format('only_b')} "in B concept but not in A concept"
  from s_rel r left join s_all a on a.nid = r.u left join s_all b on b.nid = r.v"""


@query("alignment", _REPORT)
def _(spark, d):
    return star(spark, d).report


@query("alignment_v8", O.for_guessed(_REPORT))
def _(spark, d):
    return guessed(spark, d).report


_CELL = "case when r.relation is not null then (select count(*) from s_venn v where v.u = r.u and v.v = r.v and v.part = '{0}') end"
_COUNTS = _REPORT
for _part in ("both", "only_a", "only_b"):
    _COUNTS = _COUNTS.replace(_LIST.format(_part), _CELL.format(_part))


@query("alignment_counts", _COUNTS)
def _(spark, d):
    al = star(spark, d)
    return report.alignment_counts(al.theory, al.relations)


@query("alignment_counts_v8", O.for_guessed(_COUNTS))
def _(spark, d):
    al = guessed(spark, d)
    return report.alignment_counts(al.theory, al.relations)


O.define("s_number", "select l.exemplar_id, row_number() over (order by t.side, t.path, l.exemplar_id) - 1 num from s_look l join s_tree t on t.nid = l.rep_a")
O.define("s_island", """select nid, min(num) lo, max(num) hi from (select nid, num, num - row_number() over (partition by nid order by num) i from s_block join s_number using (exemplar_id)) group by nid, i""")
O.define("s_both", """select u, v, min(num) lo, max(num) hi from (select u, v, num, num - row_number() over (partition by u, v order by num) i from s_venn join s_number using (exemplar_id) where part = 'both')
  group by u, v, i""")


def _numbers(al: Alignment) -> DataFrame:
    return stage(report.exemplar_numbers(al.theory), "numbers")


@query("concept_ranges", "select t.side, t.taxonID, i.lo, i.hi from s_island i join s_all t on t.nid = i.nid")
def _(spark, d):
    al = star(spark, d)
    out = report.concept_ranges(al.nodes.select("nid"), al.theory, _numbers(al))
    return out.join(al.nodes.select("nid", "side", "taxonID"), "nid").drop("nid")


@query("shared_ranges", "select a.taxonID a_id, b.taxonID b_id, i.lo, i.hi from s_both i join s_all a on a.nid = i.u join s_all b on b.nid = i.v")
def _(spark, d):
    al = star(spark, d)
    return _ids(report.shared_ranges(al.relations, al.theory, _numbers(al)), al.nodes, a_id="u", b_id="v")


@query("report_metrics", f"""select {O.symbol('code')} metric, (select count(*) from s_rel where relation = code) n from range(1, 32) t(code)
 union all select 'rows', count(*) from s_rel union all select 'relations', count(relation) from s_rel
 union all select 'only in A', count(*) from s_rel where v is null union all select 'only in B', count(*) from s_rel where u is null""")
def _(spark, d):
    al, seen = star(spark, d), Observation("report")
    named = {f"m{i}": (name, metric) for i, (name, metric) in enumerate(report.report_metrics().items())}
    watched = al.relations.observe(seen, *[metric.alias(short) for short, (_, metric) in named.items()])
    writers.write_csv(watched, new_path(spark, "relations"))
    return spark.createDataFrame([(named[short][0], n) for short, n in seen.get.items()], "metric string, n long")


@query("venn_rows", "select a.taxonID a_id, b.taxonID b_id, v.exemplar_id, v.epithet, v.part from s_venn v join s_all a on a.nid = v.u join s_all b on b.nid = v.v")
def _(spark, d):
    al = star(spark, d)
    return _ids(report.venn_rows(al.relations, al.theory), al.nodes, a_id="u", b_id="v")


@query("relation_counts", """select case when u is null then 'in B; unknown relationship to A' when v is null then 'in A; unknown relationship to B' else case relation when 4 then 'is congruent with' when 1 then 'is contained in' when 2 then 'contains' when 16 then 'overlaps' else '' end end comment, count(*) n from s_rel group by 1""")
def _(spark, d):
    return report.relation_counts(star(spark, d).relations)


_DIFF = "{0}.p_{1} is distinct from {2}.p_{1}"
O.define("s_chg", """select r.u, r.v, r.relation, coalesce(x.exemplar_id = y.exemplar_id, false) hom from s_rel r left join s_ex x on x.nid = r.u left join s_ex y on y.nid = r.v""")


@query("describe_changes", f"""select a.taxonID a_id, b.taxonID b_id, c.relation, c.hom homotypic,
  case when c.u is null then 'new' when c.v is null then 'gone' when c.relation = 4 then 'congruent' when c.relation = 1 then case when hom then 'expand' else 'lump' end when c.relation = 2 then case when hom then 'contract' else 'split' end
    when c.relation = 16 then case when hom then 'contract+expand' else 'split+lump' end else 'should not happen' end concept_change,
  array_to_string(case when hom then list_filter([case when {_DIFF.format('a', 'genus', 'b')} then 'change genus' end, case when {_DIFF.format('a', 'epithet', 'b')} then 'change epithet' end, case when {_DIFF.format('a', 'token', 'b')} then 'change author' end,
    case when {_DIFF.format('a', 'year', 'b')} then 'change year' end, case when a."rank" is distinct from b."rank" then 'change rank' end], lambda z: z is not null) else [] end, ', ') name_change,
  array_to_string(list_filter([case when {O.rankno('a."rank"')} < {O.rankno('b."rank"')} then 'promoted' end, case when {O.rankno('a."rank"')} > {O.rankno('b."rank"')} then 'demoted' end, case when not a.accepted and b.accepted then 'accepted' end, case when a.accepted and not b.accepted then 'synonymized' end], lambda z: z is not null), ', ') rank_change,
  case when c.u is not null and c.v is not null then cast({_DIFF.format('a', 'genus', 'b')} as int) + cast({_DIFF.format('a', 'epithet', 'b')} as int) + cast({_DIFF.format('a', 'token', 'b')} as int) + cast({_DIFF.format('a', 'year', 'b')} as int) end name_distance
  from s_chg c left join s_parts a on a.nid = c.u left join s_parts b on b.nid = c.v""")
def _(spark, d):
    al = star(spark, d)
    out = changes.describe_changes(al.relations, al.exemplars, al.nodes)
    return out.withColumns({c: F.array_join(c, ", ") for c in ("name_change", "rank_change")})


O.define("s_base", """select nid, side, path, sup, "rank", replace(translate(case when canonicalName <> '' then canonicalName else taxonID end, ' .', '__'), '__', '_') base from s_tree where accepted and (species_nid is null or species_nid = nid)""")
O.define("s_uniq", """select *, case when count(*) over (partition by side, base) > 1 then base || '_' || row_number() over (partition by side, base order by path) else base end unique_name from s_base""")


@query("articulations", """select 'A.' || a.unique_name a_name, case r.relation when 4 then '=' when 1 then '<' when 2 then '>' when 8 then '!' when 16 then '><' end relation, 'B.' || b.unique_name b_name from s_rel r join s_uniq a on a.nid = r.u join s_uniq b on b.nid = r.v where r.relation is not null""")
def _(spark, d):
    al = star(spark, d)
    return art.articulations(al.relations, art.unique_names(al.nodes))


@query("taxonomy_edges", """select c.side, p.unique_name parent, c.unique_name child from s_uniq c join s_uniq p on p.nid = c.sup where c.sup > 0 and p."rank" <> 'species'""")
def _(spark, d):
    nodes = star(spark, d).nodes
    return art.taxonomy_edges(nodes, art.unique_names(nodes))


@query("nested_round_trip", """select f.taxonID family, n.canonicalName, case when u.distance = 0 then '' else p.canonicalName end parent, case when n.accepted then 'accepted' else 'synonym' end status,
   case when len(string_split(n.canonicalName, ' ')) = 2 then 'species' else '' end "rank"
  from s_up u join s_all f on f.nid = u.ancestor and f.side = 'B' and f."rank" = 'family' join s_all n on n.nid = u.nid join s_all p on p.nid = n.sup""")
def _(spark, d):
    nodes = star(spark, d).nodes.filter("side = 'B'")
    families = nodes.filter("rank = 'family'").select("nid", F.col("taxonID").alias("family"))
    texts = nested.write_nested(nodes, families).join(families, F.col("root") == F.col("nid")).select("family", "text")
    rows = stage(nested.read_nested(stage(texts, "texts"), "family", "text"), "taxa")
    above = rows.select("family", F.col("taxonID").alias("_above"), F.col("canonicalName").alias("parent"))
    out = rows.withColumn("_above", F.concat("parentNameUsageID", "acceptedNameUsageID")).join(above, ["family", "_above"], "left")
    return out.select("family", "canonicalName", F.coalesce("parent", F.lit("")).alias("parent"), F.col("taxonomicStatus").alias("status"), F.col("taxonRank").alias("rank"))


# -- diffs, taxonomy dumps --------------------------------------------------------------------


def _diffs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = fx.table(spark, d, "customer")
    k = F.col("c_custkey")
    old, new = F.concat_ws("_", F.lit("Genus"), fx.letters(k)), F.concat_ws("_", F.lit("Genus"), fx.letters(k + (k % 3 == 0).cast("int")))
    words = F.array(*[F.lit(w) for w in ("add", "rename", "split (promotion)", "lump (demotion)", "split")])
    curated = c.filter("c_custkey % 7 <> 0").select(
        k.alias("_ord"), F.when(k % 11 == 0, "NA").otherwise(old).alias("MDDv1.10_Name"),
        F.when(k % 13 == 0, "NA").otherwise(new).alias("MDDv1.11_Name"), F.element_at(words, (k % 5 + 1).cast("int")).alias("Category"))
    ours = F.array(*[F.lit(w) for w in ("de novo", "spelling change", "split", "lump")])
    computed = c.filter("c_custkey % 5 <> 0").select(
        k.alias("_ord"), F.translate(old, "_", " ").alias("A name"), F.when(k % 17 == 0, "<!").when(k % 11 == 0, ">!").otherwise("=").alias("rcc5"),
        F.translate(new, "_", " ").alias("B name"), F.element_at(ours, (k % 4 + 1).cast("int")).alias("category"))
    return readers.read_diff(curated), readers.read_diff(computed)


_OLD, _NEW = f"'Genus ' || {O.letters('k')}", f"'Genus ' || {O.letters('(k + case when k % 3 = 0 then 1 else 0 end)')}"
O.define("x_d1", f"""select arg_max(list_extract(['de novo', 'spelling change', 'split', 'lump', 'split'], k % 5 + 1), k) cat, a, b from (select k, case when k % 11 = 0 then '' else {_OLD} end a, case when k % 13 = 0 then '' else {_NEW} end b from x_cust where k % 7 <> 0) group by a, b""")
O.define("x_d2", f"""select arg_max(list_extract(['de novo', 'spelling change', 'split', 'lump'], k % 4 + 1), k) cat, a, b from (select k, case when k % 17 <> 0 and k % 11 = 0 then '' else {_OLD} end a, case when k % 17 = 0 then '' else {_NEW} end b from x_cust where k % 5 <> 0) group by a, b""")
O.define("x_dj", "select coalesce(x.a, y.a) a, coalesce(x.b, y.b) b, coalesce(x.cat, '-') c1, coalesce(y.cat, '-') c2 from x_d1 x full join x_d2 y on x.a = y.a and x.b = y.b")


@query("compare_diffs", """select a "A name", b "B name", c1 "curated category", c2 "computed category" from x_dj where c1 <> c2""")
def _(spark, d):
    return diff.compare_diffs(*_diffs(spark, d))


@query("diff_counts", "select count(*) in_either, count(*) filter (c1 <> '-' and c2 <> '-') in_both from x_dj")
def _(spark, d):
    return diff.diff_counts(*_diffs(spark, d))


def _dump(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A taxonomy dump made of the part table, written and read back."""
    p = fx.table(spark, d, "part")
    k = F.col("p_partkey")
    bar = lambda *cells: F.concat(F.concat_ws("\t|\t", *cells), F.lit("\t|"))
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    rank = F.when(k % 9 == 0, "clade").when(k % 9 == 1, "no rank").otherwise("species")
    nodes = p.select(bar(k.cast("string"), (k - k % 10).cast("string"), rank, F.lit("XX")).alias("value"))
    lines = [(F.lit(True), F.col("p_name"), "", "scientific name"), (k % 2 == 0, F.concat("p_name", F.lit(" Brown, 1900")), "", "authority"),
             (k % 4 == 0, F.concat("p_name", F.lit(" Adams, 1850")), "", "authority"),
             (k % 7 == 3, F.lit("Gray, 1850"), "", "authority"), (k % 3 == 0, F.concat(F.lit("old "), F.col("p_name")), "u", "synonym"),
             (k % 6 == 0, F.concat(F.lit("old "), F.col("p_name")), "u", "synonym"), (k % 5 == 0, F.concat(F.lit("the "), F.col("p_type")), "", "common name")]
    names = p.select(F.explode(F.array_compact(F.array(*[
        F.when(test, bar(k.cast("string"), name, text(unique), text(kind))) for test, name, unique, kind in lines]))).alias("value"))
    merged = p.filter("p_partkey % 8 = 0").select(bar((k + 1000000).cast("string"), k.cast("string")).alias("value"))
    folder = new_path(spark, "dump")
    for label, df in (("nodes", nodes), ("names", names), ("merged", merged)):
        df.write.text(f"{folder}/{label}.dmp")
    return readers.read_ncbi(spark, folder)


_HASH = "substr(sha1({0} || '^' || {1} || '^' || {2}), 1, 8)"
O.define("x_nn", """select p_partkey k, p_name nm, '' u, 'scientific name' cl from part union all select p_partkey, p_name || ' Brown, 1900', '', 'authority' from part where p_partkey % 2 = 0
  union all select p_partkey, p_name || ' Adams, 1850', '', 'authority' from part where p_partkey % 4 = 0 union all select p_partkey, 'Gray, 1850', '', 'authority' from part where p_partkey % 7 = 3 union select p_partkey, 'old ' || p_name, 'u', 'synonym' from part where p_partkey % 3 = 0
  union all select p_partkey, 'the ' || p_type, '', 'common name' from part where p_partkey % 5 = 0""")
O.define("x_syn", f"""select cast(n.k as varchar) || '.' || {_HASH.format('n.nm', 'n.cl', 'n.u')} id, cast(n.k as varchar) acc, case when cl = 'authority' then nm end sci, case when cl <> 'authority' then nm end can,
  case when cl <> 'synonym' then cl end nom from x_nn n join part p on p.p_partkey = n.k where cl <> 'scientific name' and not (cl = 'authority' and starts_with(n.nm, p.p_name))""")


@query("dedupe_dump_names", f"select distinct cast(k as varchar) tax_id, {_HASH.format('nm', 'cl', 'u')} spin, cl name_class from x_nn")
def _(spark, d):
    return ncbi.dedupe_names(_dump(spark, d)[1]).select("tax_id", "spin", "name_class")


@query("dump_to_checklist", """select cast(p_partkey as varchar) taxonID, 'ncbi:' || p_partkey managed_id, cast(p_partkey - p_partkey % 10 as varchar) parentNameUsageID, case when p_partkey % 9 > 1 then 'species' end taxonRank,
   cast(null as varchar) acceptedNameUsageID, case when p_partkey % 4 = 0 then p_name || ' Adams, 1850' when p_partkey % 2 = 0 then p_name || ' Brown, 1900' end scientificName, p_name canonicalName, 'accepted' taxonomicStatus, cast(null as varchar) nomenclaturalStatus from part
  union all select id, null, null, null, acc, sci, can, 'synonym', nom from x_syn
  union all select cast(p_partkey + 1000000 as varchar), 'ncbi:' || (p_partkey + 1000000), null, null, cast(p_partkey as varchar), null, 'deprecated taxon that had taxid ' || (p_partkey + 1000000), 'synonym', 'merged id' from part where p_partkey % 8 = 0""")
def _(spark, d):
    return ncbi.ncbi_to_dwc(*_dump(spark, d))
