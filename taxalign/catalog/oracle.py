"""DuckDB SQL for the registered queries, put together from named sub-queries."""

from __future__ import annotations

_SEG = "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"
_SEGNAME = "['Automobile','Building','Furniture','Household','Machinery']"
_KIND = 1000000000000
_SYN = 4611686018427387904


def letters(n: str) -> str:
    return f"translate(cast({n} as varchar), '0123456789', 'abcdefghij')"


def cap(s: str) -> str:
    return f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"


def segname(seg: str) -> str:
    return f"list_extract({_SEGNAME}, cast({seg} + 1 as bigint))"


PARTS: dict[str, str] = {}


def define(name: str, body: str) -> None:
    PARTS[name] = body


def query(select: str) -> str:
    """A statement with every sub-query that ``select`` mentions, directly or not."""
    import re

    names = sorted(PARTS, key=len, reverse=True)
    word = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
    order: list[str] = []

    def visit(text: str, open_: tuple[str, ...]) -> None:
        for name in dict.fromkeys(word.findall(text)):
            if name not in open_ and name not in order:
                visit(PARTS[name], (*open_, name))
                order.append(name)

    visit(select, ())
    if not order:
        return select
    heads = [f"{n} AS {'' if _recursive(n) else 'MATERIALIZED '}({PARTS[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + select


def _recursive(name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", PARTS[name]) is not None


# -- checklists -----------------------------------------------------------------------------

define("x_cust", f"select c_custkey k, c_nationkey n, list_position({_SEG}, c_mktsegment) - 1 seg from customer")
define("x_bcust", """select k, n, case when k % 17 = 0 then (seg + 1) % 5 else seg end seg, k % 17 = 0 moved,
  (k % 11 = 0 and k > 0 and (k - 1) % 13 <> 0) syn from x_cust where k % 13 <> 0""")
_COLS = "_ord, taxonID, parentNameUsageID, acceptedNameUsageID, taxonRank, taxonomicStatus, canonicalName, scientificNameAuthorship, scientificName"


def _rows(kind: int, number: str, id_: str, parent: str, rank: str, name: str, source: str,
          author: str = "''", accepted: str = "''", status: str = "'accepted'") -> str:
    return f"""select {kind * _KIND} + {number} _ord, {id_} taxonID, {parent} parentNameUsageID, {accepted} acceptedNameUsageID,
  {rank} taxonRank, {status} taxonomicStatus, {name} canonicalName, {author} scientificNameAuthorship,
  trim({name} || ' ' || {author}) scientificName from {source}"""


_AUTH = f"'Smith' || {letters('n')} || ', ' || (1800 + k % 200)"
define("x_a", " union all ".join([
    _rows(1, "r_regionkey", "'R' || r_regionkey", "''", "'order'", cap("r_name"), "region"),
    _rows(2, "n_nationkey", "'N' || n_nationkey", "'R' || n_regionkey", "'family'", f"'Natio' || {letters('n_nationkey')}", "nation"),
    _rows(3, "(n * 10 + seg)", "'G' || n || '_' || seg", "'N' || n", "'genus'", segname("seg"), "(select distinct n, seg from x_cust)"),
    _rows(4, "k", "'S' || k", "'G' || n || '_' || seg", "'species'", f"{segname('seg')} || ' ' || {letters('k')}", "x_cust", _AUTH),
    _rows(5, "k", "'T' || k", "'S' || k", "'subspecies'", f"{segname('seg')} || ' ' || {letters('k')} || ' ' || {letters('k')}",
          "x_cust where k % 7 = 0", _AUTH)]))
_BAUTH = f"'Smith' || {letters('n')} || ', ' || (1800 + k % 200 + case when k % 19 = 0 and not moved then 1 else 0 end)"
_BAUTH = f"case when k % 23 = 0 then '' when moved then '(' || {_BAUTH} || ')' else {_BAUTH} end"
define("x_b", " union all ".join([
    _rows(1, "r_regionkey", "'bR' || r_regionkey", "''", "'order'", cap("r_name"), "region"),
    _rows(2, "n_nationkey", "'bN' || n_nationkey", "'bR' || case when n_nationkey % 10 = 0 then (n_regionkey + 1) % 5 else n_regionkey end",
          "'family'", f"'Natio' || {letters('n_nationkey')}", "nation"),
    _rows(3, "(n * 10 + seg)", "'bG' || n || '_' || seg", "'bN' || n", "'genus'", segname("seg"), "(select distinct n, seg from x_bcust)"),
    _rows(4, "k", "'bS' || k", "case when syn then '' else 'bG' || n || '_' || seg end", "'species'",
          f"{segname('seg')} || ' ' || {letters('k')}", "x_bcust", _BAUTH, "case when syn then 'bS' || (k - 1) else '' end",
          "case when syn then 'synonym' else 'accepted' end")]))
define("x_part", f"""select p_partkey k, {cap("split_part(p_name, ' ', 1)")} genus, regexp_replace(p_name, '^[^ ]+ ', '') epithet,
  'Brand' || {letters("split_part(p_brand, '#', 2)")} author, cast(1900 + p_size as varchar) "year", {cap('p_type')} fam_a,
  'Brand' || {letters("split_part(p_brand, '#', 2)")} fam_b from part""")
for _s in "ab":
    define(f"x_h{_s}", " union all ".join([
        _rows(1, "(row_number() over (order by fam))", "'F' || fam", "''", "'family'", "fam", f"(select distinct fam_{_s} fam from x_part)"),
        _rows(2, "(row_number() over (order by fam, genus))", "'G_' || fam || '_' || genus", "'F' || fam", "'genus'", "genus",
              f"(select distinct fam_{_s} fam, genus from x_part)"),
        _rows(3, "k", "'P' || k", f"'G_' || fam_{_s} || '_' || genus", "'species'", "genus || ' ' || epithet", "x_part",
              "author || ', ' || \"year\"")]))
define("x_g0", f"""select *, {letters('(k // 4)')} e0, {segname('seg')} g0, k % 6 in (1, 5) and k > 0 and not (b and (k - 1) % 23 = 0) syn from (
  select k, n, seg, false b from x_cust union all select k, n, case when k % 10 = 7 then (seg + 1) % 5 else seg end, true from x_cust where k % 23 <> 0)""")
define("x_g1", f"""select *, concat_ws(' ', case when k % 11 = 3 then '?' else g0 end, mid, case when k % 13 = 5 then '?' else e0 end) nm,
  case when k % 8 = 3 or (b and k % 20 = 17) then '(' || au || ')' else au end aut from (select *,
   case when k % 18 = 2 then '?' when k % 18 = 11 then {letters('(k % 7 + case when b and k % 4 = 1 then 1 else 0 end)')} end mid,
   case when k % 16 = 7 then 'Someone' when b and k % 17 = 4 then 'Weber' when k % 5 = 1 then 'Li' else 'Smith' || {letters('n % 3')} end || ', ' ||
   case when k % 14 = 9 then 1111 else 1800 + (k // 4) % 50 + case when b and k % 19 = 6 then 1 else 0 end end au from x_g0)""")
for _s, _is in (("", "not b"), ("b", "b")):
    define(f"x_guess{_s or 'a'}", " union all ".join([
        _rows(2, "n_nationkey", f"'{_s}N' || n_nationkey", "''", "'family'", f"'Natio' || {letters('n_nationkey')}", "nation"),
        _rows(3, "(n * 10 + seg)", f"'{_s}G' || n || '_' || seg", f"'{_s}N' || n", "'genus'", segname("seg"), f"(select distinct n, seg from x_g0 where {_is})"),
        _rows(4, "k", f"'{_s}S' || k", f"case when syn then '' else '{_s}G' || n || '_' || seg end", "case when mid is null then 'species' else 'subspecies' end",
              "nm", f"x_g1 where {_is}", "aut", f"case when syn then '{_s}S' || (k - 1) else '' end",
              "case when not syn then 'accepted' when k % 6 = 1 then 'objective synonym' else 'synonym' end")]))
define("x_tangled", """select _ord + again * 2000000000000 _ord, taxonID,
  case when chain or lost then '' when ring_down then 'S' || (k - 1) when ring_up then 'S' || (k + 1)
       when orphan then 'X' || k else parentNameUsageID end parentNameUsageID,
  case when lost and not chain then 'Y' || k when chain then 'S' || (k + 1) else acceptedNameUsageID end acceptedNameUsageID,
  case when k % 53 = 11 then 'family' when k % 41 = 7 then 'genus' else taxonRank end taxonRank,
  case when chain or lost or loose then 'synonym' when k % 59 = 3 then 'provisionally accepted name'
       when k % 5 = 4 then 'valid' else taxonomicStatus end taxonomicStatus,
  canonicalName, scientificNameAuthorship, scientificName,
  case when k is null then '' else cast(1800 + k * 7 % 150 as varchar) end namePublishedInYear
 from (select *, coalesce(k < last and k % 29 in (1, 2), false) chain, coalesce(k % 31 = 5, false) orphan,
         coalesce(k % 37 = 6, false) lost, coalesce(k % 47 = 10, false) loose,
         coalesce(k < last and k % 86 = 8, false) ring_up, coalesce(k < last and k % 86 = 9, false) ring_down,
         unnest(case when k % 61 = 17 then [0, 1] else [0] end) again
       from (select *, case when taxonRank = 'species' then cast(substr(taxonID, 2) as bigint) end k,
               (select max(c_custkey) - 3 from customer) last from x_a))""")

# -- trees ----------------------------------------------------------------------------------

# Ranks in increasing order, numbered from 1.
_RANKS = ("cluster,subform,forma,form,subvariety,varietas,variety,natio,subspecies,infraspecificname,species,species subgroup,"
          "species group,subgenus,genus,subtribe,tribe,supertribe,subfamily,family,superfamily,subsection,section,parvorder,"
          "infraorder,suborder,order,superorder,magnorder,megaorder,subcohort,cohort,subterclass,infraclass,subclass,class,"
          "superclass,subdivision,infraphylum,subphylum,phylum,superphylum,infrakingdom,division,subkingdom,kingdom,"
          "superkingdom,domain,top").split(",")


def rankno(rank: str) -> str:
    return f"list_position([{', '.join(repr(r) for r in _RANKS)}], {rank})"


def accepted(status: str) -> str:
    return (f"({status} = '' or starts_with({status}, 'accepted') or starts_with({status}, 'provisionally accepted') "
            f"or starts_with({status}, 'valid') or starts_with({status}, 'doubtful'))")


def tree(p: str, sources: dict[str, str]) -> None:
    define(f"{p}_id", " union all ".join(
        f"""select '{side}' side, *, {accepted('taxonomicStatus')} accepted,
  _ord * 2 + {bit} + case when {accepted('taxonomicStatus')} then 0 else {_SYN} end nid from {src}"""
        for bit, (side, src) in enumerate(sources.items())))
    define(f"{p}_link", f"""select w.*, t.taxonID is not null found,
  case when w.acceptedNameUsageID <> '' then case when t.nid is null then null when w.taxonomicStatus = 'equivalent' then 4 else 5 end else 1 end relation,
  case when w.acceptedNameUsageID <> '' then t.nid else coalesce(t.nid, case when w.side = 'A' then -2 else -1 end) end sup,
  case when w.acceptedNameUsageID <> '' then case when t.nid is not null then 'checklist (synonym)' end
       when t.nid is not null then 'checklist (child)' else 'inferior of top' end note,
  coalesce(t.accepted, true) sup_accepted, coalesce(t.taxonRank, 'top') sup_rank
 from {p}_id w left join (select side, taxonID, arg_min(nid, _ord) nid, arg_min(accepted, _ord) accepted, arg_min(taxonRank, _ord) taxonRank
   from {p}_id group by side, taxonID) t on w.side = t.side and t.taxonID = case when w.acceptedNameUsageID <> '' then w.acceptedNameUsageID else w.parentNameUsageID end""")
    define(f"{p}_climb", f"""select nid, relation, sup, note, sup_accepted, sup_rank, 0 step from {p}_link
 union all select c.nid, l.relation, l.sup, l.note, l.sup_accepted, l.sup_rank, c.step + 1
 from {p}_climb c join {p}_link l on c.sup = l.nid
 where not c.sup_accepted and c.relation <> 4 and l.sup is not null and c.step < 50""")
    define(f"{p}_node", f"""select w.* exclude (relation, sup, note, sup_accepted, sup_rank), c.relation, c.sup, c.note, c.sup_rank,
  coalesce(w.accepted and {rankno('w.taxonRank')} >= {rankno('c.sup_rank')}, false) rank_problem,
  case when coalesce(w.accepted and {rankno('w.taxonRank')} >= {rankno('c.sup_rank')}, false) then '' else w.taxonRank end "rank"
 from {p}_link w join (select nid, arg_max({{'relation': relation, 'sup': sup, 'note': note, 'sup_rank': sup_rank}}, step) e from {p}_climb group by nid) g on g.nid = w.nid,
 lateral (select g.e.relation relation, g.e.sup sup, g.e.note note, g.e.sup_rank sup_rank) c""")
    define(f"{p}_path", f"""select distinct case when side = 'A' then cast(-2 as bigint) else cast(-1 as bigint) end nid,
   [case when side = 'A' then cast(-2 as bigint) else cast(-1 as bigint) end] path from {p}_id
 union all select n.nid, list_append(t.path, n.nid) from {p}_path t join {p}_node n on n.sup = t.nid""")
    # a root row per side, then paths and counts
    define(f"{p}_all", f"""select n.side, n.nid, n.taxonID, n._ord, n.sup, n.relation, n.note, n.accepted, n."rank", n.taxonomicStatus,
   n.acceptedNameUsageID, n.parentNameUsageID, n.rank_problem, n.canonicalName, n.scientificName, n.scientificNameAuthorship, t.path, len(t.path) "level"
 from {p}_node n left join {p}_path t on t.nid = n.nid
 union all select case when nid = -2 then 'A' else 'B' end, nid, '⊤', -1, null, null, '', true, 'top', 'accepted', '', '', false, '⊤', '', '', path, 1 from {p}_path where nid < 0""")
    define(f"{p}_up", f"""select nid, unnest(path) ancestor, unnest(range(len(path) - 1, -1, -1)) distance from {p}_all where path is not null""")
    define(f"{p}_near", f"""select u.nid, arg_min(case when a."rank" = 'genus' and u.distance > 0 then a.nid end, case when a."rank" = 'genus' and u.distance > 0 then u.distance end) genus_above,
   arg_min(case when a."rank" = 'family' then a.nid end, case when a."rank" = 'family' then u.distance end) family_nid,
   arg_min(case when a."rank" = 'species' and a.accepted then a.nid end, case when a."rank" = 'species' and a.accepted then u.distance end) species_nid
 from {p}_up u join {p}_all a on a.nid = u.ancestor group by u.nid""")
    define(f"{p}_kids", f"""select sup nid, count(*) filter (accepted) n_children, count(*) filter (not accepted) n_synonyms from {p}_all where sup is not null group by sup""")
    define(f"{p}_tree", f"""select a.*, coalesce(k.n_children, 0) n_children, coalesce(k.n_synonyms, 0) n_synonyms, r.genus_above, r.family_nid, r.species_nid
 from {p}_all a left join {p}_kids k on k.nid = a.nid left join {p}_near r on r.nid = a.nid""")


tree("s", {"A": "x_a", "B": "x_b"})
tree("h", {"A": "x_ha", "B": "x_hb"})
tree("t", {"A": "x_tangled"})
tree("e", {"A": "x_guessa", "B": "x_guessb"})


def prefix(p: str, q: str) -> str:
    """Path p belongs to the node of path q or to an ancestor."""
    return f"(len({p}) <= len({q}) and {q}[len({p})] = {p}[len({p})])"


def in_tree(x: str, y: str) -> str:
    return f"""case when {x}.nid = {y}.nid then 4 when {x}.sup = {y}.nid then {x}.relation
  when {y}.sup = {x}.nid then list_extract([2, 1, 3, 4, 6, 5, 7], {y}.relation) when {prefix(y + '.path', x + '.path')} then 1
  when {prefix(x + '.path', y + '.path')} then 2 when {x}.sup = {y}.sup and (not {x}.accepted or not {y}.accepted) then 31 else 8 end"""


# -- names ----------------------------------------------------------------------------------

def authorship(table: str, column: str, p: str, least: int = 3) -> list[str]:
    """Three select layers that take an authorship apart; a name has a capital and ``least`` further letters."""
    return [
        f"""select *, case when regexp_extract({column}, '\\(\\b([12][0-9]{{3}})\\b\\)') <> ''
  then replace({column}, regexp_extract({column}, '\\(\\b([12][0-9]{{3}})\\b\\)'), regexp_extract({column}, '\\(\\b([12][0-9]{{3}})\\b\\)', 1)) else {column} end {p}text from {table}""",
        f"""select *, contains({p}text, '(') and contains({p}text, ')') {p}moved, regexp_replace(case when contains({p}text, '(') and contains({p}text, ')')
  then translate({p}text, '()', '') else {p}text end, '^(\\p{{Lu}}[.] )+', '') {p}plain from prev""",
        f"""select *, nullif(nullif(regexp_extract({p}plain, '\\p{{Lu}}[\\p{{L}}-]{{{least},}}'), ''), 'Someone') {p}token,
  nullif(nullif(regexp_extract({p}plain, '\\b([12][0-9]{{3}})\\b', 1), ''), '1111') {p}year,
  case when {column} <> '' then not {p}moved end {p}protonymp from prev"""]


def nest(layers: list[str]) -> str:
    out = layers[0]
    for layer in layers[1:]:
        out = layer.replace("from prev", f"from ({out})")
    return out


def polynomial(c: str) -> str:
    return f"(not contains({c}, ' × ') and not contains({c}, ' x '))"


def parse(name: str, source: str, best: str = "coalesce(nullif(scientificName, ''), nullif(canonicalName, ''), taxonID)", gn: bool = False, least: int = 3) -> None:
    full, stem, gauth = ("gn_canonical_full", "gn_canonical_stem", "gn_authorship") if gn else ("''", "''", "''")
    layers = [
        f"""select *, replace({best}, '  ', ' ') v, nullif(trim(canonicalName), '') can, nullif({full}, '') gfull, nullif({stem}, '') gstem, {gauth} gauth,
  case when scientificNameAuthorship = '' then {gauth} when ends_with(trim(scientificNameAuthorship), '.') then rtrim_one else trim(scientificNameAuthorship) end aut
 from (select *, substr(trim(scientificNameAuthorship), 1, greatest(length(trim(scientificNameAuthorship)) - 1, 0)) rtrim_one from {source})""",
        "select *, can is not null and not (ends_with(aut, ')') and not starts_with(aut, '(')) given, ends_with(v, ')') and contains(v, '(') paren from prev",
        r"""select *, case when paren then substr(v, 1, instr(v, '(') - 1) when regexp_extract(v, '^(.+?) (\(?\p{Lu}[\p{L}.''-]+.*)$', 2) <> ''
   then regexp_extract(v, '^(.+?) (\(?\p{Lu}[\p{L}.''-]+.*)$', 1) else v end c0,
  case when paren then substr(v, instr(v, '(')) else nullif(regexp_extract(v, '^(.+?) (\(?\p{Lu}[\p{L}.''-]+.*)$', 2), '') end a0 from prev""",
        """select *, case when given then can else nullif(trim(c0), '') end own, trim(case when given then aut else nullif(trim(a0), '') end, ', ') "by" from prev""",
        """select *, case when gfull is null then "by" else nullif(gauth, '') end used, case
   when gfull is null then case when """ + polynomial("own") + """ and contains(own, ' ') then 'words' else 'whole' end
   when not """ + polynomial("gfull") + """ then 'whole'
   when own is null or (gstem is not null and len(string_split(gfull, ' ')) >= len(string_split(trim(own), ' '))) then 'stem' else 'own words' end how from prev""",
        "select *, case how when 'stem' then coalesce(gstem, gfull) when 'own words' then trim(own) else coalesce(gfull, own) end nm from prev",
        "select *, string_split(nm, ' ') ws from prev",
        """select *, how = 'whole' or (how = 'stem' and len(ws) < 2) one, case when how = 'own words' then nm else coalesce(gfull, own) end p_canonical from prev""",
        """select *, nullif(case when how = 'whole' then nm else ws[1] end, '?') p_genus,
  nullif(case when one then '' else array_to_string(ws[2:len(ws) - 1], ' ') end, '?') p_middle, nullif(case when one then '' else ws[len(ws)] end, '?') p_epithet from prev"""]
    flat = nest(layers)
    first = nest([authorship(f"({flat})", "used", "u_")[0], *authorship("x", "used", "u_", least)[1:]])
    both = nest([authorship(f"({first})", '"by"', "o_")[0], *authorship("x", '"by"', "o_", least)[1:]])
    define(name, f"""select * , coalesce(u_token, o_token) p_token, least(u_year, o_year) p_year, coalesce(o_protonymp, u_protonymp) p_protonymp from ({both})""")


for _p in "shte":
    parse(f"{_p}_parts", f"(select * from {_p}_tree)", least=1 if _p == "e" else 3)
    define(f"{_p}_rec", f"""select r.*, f.canonicalName family, coalesce(nullif(p_epithet, ''), nullif(p_genus, ''), '?' || r.taxonID) key,
   case when p_epithet = '' and p_genus <> '' then lower(p_genus) else p_epithet end ep,
   case when p_epithet = '' then 4 when p_middle is not distinct from p_epithet then 2 when p_middle is null or p_middle = '' then 0 else 1 end form
 from {_p}_parts r left join {_p}_tree f on f.nid = r.family_nid where r."level" > 1""")


def masks(p: str, q: str, which: str) -> str:
    op = "is not distinct from" if which == "hits" else "is distinct from"
    terms = [
        (32, f"{p}.p_epithet is not null and {q}.p_epithet is not null and {p}.ep {op} {q}.ep"),
        (4, f"{p}.p_token is not null and {q}.p_token is not null and {p}.p_token {op} {q}.p_token"),
        (8, f"{p}.p_year is not null and {q}.p_year is not null and {p}.p_year {op} {q}.p_year"),
        (2, f"{p}.p_genus is not null and {q}.p_genus is not null and {p}.p_genus {op} {q}.p_genus"),
        (1, f"{p}.p_middle is not null and {q}.p_middle is not null and "
            f"case when {p}.p_middle = '' then {p}.p_epithet else {p}.p_middle end {op} case when {q}.p_middle = '' then {q}.p_epithet else {q}.p_middle end")]
    return " + ".join(f"case when {t} then {m} else 0 end" for m, t in terms)


def classify(m: str, h: str) -> str:
    return f"""case when ({h} & 32) = 0 or ({m} & 12) = 12 then 0 when ({h} & 12) = 12 then case when ({h} & 2) = 2 then 10 else 8 end
  when ({h} & 12) <> 0 then case when ({h} & 2) = 2 then 9 else 2 end when ({m} & 12) = 0 then 5 else 2 end"""


# -- matching -------------------------------------------------------------------------------

for _p in "sht":
    define(f"{_p}_first", f"""select *, first_value(nid) over (partition by genus_above, coalesce(nullif(p_epithet, ''), canonicalName)
   order by path[1:len(path) - 1], nid) f from {_p}_rec where genus_above is not null""")
    define(f"{_p}_ties", f"""select x.nid, x.f "first" from {_p}_first x join {_p}_rec y on y.nid = x.f
   where x.nid <> x.f and ({in_tree('y', 'x')}) <> 8 and ({classify(f'({masks("x", "y", "misses")})', f'({masks("x", "y", "hits")})')}) >= 8""")
    define(f"{_p}_spec", f"""select r.*, coalesce(t."first", r.nid) spec from {_p}_rec r left join {_p}_ties t on t.nid = r.nid""")
    define(f"{_p}_pairs", f"""select * from (select x.side, x.nid, x.spec, y.nid ynid, y.spec yspec, x.family xf, y.family yf,
     {{'s': case when y.accepted then 1 else 2 end, 'f': y.form, 'c': -y.n_children, 'y': -y.n_synonyms, 'n': y.scientificName, 't': y.taxonID}} imp,
     {classify(f'({masks("x", "y", "misses")})', f'({masks("x", "y", "hits")})')} cls
   from {_p}_spec x join {_p}_spec y on x.key = y.key and x.side <> y.side) where cls >= 9 or (cls = 8 and xf = yf)""")
    define(f"{_p}_cand", f"""select side, spec, yspec, max(cls) cls, min(imp) imp from {_p}_pairs group by side, spec, yspec""")
    define(f"{_p}_best", f"""select side, spec, max(cls) cls, max(yspec) filter (r = 1) "first", max(yspec) filter (r = 2 and cls = top) "second" from (
   select *, max(cls) over (partition by side, spec) top, row_number() over (partition by side, spec order by cls desc, imp, yspec) r from {_p}_cand) where r <= 2 group by side, spec""")
    define(f"{_p}_memb", f"""select "first" spec, nid from {_p}_ties union select "first", "first" from {_p}_ties""")


def representative(members: str, group: str, p: str) -> str:
    return f"""select {group}, side, arg_min(nid, ord) rep from (select m.{group}, r.side, r.nid,
     {{'a': coalesce(-{rankno('r."rank"')}, 0), 'b': case when exists (select 1 from {members} o where o.{group} = m.{group} and o.nid <> m.nid and list_contains(r.path, o.nid)) then 1 else 0 end,
      'c': case when coalesce(r.p_protonymp, false) then 0 else 1 end, 'd': case when r.accepted then 0 else 1 end, 'e': -r.n_children,
      'f': coalesce(r.p_year, '9999'), 'g': r.canonicalName, 'h': r.nid}} ord
   from {members} m join {p}_parts r on r.nid = m.nid) group by {group}, side"""


for _p in "sh":
    define(f"{_p}_srep", representative(f"{_p}_memb", "spec", _p))
    define(f"{_p}_check", f"""select b.side, b.spec, b.cls, b."first", b."second", ({in_tree('x', 'y')}) & 8 <> 0 apart, x.accepted and y.accepted both_acc
   from {_p}_best b left join {_p}_srep m on m.spec = b."first" left join {_p}_srep n on n.spec = b."second"
   left join {_p}_all x on b."second" is not null and x.nid = coalesce(m.rep, b."first") left join {_p}_all y on y.nid = coalesce(n.rep, b."second")""")
    define(f"{_p}_dec", f"""select a.spec, a.cls, a."first", a."second", b."first" bf, b."second" bs, case
    when a."second" is not null then case when not a.both_acc then 'not both accepted' when a.apart then 'B ambiguity' else 'double B' end
    when b.spec is null then 'no return' when b."second" is not null then case when b.apart then 'A ambiguity' else 'double A' end
    when b."first" <> a.spec then 'vee' else 'match' end outcome
   from {_p}_check a left join {_p}_check b on b.side = 'B' and b.spec = a."first" where a.side = 'A'""")
    define(f"{_p}_edge", f"""select spec u, "first" v from {_p}_dec where outcome in ('match', 'double B') union select spec, "second" from {_p}_dec where outcome = 'double B'
   union select bf, "first" from {_p}_dec where outcome = 'double A' union select bs, "first" from {_p}_dec where outcome = 'double A'""")
    define(f"{_p}_reach", f"""select u s, u t from {_p}_edge union select v, v from {_p}_edge
   union select r.s, case when e.u = r.t then e.v else e.u end from {_p}_reach r join {_p}_edge e on e.u = r.t or e.v = r.t""")
    define(f"{_p}_comp", f"select s spec, min(t) comp from {_p}_reach group by s")
    define(f"{_p}_ex", f"""select m.exemplar_id, s.side, s.nid from {_p}_comp c join {_p}_spec s on s.spec = c.spec join (
     select comp, min(_ord) exemplar_id from {_p}_comp c join {_p}_spec s on s.spec = c.spec where s.side = 'A' group by comp) m on m.comp = c.comp
   union all select -1, 'A', -2 union all select -1, 'B', -1""")

# -- theory, merge, report (for the star checklists) ------------------------------------------

define("s_erep", representative("s_ex", "exemplar_id", "s"))
define("s_look", """select e.exemplar_id, max(rep) filter (e.side = 'A') rep_a, max(rep) filter (e.side = 'B') rep_b from s_erep e group by e.exemplar_id""")
define("s_label", """select l.*, case when p.p_epithet <> '' then p.p_epithet else p.p_genus end epithet, a.species_nid species_a, b.species_nid species_b
  from s_look l join s_parts p on p.nid = l.rep_a join s_tree a on a.nid = l.rep_a join s_tree b on b.nid = l.rep_b""")
define("s_block", "select distinct u.ancestor nid, e.side, e.exemplar_id from s_ex e join s_up u on u.nid = e.nid")
define("s_size", "select nid, count(*) block_size from s_block group by nid")
define("s_opp", """select b.nid, t.path from s_block b join s_look l on l.exemplar_id = b.exemplar_id
  join s_tree t on t.nid = case when b.side = 'A' then l.rep_b else l.rep_a end""")
define("s_cross", """select nid, arg_max(anc, len_) cross_nid from (select o.nid, anc, count(*) n, max(len_) len_ from (
   select nid, unnest(path) anc, unnest(range(1, len(path) + 1)) len_ from s_opp) o group by o.nid, anc) g join s_size s using (nid) where n = block_size group by nid""")
define("s_mono", "select t.sup nid from s_tree t join s_size s on s.nid = t.nid where t.sup is not null group by t.sup having count(*) = 1")
define("s_th", f"""select t.*, coalesce(z.block_size, 0) block_size, {rankno('t."rank"')} rank_no, c.cross_nid, m.nid is not null mono,
   m.nid is null and coalesce(coalesce(ps.block_size, 0) <> coalesce(z.block_size, 0), true) uniq
  from s_tree t left join s_size z on z.nid = t.nid left join s_size ps on ps.nid = t.sup left join s_cross c on c.nid = t.nid left join s_mono m on m.nid = t.nid""")
define("s_th2", """select t.*, c.central, case when t.block_size > 0 then 4 when t.sup = c.central then t.relation else 1 end central_relation
  from s_th t join (select u.nid, arg_min(u.ancestor, u.distance) central from s_up u join s_size z on z.nid = u.ancestor group by u.nid) c on c.nid = t.nid""")


def within_block(x: str, y: str) -> str:
    return f"""case when {x}.uniq and {y}.uniq then 4 when not {x}.accepted and {y}.accepted then 5 when {x}.accepted and not {y}.accepted then 6
   when {x}.rank_no is null or {y}.rank_no is null then 7 when {x}.rank_no < {y}.rank_no then 1 when {x}.rank_no = {y}.rank_no then 4 else 2 end"""


def central_relation(x: str, y: str, n: str) -> str:
    return f"""case when {n} = {x}.block_size and {n} = {y}.block_size then {within_block(x, y)} when {n} = {x}.block_size then 1
   when {n} = {y}.block_size then 2 when {n} = 0 then 8 else 16 end"""


# Composition of base relations in the order < > = ! ><, as bit sets.
_BASE = {1: [1, 31, 1, 8, 25], 2: [23, 2, 2, 26, 18], 4: [1, 2, 4, 8, 16], 8: [25, 8, 8, 31, 25], 16: [17, 26, 16, 26, 31]}


def compose(r: str, s: str) -> str:
    bits = (1, 2, 4, 8, 16)
    table = []
    for i in range(32):
        for j in range(32):
            code = 0
            for b in bits:
                for n, c in enumerate(bits):
                    if i & b and j & c:
                        code |= _BASE[b][n]
            table.append(code)
    return f"list_extract({table}, cast(({r}) * 32 + ({s}) + 1 as bigint))"


def reverse(r: str) -> str:
    return f"((({r}) & 28) | ((({r}) & 1) << 1) | ((({r}) & 2) >> 1))"


def compared(name: str, pairs: str) -> None:
    """(u, v, cu, cv, n_both, relation) of node pairs of opposite checklists."""
    define(f"{name}_c", f"select distinct p.u, p.v, x.central cu, y.central cv, x.central_relation ru, y.central_relation rv from ({pairs}) p join s_th2 x on x.nid = p.u join s_th2 y on y.nid = p.v")
    define(f"{name}_n", f"""select d.cu, d.cv, count(b.exemplar_id) n from (select distinct cu, cv from {name}_c) d join s_block a on a.nid = d.cu
  left join s_block b on b.nid = d.cv and b.exemplar_id = a.exemplar_id group by d.cu, d.cv""")
    define(name, f"""select c.u, c.v, x.block_size n_u, y.block_size n_v, n.n n_both, {compose('c.ru', compose(central_relation('x', 'y', 'n.n'), reverse('c.rv')))} relation
  from {name}_c c join {name}_n n on n.cu = c.cu and n.cv = c.cv join s_th2 x on x.nid = c.cu join s_th2 y on y.nid = c.cv""")


compared("s_chain", "select t.nid u, a.ancestor v from s_th2 t join s_up a on a.nid = t.cross_nid where t.block_size > 0")
define("s_est0", """select u nid, arg_min(v, d) est, arg_min(relation, d) relation from (select c.*, a.distance d from s_chain c join s_th2 t on t.nid = c.u
  join s_up a on a.nid = t.cross_nid and a.ancestor = c.v where (c.relation & 26) = 0) group by u""")
define("s_est", f"""select t.nid, e.est, {compose('t.central_relation', 'e.relation')} relation from s_th2 t join s_est0 e on e.nid = t.central""")
define("s_equiv", "select e.nid, e.est from s_est e join s_tree x on x.nid = e.nid join s_tree y on y.nid = e.est where e.relation = 4 and x.accepted = y.accepted")
define("s_gone", "select q.nid, q.est from s_equiv q join s_tree t on t.nid = q.nid where t.side = 'B'")
define("s_partner", """select distinct b.nid, b.side, case when b.side = 'A' then l.species_b else l.species_a end partner
  from s_block b join s_tree t on t.nid = b.nid and t.accepted and t."rank" = 'species' join s_label l on l.exemplar_id = b.exemplar_id
  where case when b.side = 'A' then l.species_b else l.species_a end is not null""")
define("s_rows", """select distinct case when t.side = 'A' then t.nid else p.partner end u, case when t.side = 'A' then p.partner else t.nid end v
  from s_tree t left join s_partner p on p.nid = t.nid where t.accepted and t."rank" = 'species' and t.nid not in (select nid from s_gone)""")
compared("s_cmp", "select u, v from s_rows where u is not null and v is not null")
define("s_rel", "select r.u, r.v, c.relation from s_rows r left join s_cmp c on c.u = r.u and c.v = r.v")
define("s_cos0", f"""select e.nid, case when t.accepted then e.est else t.sup end v, case when t.accepted then e.relation else {compose('e.relation', 't.relation')} end rel
  from s_est e join s_tree t on t.nid = e.est""")
define("s_cos", f"""select * from (select c.nid, case when e.est is not distinct from c.nid then t.sup else c.v end cos,
  case when e.est is not distinct from c.nid then {compose('c.rel', 't.relation')} else c.rel end relation
  from s_cos0 c left join s_est e on e.nid = c.v join s_tree t on t.nid = c.v) where cos is not null""")
define("s_sup0", """select t.nid, t.side, t.sup, t.relation own_rel, c.cos, c.relation cos_rel from s_tree t left join s_cos c on c.nid = t.nid
  where t.nid not in (select nid from s_gone)""")
compared("s_supcmp", "select sup u, cos v from s_sup0 where sup is not null and cos is not null")
define("s_merged", """select m.nid, m.side, coalesce(g.est, m.sup) sup, m.relation from (select s.nid, s.side,
   case when s.sup is null or coalesce(c.relation in (2, 6), false) then s.cos else s.sup end sup,
   case when s.sup is null or coalesce(c.relation in (2, 6), false) then s.cos_rel else s.own_rel end relation
  from s_sup0 s left join s_supcmp c on c.u = s.sup and c.v = s.cos) m left join s_gone g on g.nid = m.sup""")
# Texts of the relation codes.
_SYMBOLS = {0: "⋕", 1: "<", 2: ">", 4: "=", 8: "!", 16: "><", 5: "<=", 6: ">=", 7: "<=>", 23: "not!", 27: "not=", 31: "?", 9: "<!", 10: ">!"}


def symbol(r: str) -> str:
    names = [_SYMBOLS.get(i) or "{" + " ".join(_SYMBOLS[b] for b in (1, 2, 4, 8, 16) if i & b) + "}" for i in range(32)]
    return f"list_extract([{', '.join(repr(n) for n in names)}], cast({r} + 1 as bigint))"


define("s_venn", """select r.u, r.v, l.exemplar_id, l.epithet, case when a.nid is null then 'only_b' when b.nid is null then 'only_a' else 'both' end part
  from (select u, v from s_rel where relation is not null) r join s_label l on true
  left join s_block a on a.nid = r.u and a.exemplar_id = l.exemplar_id left join s_block b on b.nid = r.v and b.exemplar_id = l.exemplar_id
  where a.nid is not null or b.nid is not null""".replace("join s_label l on true", """join (select distinct r2.u u2, r2.v v2, b2.exemplar_id e2 from s_rel r2 join s_block b2 on b2.nid = r2.u or b2.nid = r2.v
   where r2.relation is not null) q on q.u2 = r.u and q.v2 = r.v join s_label l on l.exemplar_id = q.e2"""))

# -- version 8, for the checklists with unknown parts -----------------------------------------


def classify_v8(x: str, y: str) -> str:
    mid = "case when {0}.p_middle = '' and {0}.ep is not null then {0}.ep else {0}.p_middle end"
    td, yd, gd = (f"coalesce({x}.p_{c} <> {y}.p_{c}, false)" for c in ("token", "year", "genus"))
    md = f"coalesce({mid.format(x)} <> {mid.format(y)}, false)"
    mis = f"(cast({td} as int) + cast({yd} as int) + cast({md} or {gd} as int))"
    unknown = (f"(cast({x}.p_token is null or {y}.p_token is null as int) + cast({x}.p_year is null or {y}.p_year is null as int)"
               f" + cast(coalesce({x}.p_epithet = {y}.p_epithet, false) as int))")
    return f"""cast(case when coalesce({x}.p_epithet <> {y}.p_epithet, false) then 0 when {mis} > 1 then 1 when {unknown} >= 2 then 5
   when {gd} and coalesce({x}.p_protonymp and {y}.p_protonymp, false) then 7 when {gd} then 8 when {md} then 8.5 when {mis} > 0 then 9 else 10 end as double)"""


def related_v8(name: str, pairs: str, p: str) -> None:
    """(x, y, relation) of pairs of nodes of one tree: both climb to equal level, edge labels compose."""
    define(f"{name}_r", f"""select x.nid x, y.nid y, x3.nid x3, y3.nid y3, case when xs.n_lt > x3s.n_lt then 1 when xs.n_le > x3s.n_le then 5 else 4 end rx,
   case when ys.n_lt > y3s.n_lt then 1 when ys.n_le > y3s.n_le then 5 else 4 end ry from ({pairs}) q join {p}_all x on x.nid = q.x join {p}_all y on y.nid = q.y
   join {p}_all x3 on x3.nid = x.path[least(len(x.path), len(y.path))] join {p}_all y3 on y3.nid = y.path[least(len(x.path), len(y.path))]
   join {p}_sums xs on xs.nid = x.nid join {p}_sums ys on ys.nid = y.nid join {p}_sums x3s on x3s.nid = x3.nid join {p}_sums y3s on y3s.nid = y3.nid""")
    bridge = "case when x3 = y3 then 4 when rx <> 5 and ry <> 5 then 8 else 31 end"
    define(name, f"select distinct x, y, {compose(compose('rx', bridge), reverse('ry'))} relation from {name}_r")


define("e_sums", """select u.nid, sum(case when a.relation = 1 then 1 else 0 end) n_lt, sum(case when a.relation = 5 then 1 else 0 end) n_le
  from e_up u join e_all a on a.nid = u.ancestor group by u.nid""")
define("e_first", PARTS["s_first"].replace("s_rec", "e_rec"))
related_v8("e_meet", "select nid x, f y from e_first where nid <> f", "e")
define("e_ties", f"""select x.nid, x.f "first" from e_first x join e_rec y on y.nid = x.f join e_meet m on m.x = x.nid and m.y = x.f
   where (m.relation & 8) = 0 and (({classify_v8('x', 'y')}) >= 8 or (contains(x.taxonomicStatus, 'objective') and x.sup = y.nid)
     or (contains(y.taxonomicStatus, 'objective') and y.sup = x.nid))""")
define("e_spec", PARTS["s_spec"].replace("s_rec", "e_rec").replace("s_ties", "e_ties"))
define("e_pairs", f"""select * from (select x.side, x.nid, x.spec, y.nid ynid, y.spec yspec, x.family xf, y.family yf,
     {{'s': case when y.accepted then 1 else 2 end, 'f': y.form, 'c': -y.n_children, 'y': -y.n_synonyms, 'n': y.scientificName, 't': y.taxonID}} imp,
     {classify_v8('x', 'y')} cls from e_spec x join e_spec y on x.key = y.key and x.side <> y.side) where cls > 8 or (cls = 8 and xf = yf)""")
define("e_two", """select b.side, b.spec, b.cls, b."first", b."second", coalesce(m.rep, b."first") x, coalesce(n.rep, b."second") y from e_best b
   left join e_srep m on m.spec = b."first" left join e_srep n on n.spec = b."second" """)
related_v8("e_apart", 'select x, y from e_two where "second" is not null', "e")
define("e_check", """select b.*, (r.relation & 8) <> 0 apart, x.accepted and y.accepted both_acc from e_two b
   left join e_apart r on r.x = b.x and r.y = b.y and b."second" is not null
   left join e_all x on b."second" is not null and x.nid = b.x left join e_all y on y.nid = b.y""")


def for_guessed(select: str) -> str:
    """The same statement over the checklists with unknown parts; all that it needs is derived from the star's."""
    import re

    for name, body in list(PARTS.items()):
        if name.startswith("s_") and "e_" + name[2:] not in PARTS:
            define("e_" + name[2:], re.sub(r"\bs_", "e_", body))
    return re.sub(r"\bs_", "e_", select)
