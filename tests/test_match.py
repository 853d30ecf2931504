import random

import pytest
from pyspark.sql import functions as F

from taxalign.functions import homotypy as H
from taxalign.operators import match as M, report
from taxalign.plans.align import Alignment
from taxalign.staging import stage

HEAD = """
f | Fam | | family | accepted | |
g | Genus | | genus | accepted | f |
h | Hortus | | genus | accepted | f |
"""


def outcomes(al):
    ids = {r.nid: r.taxonID for r in al.nodes.collect()}
    return {ids[r.spec]: r.outcome for r in al.decisions.collect()}


def test_mutual_best_rules(checklist):
    """One epithet per rule; `g` and `h` are genera, `f` their family."""
    a = """
1 | Genus a | Gray, 1850 | species | accepted | g |
2 | Genus b | Gray, 1850 | species | accepted | g |
3 | Genus c |  | species | accepted | g |
4 | Genus d | Gray, 1850 | species | accepted | g |
5 | Genus e | Gray, 1850 | species | accepted | g |
6 | Genus i | Gray, 1850 | species | accepted | f |
7 | Genus i | Gray, 1850 | species | accepted | f |
8 | Genus j | Gray, 1850 | species | accepted | g |
9 | Genus j | Gray, 1851 | species | accepted | f |
"""
    b = """
1 | Genus a | Gray, 1850 | species | accepted | g |
2 | Hortus b | (Gray, 1850) | species | accepted | h |
3 | Genus c |  | species | accepted | g |
4 | Genus d | Gray, 1850 | species | accepted | f |
40 | Genus d | Gray, 1850 | species | accepted | f |
5 | Genus e | Gray, 1850 | species | accepted | f |
50 | Genus e | Gray, 1850 | species | synonym |  | f
6 | Genus i | Gray, 1850 | species | accepted | g |
8 | Genus j | Gray, 1850 | species | accepted | g |
"""
    assert outcomes(Alignment(checklist(HEAD + a), checklist(HEAD + b))) == {
        "1": "match", "2": "match", "4": "B ambiguity", "5": "not both accepted",
        "6": "A ambiguity", "7": "A ambiguity", "8": "match", "9": "vee"}


def test_genus_change_needs_a_family_in_common(checklist):
    a = checklist(HEAD + "1 | Genus a | Gray, 1850 | species | accepted | g |")
    b = checklist("k | Kin | | family | accepted | |\nh | Hortus | | genus | accepted | k |\n2 | Hortus a | (Gray, 1850) | species | accepted | h |")
    assert outcomes(Alignment(a, b)) == {}
    moved = checklist(HEAD + "2 | Hortus a | (Gray, 1850) | species | accepted | h |")
    assert outcomes(Alignment(a, moved, motion="never")) == {}


def _brute(names_a, names_b):
    """All pairs, classified in plain Python; names are (genus, token, year), one epithet."""
    def cls(p, q):
        g, t, y = (x == z for x, z in zip(p, q))
        if not t and not y:
            return 0
        if t and y:
            return 10 if g else 8
        return 9 if g else 2
    return {i: [(cls(p, q), j) for j, q in enumerate(names_b) if cls(p, q) >= 8] for i, p in enumerate(names_a)}


def test_hot_block_against_brute_force(spark, checklist):
    """One epithet holds every record and one name a third of them; no pair may be lost."""
    rnd = random.Random(5)
    def names(n):
        return [("Aus", "Gray", "1850") if rnd.random() < 0.34 else
                (rnd.choice(["Aus", "Bus", "Cus"]), rnd.choice(["Gray", "Weber", "Thomas"]), str(rnd.randint(1850, 1856))) for _ in range(n)]
    na, nb = names(120), names(110)
    def rows(ns):
        return checklist("f | Fam | | family | accepted | |\n" + "\n".join(
            f"{i} | {g} x | {t}, {y} | species | accepted | f |" for i, (g, t, y) in enumerate(ns)))
    al = Alignment(rows(na), rows(nb))
    brute = _brute(na, nb)
    ids = {r.nid: (r.side, r.taxonID) for r in al.nodes.collect()}
    counts = {}
    for r in M.candidate_matches(al.records).collect():
        side, i = ids[r.nid]
        if side == "A":
            counts[int(i), r.cls] = r.n_partners
    want = {}
    for i, found in brute.items():
        for c, _ in found:
            want[i, c] = want.get((i, c), 0) + 1
    assert counts == want
    key = lambda j: (f"{nb[j][0]} x", str(j))  # importance among these: scientific name is blank, so the id
    for r in al.best.filter("side = 'A'").collect():
        i = int(ids[r.spec][1])
        top = max(c for c, _ in brute[i])
        tops = sorted((str(j) for c, j in brute[i] if c == top))
        assert r.cls == top
        assert ids[r.first][1] == tops[0]
        assert (ids[r.second][1] if r.second is not None else None) == (tops[1] if len(tops) > 1 else None)


def test_partner_counts_against_all_pairs(checklist):
    """Specimens of several records, which meet one partner in several groups of equal parts."""
    rnd = random.Random(8)

    def rows(n):
        lines = ["f | Fam | | family | accepted | |"]
        for i in range(n):
            lines.append(f"g{i} | {rnd.choice(['Aus', 'Bus', 'Cus'])} | | genus | accepted | f |")
            def name(k):
                author = f"{rnd.choice(['Gray', 'Weber', 'Thomas'])}, {rnd.choice(['1850', '1851', '1852'])}"
                return f"{i}_{k} | {rnd.choice(['Aus', 'Bus', 'Cus'])} {'xyz'[i % 3]} | {author}"
            lines.append(f"{name(0)} | species | accepted | g{i} |")
            lines += [f"{name(k)} | species | synonym | | {i}_0" for k in range(1, rnd.randint(1, 5))]
        return checklist("\n".join(lines))

    al = Alignment(rows(40), rows(45))
    records = al.records.collect()
    found = {}
    for x in records:
        for y in records:
            if x.side == y.side or x.key != y.key or x.epithet is None or x.epithet != y.epithet:
                continue
            g, t, z = (x[f] is not None and x[f] == y[f] for f in ("genus", "token", "year"))
            c = 10 if g and t and z else 9 if g and (t or z) else 8 if t and z and x.family and x.family == y.family else 0
            if c:
                mine = found.setdefault((x.side, x.spec), {})
                mine[y.spec] = max(mine.get(y.spec, 0), c)
    want = {k: {s for s, c in v.items() if c == max(v.values())} for k, v in found.items()}
    assert max(map(len, want.values())) > 2
    assert {(r.side, r.spec): r.n_partners for r in al.partner_counts.collect()} == {k: len(v) for k, v in want.items()}
    inside, sums, listed = {}, {}, {}
    groups = [r for r in al.partner_groups.collect()]
    same = lambda r: tuple(r[f] for f in ("key", "epithet", "cls", "genus", "token", "year", "family"))
    for r in groups:
        inside.setdefault((r.side, same(r)), set()).add(r.spec)
    for r in groups:
        if r.top:
            sums[r.side, r.spec] = sums.get((r.side, r.spec), 0) + r.n
            listed.setdefault((r.side, r.spec), set()).update(inside["AB".replace(r.side, ""), same(r)])
    assert listed == want
    assert any(n > len(want[k]) for k, n in sums.items())
    for r in M.review_counts(al.decisions, al.partner_counts).collect():
        assert r.n_partners == len(want["A", r.spec])


def test_components_of_a_hub_a_chain_and_pairs(spark):
    edges = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2060)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(50)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in M.connected_components(df).collect()}
    assert all(got[i] == 0 for i in [*range(300), 1000])
    assert all(got[i] == 2000 for i in range(2000, 2061))
    assert all(got[5001 + 2 * i] == 5000 + 2 * i for i in range(50))
    assert len(got) == 301 + 61 + 100


def test_top_two_are_limited_before_the_shuffle(spark, checklist):
    al = Alignment(checklist(HEAD + "1 | Genus a | Gray, 1850 | species | accepted | g |"), checklist(HEAD + "2 | Genus a | Gray, 1850 | species | accepted | g |"))
    plan = M.best_matches(al.records)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_masks_have_words(spark):
    row = spark.range(1).select(H.explain_masks(F.lit(8), F.lit(34)).alias("x"), H.explain_class(F.lit(5)).alias("c")).first()
    assert row.x == "hits(genus, epithet) misses(year)" and row.c == "authorless"


GENERA = "r | Root | | order | accepted | |\na | Aus | | genus | accepted | r |\n"


def test_relations_from_given_exemplars(checklist, spark):
    """Four pairs of species: congruent, containing, contained and overlapping."""
    a, b, given = [GENERA], [GENERA], []

    def species(rows, side, name, exemplars):
        """A species holding exemplars: its own, and one on a synonym for each other."""
        for n, e in enumerate(exemplars):
            taxon = name if n == 0 else f"{name}_{n}"
            rows.append(f"{taxon} | Aus {taxon} | | species | accepted | a |" if n == 0 else f"{taxon} | Aus {taxon} | | species | synonym | | {name}")
            given.append((e, side, taxon))

    for name, exemplars in {"eq": (1, 2), "wide": (3, 4), "narrow": (5, 6), "rest": (7,), "over": (8, 9), "side": (10,)}.items():
        species(a, "A", name, exemplars)
    for name, exemplars in {"eq": (1, 2), "part1": (3,), "part2": (4,), "all": (5, 6, 7), "x1": (8,), "x2": (9, 10)}.items():
        species(b, "1", name, exemplars)
    ex = spark.createDataFrame(given, "`exemplar id` bigint, checklist string, taxonID string")
    al = Alignment(checklist("\n".join(a)), checklist("\n".join(b)), given_exemplars=ex)
    got = {(r[0], r[3]): r for r in al.report.collect()}
    assert {k: r["RCC5"] for k, r in got.items()} == {
        ("eq", "eq"): "'=", ("wide", "part1"): ">", ("wide", "part2"): ">", ("narrow", "all"): "<", ("rest", "all"): "<",
        ("over", "x1"): ">", ("over", "x2"): "><", ("side", "x2"): "<"}
    row = got["over", "x2"]
    assert (row[5], row[6], row[7]) == ("9 over_1", "8 over", "10 side")


def test_report_invariants(spark):
    from taxalign import fixtures as fx
    from tests.conftest import SF

    al = Alignment(fx.checklist_a(spark, SF), fx.checklist_b(spark, SF))
    tops = {r.side: r.block_size for r in al.theory.nodes.filter("level = 1").collect()}
    assert tops["A"] == tops["B"] == al.exemplars.select("exemplar_id").distinct().count()
    # swapped inputs: the reversed relations (marked by the exemplars, whose ids come from A)
    back = Alignment(fx.checklist_b(spark, SF), fx.checklist_a(spark, SF))
    one = {(r[0], r[3]): r["RCC5"] for r in al.report.collect()}
    two = {(r[3], r[0]): r["RCC5"] for r in back.report.collect()}
    turn = {"<": ">", ">": "<"}
    assert {k: turn.get(v, v) for k, v in one.items()} == two
    counts = {r.comment: r.n for r in report.relation_counts(al.relations).collect()}
    assert sum(counts.values()) == len(one)
    merged = al.merged.collect()
    keys = {r.key for r in merged}
    assert all(r.superior in keys for r in merged if r.superior is not None)
    assert [r.key for r in merged if r.superior is None] == ["A!⊤"]


def _class_v8(p, q):
    """Plain reading of the version 8 rules for two sets of parts; None is unknown."""
    def ep(x):
        return x.genus.lower() if x.epithet == "" and x.genus else x.epithet

    def mid(x):
        return ep(x) if x.middle == "" and ep(x) is not None else x.middle

    def differ(a, b):
        return a is not None and b is not None and a != b

    if differ(p.epithet, q.epithet):
        return 0
    unknown = (p.epithet is not None and q.epithet is not None) + (None in (p.token, q.token)) + (None in (p.year, q.year))
    genus, middle = differ(p.genus, q.genus), differ(mid(p), mid(q))
    wrong = differ(p.token, q.token) + differ(p.year, q.year) + (genus or middle)
    if wrong > 1:
        return 1
    if unknown >= 2:
        return 5
    if genus:
        return 7 if p.protonymp and q.protonymp else 8
    return 8.5 if middle else 9 if wrong else 10


def test_version_8_against_brute_force(spark, checklist):
    """Unknown parts agree with any; no pair may be lost or made up."""
    rnd = random.Random(11)

    def rows(n):
        lines = ["f | Fam | | family | accepted | |", "e | Eam | | family | accepted | |"]
        for i in range(n):
            name = " ".join(x for x in (rnd.choice(["Aus", "Aus", "Bus", "?"]), rnd.choice(["", "", "m", "n", "?"]), rnd.choice(["x", "y", "x", "?", "Aus"])) if x)
            author = f"{rnd.choice(['Li', 'Gray', 'Someone'])}, {rnd.choice(['1850', '1851', '1111'])}"
            lines.append(f"{i} | {name} | {'(' + author + ')' if rnd.random() < 0.4 else author if rnd.random() < 0.9 else ''} | species | accepted | {rnd.choice('ffe')} |")
        return checklist("\n".join(lines))

    al = Alignment(rows(110), rows(100), version=8)
    records = {r.nid: r for r in al.records.select("nid", "spec", "side", "key", "family", "parts").collect()}
    want, partners = {}, {}
    for x in records.values():
        for y in records.values():
            if x.side != y.side and x.key == y.key:
                c = _class_v8(x.parts, y.parts)
                if c > 8 or (c == 8 and x.family == y.family):
                    want[x.nid, c] = want.get((x.nid, c), 0) + 1
                    partners.setdefault((x.side, x.spec), {}).setdefault(y.spec, []).append(c)
    assert {c for _, c in want} == {8, 8.5, 9, 10}
    assert {(r.nid, r.cls): r.n_partners for r in M.candidate_matches_v8(al.records).collect()} == want
    top = {s: max(max(c) for c in p.values()) for s, p in partners.items()}
    assert {(r.side, r.spec): r.cls for r in al.best.collect()} == top
    assert {(r.side, r.spec): r.n_partners for r in al.partner_counts.collect()} == {
        s: sum(max(c) == top[s] for c in p.values()) for s, p in partners.items()}
    # genus changes left out
    still = Alignment(al.a, al.b, motion="never", version=8)
    assert {(r.nid, r.cls) for r in M.candidate_matches_v8(still.records, "never").collect()} == {x for x in want if x[1] > 8}


def test_version_8_ties_declared_synonyms(checklist):
    rows = """
1 | Genus a | Gray, 1850 | species | accepted | g |
2 | Hortus a | Weber, 1900 | species | objective synonym | | 1
3 | Genus b | Gray, 1850 | species | accepted | g |
4 | Hortus b | Weber, 1900 | species | synonym | | 3
5 | Genus c | Gray, 1850 | species | accepted | g |
6 | Genus c | Li, 1850 | species | synonym | | 5
"""
    def ties(version):
        al = Alignment(checklist(HEAD + rows), checklist(HEAD), version=version)
        ids = {r.nid: r.taxonID for r in al.nodes.collect()}
        return {(ids[r.nid], ids[r["first"]]) for r in al.ties.collect()}

    assert ties(8) == {("2", "1"), ("6", "5")} and ties(7) == {("6", "5")}
    with pytest.raises(ValueError):
        Alignment(checklist(HEAD), checklist(HEAD), version=9)


def test_a_lump_costs_its_species(checklist, spark):
    """400 species of A against one of B: rows of the report grow with the species, not their square."""
    n = 400
    a = checklist("g | Aus | | genus | accepted | |\n" + "\n".join(f"s{i} | Aus s{i} | | species | accepted | g |" for i in range(n)))
    b = checklist("g | Aus | | genus | accepted | |\nm | Aus m | | species | accepted | g |\n" + "\n".join(f"s{i} | Aus s{i} | | species | synonym | | m" for i in range(n)))
    given = spark.createDataFrame([(i, side, f"s{i}") for i in range(n) for side in "AB"], "`exemplar id` bigint, checklist string, taxonID string")
    al = Alignment(a, b, given_exemplars=given)
    counts = report.alignment_counts(al.theory, al.relations).collect()
    assert len(counts) == n and {(r["in both A and B concepts"], r["in A concept but not in B concept"], r["in B concept but not in A concept"]) for r in counts} == {(1, 0, n - 1)}
    numbers = report.exemplar_numbers(al.theory)
    species = al.nodes.filter("rank = 'species' and accepted").select("nid")
    assert report.concept_ranges(species, al.theory, numbers).count() == n + 1
    assert report.shared_ranges(al.relations, al.theory, numbers).count() == n
    # no join of the plan makes more rows than there are members on a path
    assert {r.exemplar_id for r in al.exemplars.collect()} == {-1, *range(n)}


def test_block_sizes_count_an_exemplar_once(checklist, spark):
    """Members of one exemplar in several places meet at their common ancestors."""
    from taxalign.operators import theory as TH

    tree = "f | Fam | | family | accepted | |\n" + "".join(f"g{i} | G{i} | | genus | accepted | f |\n" for i in range(4)) + "\n".join(
        f"s{i} | G x{i} | | species | accepted | g{i % 4} |\nt{i} | G y{i} | | species | synonym | | s{i}" for i in range(24))
    rnd = random.Random(3)
    given = [(rnd.randint(0, 7), side, f"{rnd.choice('st')}{i}") for side in "AB" for i in range(24)]
    al = Alignment(checklist(tree), checklist(tree), given_exemplars=spark.createDataFrame(given, "`exemplar id` bigint, checklist string, taxonID string"))
    want = {}
    for r in TH.blocks(al.theory.members).collect():
        want[r.nid] = want.get(r.nid, 0) + 1
    assert {r.nid: r.block_size for r in al.theory.nodes.collect() if r.block_size} == want


def test_stored_tables_are_not_broadcast_unasked(spark, capsys):
    """Their files say little about their size in memory: 20,000 equal names are a few hundred bytes."""
    name = stage(spark.range(20_000).select("id", F.lit("a long name that repeats " * 8).alias("name")))
    exploded = name.select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("tag"), "name")
    for left, right in ((spark.range(10), name), (name, exploded), (exploded.groupBy("id").agg(F.count("*").alias("n")), name)):
        left.join(right, "id").explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    name.join(F.broadcast(spark.range(3)), "id").explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_decisions_broadcast_no_matches(spark, checklist, capsys):
    """The side of a join that is itself a join has no hint of its own; where no match is ambiguous it is all of them."""
    rows = "f|Felidae||family|accepted||\ng|Mus||genus|accepted|f|\n" + "\n".join(f"s{i}|Mus minor{i}|Gray, 1850|species|accepted|g|" for i in range(5))
    al = Alignment(checklist(rows), checklist(rows))
    out = M.match_decisions(al.best, al.nodes, al.ties)
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert {(r.spec + 1, r.outcome) for r in out.collect()} == {(r.v1, "match") for r in out.collect()}


def test_groups_meet_once(checklist, capsys):
    """Marking a specimen's best class reads its groups once: one join of specimens with the sizes of groups."""
    rows = HEAD + "1 | Genus a | Gray, 1850 | species | accepted | g |\n2 | Hortus b | Gray, 1850 | species | accepted | h |"
    other = HEAD + "1 | Genus a | Gray, 1850 | species | accepted | g |\n2 | Hortus b | Gray, 1851 | species | accepted | h |"
    al = Alignment(checklist(rows), checklist(other))
    out = M.partner_groups(al.records)
    out.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.count("Join") == 1
    tops = {(r.taxonID, r.side, r.cls, r.n): r.top for r in out.join(al.nodes.select(F.col("nid").alias("spec"), "taxonID"), "spec").collect()}
    assert tops["1", "A", H.HOMOTYPIC, 1] and not tops["1", "B", H.CORRECTION, 1] and tops["2", "A", H.CORRECTION, 1]


def test_names_are_parsed_once(checklist):
    """Links read the rows twice; what they read has the parts of the names already."""
    al = Alignment(checklist(HEAD), checklist(HEAD))
    assert {(r.taxonID, r.parts.canonical) for r in al.rows.collect()} == {("f", "Fam"), ("g", "Genus"), ("h", "Hortus")}
    assert al.nodes.filter("level > 1").count() == 6


def test_version_8_lists_tags_that_the_other_side_can_have(spark, checklist):
    """Where all parts are known on both sides, a record is listed once for each way, not under tags of unknown parts."""
    rows = "f|Felidae||family|accepted||\ng|Mus||genus|accepted|f|\n" + "\n".join(
        f"s{i}|Mus minor{i % 5}|(Gray, {1800 + i % 3})|species|accepted|g|" for i in range(30))
    run = Alignment(checklist(rows), checklist(rows), version=8)
    species = run.records.filter("epithet <> '' and canonicalName like '% %'")
    listed = M._lookups_v8(species, M._WAYS_V8).groupBy("nid").count()
    assert {r["count"] for r in listed.collect()} == {len(M._WAYS_V8)}
    # a key that the other side lacks is not listed at all
    assert M._lookups_v8(species.filter("side = 'A' or epithet = 'minor1'"), M._WAYS_V8).filter("epithet <> '=minor1'").isEmpty()


def test_best_matches_sort_no_texts_to_find_the_least(spark, capsys):
    """The most important partner is the least of numbers, which needs no sorted aggregate of texts; ties go by specimen."""
    rnd = random.Random(5)
    rows = []
    for nid in range(60):
        importance = (rnd.randint(1, 2), 0, -rnd.randint(0, 1), 0, rnd.choice("ab"), "t")
        part = lambda *of: rnd.choice([None, "", *of])
        rows.append(("AB"[nid % 2], (nid - 2 * rnd.randint(0, 1)) % 60, nid, importance, "k", rnd.choice(["e", "e,1"]), part("G", "1,G"), part("T"), part("1"), part("F")))
    struct = "struct<status int, form int, children int, synonyms int, scientific string, taxonID string>"
    records = spark.createDataFrame(rows, f"side string, spec bigint, nid bigint, importance {struct}, key string, epithet string, genus string, token string, year string, family string")
    out = M.best_matches(stage(records))
    out.explain()
    assert "SortAggregate" not in capsys.readouterr().out

    def ways(r):
        side, spec, nid, importance, key, e, g, t, y, f = r
        found = [(H.HOMOTYPIC, e, g, t, y, "")] if None not in (g, t, y) else []
        found += [(H.CORRECTION, e, g, t, "", "")] if None not in (g, t) else []
        found += [(H.CORRECTION, e, g, "", y, "")] if None not in (g, y) else []
        return found + ([(H.MOTION, e, "", t, y, f)] if None not in (t, y, f) else [])

    want = {}
    for r in rows:
        for q in rows:
            for w in set(ways(r)) & set(ways(q)):
                if r[0] != q[0]:
                    cands = want.setdefault((r[0], r[1]), {})
                    cls, least = cands.get(q[1], (w[0], q[3]))
                    cands[q[1]] = (max(cls, w[0]), min(least, q[3]))
    best = {}
    for who, cands in want.items():
        ranked = sorted((-cls, least, c) for c, (cls, least) in cands.items())
        best[who] = (-ranked[0][0], ranked[0][2], ranked[1][2] if len(ranked) > 1 and ranked[1][0] == ranked[0][0] else None)
    assert {(r.side, r.spec): (r.cls, r.first, r.second) for r in out.collect()} == best and len(best) > 20


def test_theory_looks_up_paths_not_members(checklist, spark, capsys):
    """Wanted nodes above members are found once per path; nodes without exemplars take the nearest above that has some."""
    from taxalign.operators import theory as TH

    tree = "f | Fam | | family | accepted | |\n" + "".join(f"g{i} | G{i} | | genus | accepted | f |\n" for i in range(4)) + "\n".join(
        f"s{i} | G x{i} | | species | accepted | g{i % 4} |\nt{i} | G y{i} | | species | synonym | | s{i}" for i in range(24))
    given = [(i, side, f"{'st'[i % 2]}{i}") for side in "AB" for i in range(0, 24, 3)]
    al = Alignment(checklist(tree), checklist(tree), given_exemplars=spark.createDataFrame(given, "`exemplar id` bigint, checklist string, taxonID string"))
    assert "parts" not in al.theory.nodes.columns
    every = {tuple(r) for r in TH.blocks(al.theory.members).collect()}
    for wanted in (al.nodes, al.nodes.filter("rank = 'species' and accepted"), al.nodes.filter("level > 99"), al.nodes.filter("level < 3")):
        nids = {r.nid for r in wanted.collect()}
        some = TH.blocks(al.theory.members, wanted)
        assert {tuple(r) for r in some.collect()} == {r for r in every if r[0] in nids}
    some.explain()
    plan = capsys.readouterr().out
    assert "Generate explode(_above" in plan and "Generate explode(path" not in plan
    full = {r[0] for r in every}
    for r in al.theory.nodes.collect():
        assert r.central == [n for n in r.path if n in full][-1]
