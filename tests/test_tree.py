import itertools

import pytest
from pyspark.sql import functions as F

from taxalign.functions import rcc5
from taxalign.operators import tree as T
from taxalign.operators.numbering import number_within
from taxalign.staging import stage

SMALL = """
r | Root     |  | family  | accepted |   |
g | Genus    |  | genus   | accepted | r |
a | Genus a  |  | species | accepted | g |
b | Genus b  |  | species | accepted | g |
s | Genus s  |  | species | synonym  |   | a
t | Genus a a|  | subspecies | valid | a |
u | Genus u  |  | species | synonym  |   | s
"""


def by_id(nodes, *columns):
    return {r.taxonID: r for r in nodes.collect()}


def test_links_levels_and_counts(checklist):
    nodes = T.build_tree(checklist(SMALL))
    rows = by_id(nodes)
    ids = {r.nid: i for i, r in rows.items()}
    assert {i: ids.get(r.sup) for i, r in rows.items()} == {
        "⊤": None, "r": "⊤", "g": "r", "a": "g", "b": "g", "s": "a", "t": "a", "u": "a"}
    assert rows["u"].relation == rcc5.LE and rows["t"].relation == rcc5.LT
    assert (rows["a"].n_children, rows["a"].n_synonyms) == (1, 2)
    assert [ids[n] for n in rows["u"].path] == ["⊤", "r", "g", "a", "u"]
    assert ids[rows["t"].species_nid] == "a" and ids[rows["t"].family_nid] == "r"


def test_trees_broadcast_no_nodes(checklist, monkeypatch, capsys):
    """A union of stored tables has no hint of its own: all rows were broadcast when they met their places."""
    def told(df, *args):
        df.explain()
        return stage(df, *args)

    monkeypatch.setattr(T, "stage", told)
    out = T.build_tree(checklist(SMALL))
    joins = [line for line in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in line]
    # one row per sort partition is broadcast
    assert joins and all("[_part" in line for line in joins)
    assert out.filter("path is not null").count() == 8


def test_in_tree_relations_of_all_pairs(checklist, spark):
    nodes = T.build_tree(checklist(SMALL))
    ids = {r.nid: r.taxonID for r in nodes.collect()}
    pairs = spark.createDataFrame(list(itertools.product(ids, repeat=2)), "x bigint, y bigint")
    rel = {(ids[r.x], ids[r.y]): (r.relation, ids[r.mrca]) for r in T.compare_in_tree(pairs, nodes).collect()}
    assert rel["a", "a"][0] == rcc5.EQ
    assert rel["s", "a"] == (rcc5.LE, "a") and rel["a", "s"] == (rcc5.GE, "a")
    assert rel["t", "g"] == (rcc5.LT, "g") and rel["r", "t"][0] == rcc5.GT
    assert rel["a", "b"] == (rcc5.DISJOINT, "g")
    assert rel["s", "t"] == (rcc5.NOINFO, "a") and rel["s", "u"][0] == rcc5.NOINFO
    assert rel["t", "b"][0] == rcc5.DISJOINT
    for (x, y), (r, m) in rel.items():
        back = rel[y, x]
        assert back[1] == m
        assert {1: 2, 2: 1, 5: 6, 6: 5}.get(r, r) == back[0]


def test_faults_are_reported_and_kept_off_the_tree(checklist):
    nodes = T.build_tree(checklist("""
x | X |  | genus | accepted | y |
y | Y |  | genus | accepted | x |
o | O |  | genus | accepted | nowhere |
l | L |  | genus | synonym  |   | nowhere
n | N |  | genus | synonym  |   |
p | P |  | family | accepted |  |
q | Q |  | family | accepted | p |
w | W |  | odd    | accepted | p |
m | M |  | species | synonym |  | n2
n2| M2|  | species | synonym |  | m
"""))
    found = {(r.problem, r.taxonID) for r in T.validate(nodes.filter('nid >= 0'), nodes).collect()}
    assert {("unreachable", i) for i in "x y l m n2".split()} <= found
    assert {("unresolved accepted id", "l"), ("synonym without accepted id", "n"), ("unknown parent", "o"), ("rank out of order", "q")} <= found
    rows = by_id(nodes)
    assert rows["q"].rank == "" and rows["w"].rank == "odd"


def test_row_and_partition_order_do_not_matter(checklist, spark):
    df = checklist(SMALL)
    one = {r.taxonID: r.path for r in T.build_tree(df).collect()}
    two = {r.taxonID: r.path for r in T.build_tree(df.orderBy(F.rand(7)).repartition(5)).collect()}
    assert one == two


def test_subset_is_idempotent_and_whole(checklist):
    df = checklist(SMALL)
    sub = T.subset(df, "Genus a")
    assert {r.taxonID for r in sub.collect()} == {"a", "s", "t", "u"}
    assert {r.taxonID: r.parentNameUsageID for r in sub.collect()}["a"] == ""
    again = T.subset(sub, "a")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sub.collect()))
    with pytest.raises(ValueError):
        T.subset(df, "nobody")
    with pytest.raises(ValueError):
        T.subset(df, "b")


def test_deep_chain(spark):
    rows = [(i, f"n{i}", f"n{i - 1}" if i else "") for i in range(300)]
    df = spark.createDataFrame(rows, "_ord bigint, taxonID string, parentNameUsageID string")
    top = T.build_tree(df).agg(F.max("level")).first()[0]
    assert top == 301


def test_numbering_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    got = {(r.k, r.o): r.n for r in number_within(df, ["k"], ["o"]).collect()}
    groups = {}
    for k, o in got:
        groups.setdefault(k, []).append(o)
    assert len(got) == 3000
    for k, os in groups.items():
        assert [got[k, o] for o in sorted(os)] == list(range(1, len(os) + 1))


def test_intervals_and_both_orders_against_a_walk(checklist, spark):
    nodes = T.build_tree(checklist(SMALL))
    rows = by_id(nodes)
    kids = {}
    for r in rows.values():
        kids.setdefault(r.sup, []).append(r)
    pre, post = [], []

    def walk(r):
        pre.append(r.taxonID)
        for c in sorted(kids.get(r.nid, []), key=lambda c: c.nid):
            walk(c)
        post.append(r.taxonID)

    walk(rows["⊤"])
    assert [rows[i].pre for i in pre] == list(range(1, len(pre) + 1))
    assert [rows[i].post for i in post] == list(range(1, len(post) + 1))
    for i, r in rows.items():
        under = {j for j, q in rows.items() if r.nid in q.path}
        assert {j for j, q in rows.items() if r.pre <= q.pre <= r.last} == under
        assert {x.taxonID for x in T.below(nodes, i).collect()} == under
    plan = T.below(nodes, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "path" not in plan.split("Filter")[0] or "Generate" not in plan


def test_repeated_ids_are_reported_and_mean_the_first(checklist):
    df = checklist("r | Root | | family | accepted | |\ng | Genus | | genus | accepted | r |\ng | Other | | genus | synonym | | r\na | Genus a | | species | accepted | g |")
    rows = T.identify(df)
    nodes = T.build_forest(rows)
    at = {(r.taxonID, r.canonicalName): r for r in nodes.collect()}
    assert len(at) == 5 and at["a", "Genus a"].sup == at["g", "Genus"].nid
    found = {(r.problem, r.taxonID) for r in T.validate(rows, nodes).collect()}
    assert ("repeated key", "g") in found and not any(p == "row count" for p, _ in found)
    assert [tuple(r) for r in T.reconcile(rows, nodes).collect()] == [("A", 4, 4, 4, True)]


def test_lost_rows_are_reconciled(checklist):
    rows = T.identify(checklist("x | X | | genus | accepted | y |\ny | Y | | genus | accepted | x |\nz | Z | | genus | accepted | |"))
    nodes = T.build_forest(rows)
    assert [tuple(r) for r in T.reconcile(rows, nodes).collect()] == [("A", 3, 3, 1, False)]
    assert ("row count", "A") in {(r.problem, r.taxonID) for r in T.validate(rows, nodes).collect()}


def test_subset_by_chains_rings_and_forks(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("f", "d"), ("f", "x"), ("g", "f"), ("h", "q"), ("h", "z"), ("i", "h"), ("a", "top"), ("k", "g"), ("k", "x")]
    df = spark.createDataFrame(links, "id string, above string")
    got = {r.id for r in T.reachable_ids(df, "a").collect()}
    assert got == set("abcdfgk")
    deep = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(200)], "id string, above string")
    assert T.reachable_ids(deep, "n150").count() == 51


def test_sums_along_paths_against_a_walk(checklist, capsys):
    """Also where rows repeat; and pairs read stored sums instead of exploding paths once for each of their ends."""
    nodes = T.build_tree(checklist("""
        a|A||order|accepted||
        b|B||family|accepted|a|
        c|C||genus|accepted|b|
        d|C d||species|accepted|c|
        e|C e||species|synonym||d
        f|C f||species|accepted|c|
        g|G||genus|accepted|b|"""))
    for table in (nodes, nodes.unionByName(nodes.filter("taxonID in ('b', 'd', 'g')"))):
        rows = table.collect()
        want = {}
        for r in rows:
            n = want.setdefault(r.nid, [0, 0, 0])
            for a in (x for up in r.path for x in rows if x.nid == up):
                crowd = [max(x.n_children, 1) for x in rows if x.nid == a.sup] or [None]
                for k in crowd:
                    n[0] += a.relation == rcc5.LT
                    n[1] += a.relation == rcc5.LE
                    n[2] += (k or 1).bit_length() - 1
        assert {r.nid: [r.n_lt, r.n_le, r.weight] for r in T.path_sums(table).collect()} == want
    pairs = nodes.select(F.col("nid").alias("x")).join(nodes.select(F.col("nid").alias("y")))
    for compared in (T.compare_in_tree_v8(pairs, nodes), T.lineage_distance(pairs, nodes)):
        compared.explain()
        assert "Generate" not in capsys.readouterr().out
