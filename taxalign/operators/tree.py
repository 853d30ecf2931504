"""Hierarchies: links, levels, root paths, common ancestors, in-tree relations.

A checklist becomes a node table.  ``nid`` is a bigint that identifies a row and
orders siblings as they are walked (accepted rows before synonyms, then row order);
``path`` lists the nids from the root down to the row itself.  A path answers level,
descent, common-ancestor and in-tree questions without further joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rcc5
from ..functions.ranks import rank_number
from ..staging import stage
from .numbering import positions

TOP = "⊤"
_SYNONYM_BIT = 1 << 62
# Beginnings of a taxonomicStatus that make a row accepted.
ACCEPTED_PREFIXES = ("accepted", "provisionally accepted", "valid", "doubtful")
OPTIONAL = (
    "acceptedNameUsageID parentNameUsageID taxonomicStatus taxonRank canonicalName "
    "scientificName scientificNameAuthorship namePublishedInYear managed_id "
    "gn_canonical_full gn_canonical_stem gn_authorship"
).split()


def top_nid(side: str) -> int:
    return -2 if side == "A" else -1


def is_accepted(status: Column) -> Column:
    """Missing counts as accepted; case matters."""
    hit = status == ""
    for prefix in ACCEPTED_PREFIXES:
        hit = hit | status.startswith(prefix)
    return hit


def with_columns_present(df: DataFrame, names=OPTIONAL) -> DataFrame:
    """Absent columns and NULLs become ''."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("") for n in names})


def identify(df: DataFrame, side: str = "A") -> DataFrame:
    """Add ``side``, ``accepted`` and ``nid`` to checklist rows."""
    df = with_columns_present(df)
    accepted = is_accepted(F.col("taxonomicStatus"))
    bit = 0 if side == "A" else 1
    nid = F.shiftleft(F.col("_ord"), 1) + bit + F.when(accepted, F.lit(0)).otherwise(F.lit(_SYNONYM_BIT))
    return df.withColumns({"side": F.lit(side), "accepted": accepted, "nid": nid})


# -- links --------------------------------------------------------------------------------


def resolve_superiors(rows: DataFrame) -> DataFrame:
    """The superior of each row: relation, sup (nid), span, note.

    One self join serves both links, because a row with an accepted id never uses its
    parent.  Rows without a link keep a key of their own, so they do not meet in one task.
    Of rows that share an id the first one is meant; ``validate`` reports them.
    """
    link = F.when(F.col("acceptedNameUsageID") != "", F.col("acceptedNameUsageID")).otherwise(F.col("parentNameUsageID"))
    synonym = F.col("acceptedNameUsageID") != ""
    key = F.when(link == "", F.concat(F.lit("\u0001"), "taxonID")).otherwise(link)
    first = F.min_by(F.struct("nid", "accepted", "taxonRank"), "_ord").alias("_first")
    targets = rows.groupBy("side", F.col("taxonID").alias("_key")).agg(first).select(
        "side", "_key", F.col("_first.nid").alias("_target"),
        F.col("_first.accepted").alias("sup_accepted"), F.col("_first.taxonRank").alias("sup_rank"))
    found = F.col("_target").isNotNull()
    top = F.when(F.col("side") == "A", F.lit(-2)).otherwise(F.lit(-1)).cast("bigint")
    same = F.col("taxonomicStatus") == "equivalent"
    out = rows.withColumn("_key", key).join(targets, ["side", "_key"], "left")
    edge = F.when(
        synonym & found,
        F.struct(F.when(same, rcc5.EQ).otherwise(rcc5.LE).alias("relation"), F.col("_target").alias("sup"),
                 F.when(same, 0).otherwise(1).alias("span"),
                 F.when(same, "input").otherwise("checklist (synonym)").alias("note")),
    ).when(
        ~synonym,
        F.struct(F.lit(rcc5.LT).alias("relation"), F.coalesce("_target", top).alias("sup"), F.lit(2).alias("span"),
                 F.when(found, "checklist (child)").otherwise("inferior of top").alias("note")),
    )
    out = out.withColumn("_e", edge)
    return out.select(
        *rows.columns, "_e.relation", "_e.sup", "_e.span", "_e.note",
        F.when(found, F.col("sup_accepted")).otherwise(True).alias("sup_accepted"),
        F.when(found, F.col("sup_rank")).otherwise("top").alias("sup_rank"))


_EDGE = ["relation", "sup", "span", "note", "sup_accepted", "sup_rank"]


def skip_synonym_superiors(nodes: DataFrame) -> DataFrame:
    """Lift links that end at a synonym to the first accepted row above it.

    ``nodes`` must be a stored table.  Only rows below a synonym take part; the chains
    above them are shortened by pointer doubling.
    """
    pending = (~F.col("sup_accepted")) & (F.col("relation") != rcc5.EQ)
    if nodes.filter(pending).isEmpty():
        return nodes
    links = nodes.filter(~F.col("accepted")).select("nid", *_EDGE)
    links = stage(links.withColumn("open", (~F.col("sup_accepted")) & F.col("sup").isNotNull()), "climb")
    left = links.filter("open").count()
    while left:
        above = links.select(F.col("nid").alias("sup"), *[F.col(c).alias("_" + c) for c in _EDGE],
                             F.col("open").alias("_open"))
        step = links.filter("open").join(above, "sup", "left")
        dead = F.col("_sup").isNull()
        lifted = step.select(
            "nid",
            *[F.when(dead, F.col(c)).otherwise(F.col("_" + c)).alias(c) for c in _EDGE],
            (~dead & F.col("_open")).alias("open"))
        links = stage(links.filter("not open").unionByName(lifted), "climb")
        now = links.filter("open").count()
        if now == left:
            break  # what remains is a ring of synonyms; it stays off the tree
        left = now
    over = links.select(F.col("nid").alias("_via"), *[F.col(c).alias("_" + c) for c in _EDGE])
    moved = nodes.filter(pending).join(over, F.col("sup") == F.col("_via"), "left")
    lift = F.col("_sup").isNotNull()
    moved = moved.select(
        *[c for c in nodes.columns if c not in _EDGE],
        *[F.when(lift, F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in _EDGE])
    return nodes.filter(~F.coalesce(pending, F.lit(False))).unionByName(moved).hint("merge")


def check_ranks(nodes: DataFrame) -> DataFrame:
    """Blank the rank of an accepted row that is not below its superior's rank."""
    own, above = rank_number("taxonRank"), rank_number("sup_rank")
    bad = F.coalesce(F.col("accepted") & (own >= above), F.lit(False))
    return nodes.withColumns({"rank_problem": bad, "rank": F.when(~bad, F.col("taxonRank")).otherwise("")})


# -- paths --------------------------------------------------------------------------------


def root_paths(nodes: DataFrame) -> DataFrame:
    """(nid, side, path, level, …): root paths and the nearest ranked ancestors, roots included.

    Needs nid, side, sup, rank and accepted of linked nodes.  Only rows that have inferiors take part in the doubling: each round joins every
    unfinished segment with the segment above it, so depth d needs log2(d) rounds.  Rows
    that never reach the root (rings, orphans) get a NULL path.
    """
    inner = nodes.select("sup").distinct().withColumnRenamed("sup", "nid")
    genus = F.when(F.col("rank") == "genus", F.col("nid"))
    family = F.when(F.col("rank") == "family", F.col("nid"))
    species = F.when((F.col("rank") == "species") & F.col("accepted"), F.col("nid"))
    tops = nodes.select("side").distinct().select(
        F.when(F.col("side") == "A", -2).otherwise(-1).cast("bigint").alias("nid"), "side")
    none = F.lit(None).cast("bigint")
    segments = (
        nodes.join(inner, "nid", "left_semi")
        .select("nid", F.col("sup").alias("ptr"), F.array("nid").alias("path"),
                genus.alias("genus_nid"), family.alias("family_nid"), species.alias("species_nid"))
        .unionByName(tops.select("nid", none.alias("ptr"), F.array("nid").alias("path"),
                                 none.alias("genus_nid"), none.alias("family_nid"), none.alias("species_nid"))))
    segments = stage(segments, "segments")
    left = segments.filter("ptr is not null").count()
    near = ["genus_nid", "family_nid", "species_nid"]
    while left:
        upper = segments.select(F.col("nid").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("path").alias("_path"),
                                *[F.col(c).alias("_" + c) for c in near])
        joined = segments.filter("ptr is not null").join(upper, "ptr", "left").select(
            "nid", F.col("_ptr").alias("ptr"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"),
            *[F.coalesce(c, "_" + c).alias(c) for c in near])
        segments = stage(segments.filter("ptr is null").unionByName(joined), "segments")
        now = segments.filter("ptr is not null").count()
        if now == left:
            break  # nobody reached the root: the rest are rings
        left = now
    rooted = segments.filter(F.col("ptr").isNull() & (F.col("path")[0] < 0))
    above = rooted.select(F.col("nid").alias("sup"), F.col("path").alias("sup_path"),
                          F.col("genus_nid").alias("genus_above"),
                          *[F.col(c).alias("_" + c) for c in near])
    out = nodes.join(above, "sup", "left")
    below = out.select(
        "nid", "side", F.concat("sup_path", F.array("nid")).alias("path"),
        F.coalesce(F.size("sup_path") + 1, F.lit(None)).alias("level"),
        "genus_above",
        F.coalesce(genus, "_genus_nid").alias("genus_nid"),
        F.coalesce(family, "_family_nid").alias("family_nid"),
        F.coalesce(species, "_species_nid").alias("species_nid"))
    return below.unionByName(tops.select("nid", "side", F.array("nid").alias("path"), F.lit(1).alias("level")), allowMissingColumns=True)


def top_rows(nodes: DataFrame) -> DataFrame:
    """One root row per side, with the columns of ``nodes``."""
    special = {
        "taxonID": F.lit(TOP), "canonicalName": F.lit(TOP), "taxonRank": F.lit("top"), "rank": F.lit("top"),
        "taxonomicStatus": F.lit("accepted"), "accepted": F.lit(True), "sup_accepted": F.lit(True),
        "rank_problem": F.lit(False), "sup_rank": F.lit(""), "note": F.lit(""),
        "_ord": F.lit(-1).cast("bigint"),
    }
    special["nid"], special["side"] = F.when(F.col("side") == "A", -2).otherwise(-1).cast("bigint"), F.col("side")
    return nodes.select("side").distinct().select(*[
        special.get(f.name, F.lit("" if f.dataType.simpleString() == "string" else None)).cast(f.dataType).alias(f.name)
        for f in nodes.schema.fields])


def inferior_counts(nodes: DataFrame) -> DataFrame:
    """Numbers of children and synonyms of each node that has any."""
    return nodes.groupBy(F.col("sup").alias("nid")).agg(
        F.count_if(F.col("accepted")).alias("n_children"),
        F.count_if(~F.col("accepted")).alias("n_synonyms"))


def link_nodes(rows: DataFrame) -> DataFrame:
    """Identified rows -> nodes with final links and checked ranks, over one stored table."""
    return check_ranks(skip_synonym_superiors(stage(resolve_superiors(rows), "links")))


def build_tree(df: DataFrame, side: str = "A") -> DataFrame:
    """Checklist rows -> stored node table, root row included."""
    return build_forest(identify(df, side))


def build_forest(rows: DataFrame) -> DataFrame:
    """Identified rows -> node table.

    What follows from the links is computed over a few narrow columns; names and the like
    are shuffled once, when the two meet.
    """
    nodes = link_nodes(rows)
    placed = stage(root_paths(nodes.select("nid", "side", "sup", "rank", "accepted")), "paths")
    info = placed.drop("side").join(walk_numbers(placed), "nid", "left").join(
        inferior_counts(nodes.filter("sup is not null")), "nid", "left")
    info = info.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_synonyms": F.coalesce("n_synonyms", F.lit(0))})
    # the hint of a stored table does not reach past a union
    return stage(nodes.unionByName(top_rows(nodes)).hint("merge").join(info, "nid"), "tree")


def workspace_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tagged union of two checklists."""
    return identify(a, "A").unionByName(identify(b, "B"), allowMissingColumns=True)


def swap(workspace: DataFrame) -> DataFrame:
    """Exchange the roles of the two checklists."""
    return workspace.withColumn("side", F.when(F.col("side") == "A", "B").otherwise("A"))


def workspace_key(workspace: DataFrame) -> DataFrame:
    return workspace.withColumn("key", F.concat_ws("!", "side", "taxonID"))


# -- questions a path answers ----------------------------------------------------------------


def is_prefix(p: Column, q: Column) -> Column:
    """p is the path of q itself or of an ancestor."""
    return (F.size(p) <= F.size(q)) & (F.try_element_at(q, F.size(p)) == F.element_at(p, -1))


def common_length(p: Column, q: Column) -> Column:
    """Length of the common prefix of two paths of one tree.

    A node stands at one depth only, so two paths agree exactly on the nodes they share.
    """
    return F.size(F.array_intersect(p, q))


def mrca(p: Column, q: Column) -> Column:
    """nid of the most recent common ancestor."""
    return F.try_element_at(p, common_length(p, q))


def relation_in_tree(x: str, y: str) -> Column:
    """Relation of two nodes of one tree, from columns with the prefixes ``x`` and ``y``.

    Each prefix needs nid, sup, relation, accepted and path.
    """
    c = lambda side, name: F.col(side + name)
    xs, ys = c(x, "sup"), c(y, "sup")
    siblings = F.coalesce(xs == ys, F.lit(False)) & (~c(x, "accepted") | ~c(y, "accepted"))
    return (
        F.when(c(x, "nid") == c(y, "nid"), rcc5.EQ)
        .when(F.coalesce(xs == c(y, "nid"), F.lit(False)), c(x, "relation"))
        .when(F.coalesce(ys == c(x, "nid"), F.lit(False)), rcc5.reverse(c(y, "relation")))
        .when(is_prefix(c(y, "path"), c(x, "path")), rcc5.LT)
        .when(is_prefix(c(x, "path"), c(y, "path")), rcc5.GT)
        .when(siblings, rcc5.NOINFO)
        .otherwise(rcc5.DISJOINT)).cast("int")


def prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in (columns or df.columns)])


_IN_TREE = ("nid", "sup", "relation", "accepted", "path")


def compare_in_tree(pairs: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``relation`` and ``mrca`` to pairs of nids of one tree."""
    out = pairs.join(prefixed(nodes, "_x_", *_IN_TREE), F.col(x) == F.col("_x_nid"))
    out = out.join(prefixed(nodes, "_y_", *_IN_TREE), F.col(y) == F.col("_y_nid"))
    return out.select(*pairs.columns, relation_in_tree("_x_", "_y_").alias("relation"),
                      mrca(F.col("_x_path"), F.col("_y_path")).alias("mrca"))


def tree_predicates(pairs: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add the tests le, lt, ge, gt, descends and intersects; no path is needed.

    A node stands below another if its place in a walk is within the other's interval.
    """
    have = ("nid", "sup", "accepted", "level", "pre", "last")
    out = pairs.join(prefixed(nodes, "_x_", *have), F.col(x) == F.col("_x_nid"))
    out = out.join(prefixed(nodes, "_y_", *have), F.col(y) == F.col("_y_nid"))
    same = F.col(x) == F.col(y)
    le, ge = within_interval("_x_", "_y_"), within_interval("_y_", "_x_")
    return out.select(
        *pairs.columns, le.alias("le"), (le & ~same).alias("lt"), ge.alias("ge"), (ge & ~same).alias("gt"),
        (F.col("_y_level") < F.col("_x_level")).alias("descends"), (le | ge).alias("intersects"))


def within_interval(x: str, y: str) -> Column:
    """The node with the columns of prefix ``x`` is that of ``y`` or stands below it."""
    return F.col(x + "pre").between(F.col(y + "pre"), F.col(y + "last"))


def below(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes at and below the node with the id ``root`` (of either side), by one range condition."""
    spans = nodes.filter((F.col("taxonID") == root) & F.col("pre").isNotNull()).select("side", F.col("pre").alias("_pre"), F.col("last").alias("_last"))
    # one row for each side at most, first of those that share the id
    spans = spans.groupBy("side").agg(F.min_by(F.struct("_pre", "_last"), "_pre").alias("_s")).select("side", "_s.*")
    return nodes.join(F.broadcast(spans), "side").filter(F.col("pre").between(F.col("_pre"), F.col("_last"))).select(*nodes.columns)


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """All (nid, ancestor, distance) rows, the node itself at distance 0."""
    return nodes.filter("path is not null").select(
        "nid", (F.size("path") - 1).alias("_n"), F.posexplode("path").alias("_pos", "ancestor")
    ).select("nid", "ancestor", (F.col("_n") - F.col("_pos")).alias("distance"))


def nearest_ranked(nodes: DataFrame, rank: str, accepted_only: bool = False) -> DataFrame:
    """(nid, ancestor): the nearest ancestor-or-self of the given rank."""
    wanted = F.col("rank") == rank
    if accepted_only:
        wanted = wanted & F.col("accepted")
    hits = nodes.filter(wanted).select(F.col("nid").alias("ancestor"))
    return ancestor_closure(nodes).join(hits, "ancestor").groupBy("nid").agg(
        F.min_by("ancestor", "distance").alias("ancestor"))


def accepted_of(nodes: DataFrame) -> DataFrame:
    """(nid, accepted_nid): the row itself when accepted, else the first accepted row above."""
    above = ancestor_closure(nodes.filter(~F.col("accepted")))
    good = nodes.filter("accepted").select(F.col("nid").alias("ancestor"))
    lifted = above.join(good, "ancestor").groupBy("nid").agg(F.min_by("ancestor", "distance").alias("accepted_nid"))
    own = nodes.filter("accepted").select("nid", F.col("nid").alias("accepted_nid"))
    return own.unionByName(lifted)


def group_mrca(groups: DataFrame, nodes: DataFrame, key: str, member: str = "nid") -> DataFrame:
    """Most recent common ancestor of each group: common prefix of its first and last path."""
    paths = groups.join(nodes.select(F.col("nid").alias(member), "path"), member)
    ends = paths.groupBy(key).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    return ends.select(key, mrca(F.col("lo"), F.col("hi")).alias("mrca"))


def walk_numbers(placed: DataFrame) -> DataFrame:
    """(nid, pre, last, post) of the nodes that have a path.

    ``pre`` is the place in a walk that meets parents first, over all trees of the table,
    ``last`` the greatest among the node and those below, so a subtree is an interval, and
    ``post`` the place in a walk that meets parents last.  A range-partitioned sort by path
    gives the first; sizes of subtrees, counted once over all paths, give the others.
    """
    rooted = placed.filter("path is not null").select("nid", "path", "level")
    sizes = rooted.select(F.explode("path").alias("nid")).groupBy("nid").agg(F.count("*").alias("_size"))
    return positions(rooted, ["path"], "pre").join(sizes, "nid").select(
        "nid", "pre", (F.col("pre") + F.col("_size") - 1).alias("last"), (F.col("pre") + F.col("_size") - F.col("level")).alias("post"))


def _digest(column: str) -> Column:
    """A digest of a column's values as a multiset."""
    return F.sum(F.xxhash64(column).cast("decimal(20,0)")).cast("string")


def reconcile(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per side: rows read, records with a link, records below the root, and whether all three are the same records.

    Sums of hashes are compared, so nothing is sorted or joined but one row per side.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("side").agg(F.count("*").alias(name), _digest("nid").alias("_" + name))

    real = nodes.filter("nid >= 0")
    out = counted(rows, "read").join(counted(real.filter("sup is not null"), "linked"), "side", "left").join(
        counted(real.filter("path is not null"), "reachable"), "side", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("linked", "reachable")]
    same = F.col("_read").eqNullSafe(F.col("_reachable")) & F.col("_read").eqNullSafe(F.col("_linked"))
    return out.select("side", "read", *zero, same.alias("same"))


def validate(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings, one row each: (problem, taxonID).

    ``rows`` are the identified rows that the nodes were made of; links are judged as read,
    before those that end at a synonym were lifted.
    """
    real = nodes.filter("nid >= 0")
    flags = rows.groupBy("side", F.col("taxonID").alias("_key")).agg(F.min_by("accepted", "_ord").alias("_sup_accepted"), F.count("*").alias("_n"))
    link = F.when(F.col("acceptedNameUsageID") != "", F.col("acceptedNameUsageID")).otherwise(F.col("parentNameUsageID"))
    above = rows.withColumn("_key", link).filter("_key <> ''").join(flags, ["side", "_key"]).filter("not _sup_accepted")

    def found(df, problem, column="taxonID"):
        return df.select(F.lit(problem).alias("problem"), F.col(column).alias("taxonID"))

    return (
        found(real.filter("path is null"), "unreachable")
        .unionByName(found(real.filter("sup is null"), "unresolved accepted id"))
        .unionByName(found(real.filter("not accepted and acceptedNameUsageID = ''"), "synonym without accepted id"))
        .unionByName(found(real.filter("rank_problem"), "rank out of order"))
        .unionByName(found(real.filter("note = 'inferior of top' and parentNameUsageID <> ''"), "unknown parent"))
        .unionByName(found(above.filter("accepted").select("_key").distinct(), "synonym with child", "_key"))
        .unionByName(found(above.filter("not accepted").select("_key").distinct(), "synonym with synonym", "_key"))
        .unionByName(found(flags.filter("_n > 1"), "repeated key", "_key"))
        .unionByName(found(real.filter("sup < 0"), "root"))
        .unionByName(found(reconcile(rows, nodes).filter("not same"), "row count", "side")))


# -- parts of trees -----------------------------------------------------------------------


def _ends(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, end): where the chain of links of each id with one link ends, by pointer doubling.

    ``edges`` has (id, above), one row an id; chains end at ids without a link and at
    ``stops``.  Rings have no end and are left out.
    """
    chain = edges.join(stops, "id", "left_anti")
    inner = chain.select(F.col("id").alias("above"), F.lit(True).alias("open"))
    state = stage(chain.join(inner, "above", "left").select("id", F.col("above").alias("end"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
    left = state.filter("open").count()
    while left:
        ahead = state.select(F.col("id").alias("end"), F.col("end").alias("_end"), F.col("open").alias("_open"))
        moved = state.filter("open").drop("open").join(ahead, "end").select("id", F.col("_end").alias("end"), F.col("_open").alias("open"))
        state = stage(state.filter("not open").unionByName(moved), "chains")
        now = state.filter("open").count()
        if now == left:
            break  # only rings are left
        left = now
    return state.filter("not open").select("id", "end")


def reachable_ids(links: DataFrame, root: str) -> DataFrame:
    """(id): ``root`` and all ids from which links (id, above) lead to it, by one way or another.

    Ids with one link form chains whose ends pointer doubling finds in log2(depth) rounds;
    ids with several are stops, and only these are gone through from the root downwards.
    """
    counted = stage(links.distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("above").alias("above")), "links")
    top = links.sparkSession.range(1).select(F.lit(root).alias("id"))
    forks = counted.filter("n > 1").select("id")
    ends = stage(_ends(counted.filter("n = 1").select("id", "above"), top), "ends")
    inside = top
    if not forks.isEmpty():
        # the links of a fork, each taken to the end of its chain
        several = links.distinct().join(forks, "id", "left_semi")
        onward = ends.select(F.col("id").alias("above"), "end")
        several = stage(several.join(onward, "above", "left").select("id", F.coalesce("end", "above").alias("above")).distinct(), "forks")
        new = inside
        while True:
            met = several.join(new.select(F.col("id").alias("above")), "above", "left_semi").select("id").distinct()
            new = stage(met.join(inside, "id", "left_anti"), "reached")
            if new.isEmpty():
                break
            inside = stage(inside.unionByName(new), "reached")
    below_them = ends.join(inside.select(F.col("id").alias("end")), "end", "left_semi").select("id")
    return stage(inside.unionByName(below_them).distinct(), "inside")


def subset(df: DataFrame, root: str) -> DataFrame:
    """Rows at and below ``root`` (an id or a name), through children and synonyms.

    Links that leave the set are blanked.
    """
    rows = with_columns_present(df)
    named = rows.filter((F.col("taxonID") == root) | (F.col("canonicalName") == root) | (F.col("scientificName") == root))
    start = named.agg(F.max_by("taxonID", "_ord")).first()[0]
    links = (
        rows.filter("acceptedNameUsageID <> ''").select(F.col("taxonID").alias("id"), F.col("acceptedNameUsageID").alias("above"))
        .unionByName(rows.filter("parentNameUsageID <> '' and parentNameUsageID <> taxonID")
                     .select(F.col("taxonID").alias("id"), F.col("parentNameUsageID").alias("above"))))
    if not rows.filter("acceptedNameUsageID = taxonID and taxonID <> ''").isEmpty():
        raise ValueError("a row names itself as accepted; clean the checklist first")
    if start is None:
        raise ValueError(f"no taxon with id or name {root!r}")
    links = stage(links, "links")
    if links.filter(F.col("above") == start).isEmpty():
        raise ValueError(f"taxon {root!r} has no inferiors")
    inside = reachable_ids(links, start)

    out = df.join(inside.select(F.col("id").alias("taxonID")), "taxonID", "left_semi")
    for column in ("acceptedNameUsageID", "parentNameUsageID"):
        # a blank link keeps a key of its own instead of meeting the others in one task
        key = F.when(F.col(column) == "", F.concat(F.lit("\u0001"), "taxonID")).otherwise(F.col(column))
        kept = inside.select(F.col("id").alias("_key"), F.lit(True).alias("_in"))
        out = out.withColumn("_key", key).join(kept, "_key", "left")
        keep = F.col("_in").isNotNull() & ((F.col(column) != F.col("taxonID")) if column.startswith("acc") else F.lit(True))
        out = out.withColumn(column, F.when(keep, F.col(column)).otherwise("")).drop("_key", "_in")
    return out.select(*df.columns)


def export_checklist(nodes: DataFrame) -> DataFrame:
    """Node table -> checklist rows with ids and statuses rewritten from the links."""
    real = nodes.filter("level > 1")
    ids = nodes.select(F.col("nid").alias("sup"), F.col("taxonID").alias("_sup_id"))
    lifted = accepted_of(nodes).filter("nid <> accepted_nid").select("nid", "accepted_nid")
    names = nodes.select(F.col("nid").alias("accepted_nid"), F.col("taxonID").alias("_acc_id"))
    out = real.join(ids, "sup", "left").join(lifted.join(names, "accepted_nid").select("nid", "_acc_id"), "nid", "left")
    status = F.when(F.col("taxonomicStatus") == "", "?").otherwise(F.col("taxonomicStatus"))
    plain = status.startswith("accepted")
    return out.select(
        "taxonID", "canonicalName", "scientificName", F.col("gn_canonical_stem").alias("canonicalStem"), "managed_id", F.col("rank").alias("taxonRank"),
        F.when(F.col("accepted"), F.col("_sup_id")).otherwise("").alias("parentNameUsageID"),
        F.when(~F.col("accepted"), F.coalesce("_acc_id", F.lit(""))).otherwise("").alias("acceptedNameUsageID"),
        F.when(F.col("accepted") & ~plain, F.concat(F.lit("accepted "), status))
        .when(~F.col("accepted") & plain, F.concat(F.lit("*"), status))
        .otherwise(status).alias("taxonomicStatus"))


# -- sums along paths ---------------------------------------------------------------------


def path_sums(nodes: DataFrame) -> DataFrame:
    """(nid, n_lt, n_le, weight): edge labels and edge weights summed from the root down.

    The weight of an edge is the whole part of log2 of the number of children above it.  Only
    the paths of nodes that have inferiors are gone along; any node adds its own edge to the
    sums of its superior.
    """
    names = {"lt": "n_lt", "le": "n_le", "w": "weight"}
    crowd = nodes.select(F.col("nid").alias("sup"), F.greatest("n_children", F.lit(1)).alias("_n"))
    own = {"lt": (F.col("relation") == rcc5.LT).cast("int"), "le": (F.col("relation") == rcc5.LE).cast("int"),
           "w": F.length(F.bin("_n")) - 1}
    edges = nodes.select("nid", "sup", "relation").join(crowd, "sup", "left").groupBy("nid").agg(
        *[F.coalesce(F.sum(e), F.lit(0)).alias(c) for c, e in own.items()])
    edges = stage(edges, "edges")
    rooted = nodes.filter("path is not null")
    inner = rooted.select("nid", "path").join(nodes.select(F.col("sup").alias("nid")).distinct(), "nid", "left_semi").distinct()
    above = inner.select(F.col("nid").alias("sup"), F.explode("path").alias("nid")).join(edges, "nid").groupBy("sup").agg(
        *[F.sum(c).alias("_" + c) for c in names])
    rows = rooted.groupBy("nid").agg(F.min("sup").alias("sup"), F.count("*").alias("_rows"))
    return rows.join(edges, "nid").join(above.hint("merge"), "sup", "left").select(
        "nid", *[(F.col("_rows") * (F.col(c) + F.coalesce("_" + c, F.lit(0)))).alias(n) for c, n in names.items()])


def compare_in_tree_v8(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``relation`` to pairs (x, y): both climb to equal level and the edge labels compose.

    Along a chain of < and <= edges one < makes the whole chain <.
    """
    info = stage(nodes.join(path_sums(nodes), "nid").select("nid", "path", "n_lt", "n_le"), "sums")
    out = pairs.join(prefixed(info, "x_"), F.col("x") == F.col("x_nid")).join(prefixed(info, "y_"), F.col("y") == F.col("y_nid"))
    level = F.least(F.size("x_path"), F.size("y_path"))
    out = out.withColumns({"x3": F.element_at("x_path", level), "y3": F.element_at("y_path", level)})
    sums = info.select("nid", "n_lt", "n_le")
    out = out.join(sums.toDF("x3", "x3_lt", "x3_le"), "x3").join(sums.toDF("y3", "y3_lt", "y3_le"), "y3")

    def climb(p: str) -> Column:
        return (F.when(F.col(p + "_n_lt") > F.col(p + "3_lt"), rcc5.LT)
                .when(F.col(p + "_n_le") > F.col(p + "3_le"), rcc5.LE).otherwise(rcc5.EQ))

    out = out.withColumns({"_rx": climb("x"), "_ry": climb("y")})
    bridge = (F.when(F.col("x3") == F.col("y3"), rcc5.EQ)
              .when((F.col("_rx") != rcc5.LE) & (F.col("_ry") != rcc5.LE), rcc5.DISJOINT).otherwise(rcc5.NOINFO))
    relation = rcc5.compose(rcc5.compose(F.col("_rx"), bridge), rcc5.reverse(F.col("_ry")))
    return out.select(*pairs.columns, relation.alias("relation"))


def lineage_distance(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``distance``: edge weights from x and y up to their MRCA, less 1 on each side that climbs."""
    sums = stage(path_sums(nodes).select("nid", "weight"), "sums")
    met = compare_in_tree(pairs, nodes).select(*pairs.columns, "mrca")
    out = (met.join(sums.toDF("x", "_wx"), "x").join(sums.toDF("y", "_wy"), "y").join(sums.toDF("mrca", "_wm"), "mrca"))
    side = lambda node, w: F.when(F.col(node) == F.col("mrca"), 0).otherwise(F.col(w) - F.col("_wm") - 1)
    return out.select(*pairs.columns, "mrca", (side("x", "_wx") + side("y", "_wy")).alias("distance"))


# -- repeated and senior names ------------------------------------------------------------


def duplicate_records(nodes: DataFrame) -> DataFrame:
    """(side, taxonID, best, n_children): records that repeat another's name, family and rank.

    The best of a group is accepted, has more children, and a name closer to its parent's.
    """
    family = nodes.filter("rank = 'family'").select(F.col("nid").alias("_fam"), F.col("canonicalName").alias("family"))
    parent = nodes.select(F.col("nid").alias("sup"), F.col("canonicalName").alias("_parent"))
    rows = (nodes.filter("level > 1").withColumn("_fam", F.coalesce("family_nid", "nid"))
            .join(family, "_fam", "left").join(parent, "sup", "left"))
    name = [F.coalesce(F.col("parts." + f), F.lit("?")).alias(f) for f in ("genus", "epithet", "middle", "token", "year")]
    order = F.struct((~F.col("accepted")).cast("int"), -F.col("n_children"),
                     F.levenshtein("canonicalName", F.coalesce("_parent", F.lit(""))), F.col("taxonID"))
    keys = ["side", "family", "genus", "epithet", "middle", "token", "year", "rank"]
    rows = rows.select("side", F.coalesce("family", F.lit("")).alias("family"), *name, "rank", "taxonID", "n_children", order.alias("_o"))
    groups = rows.groupBy(*keys).agg(F.min_by("taxonID", "_o").alias("best"), F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(groups, keys).filter("taxonID <> best").select("side", "taxonID", "best", "n_children")


def senior_synonyms(nodes: DataFrame) -> DataFrame:
    """(side, taxonID, accepted_id): synonyms published no later than their accepted name."""
    target = nodes.select(F.col("nid").alias("sup"), F.col("taxonID").alias("accepted_id"), F.col("namePublishedInYear").alias("_year"))
    rows = nodes.filter("not accepted and namePublishedInYear <> ''").join(target, "sup")
    return rows.filter("_year <> '' and namePublishedInYear <= _year").select("side", "taxonID", "accepted_id")
