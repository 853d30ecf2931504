"""Concepts compared across checklists by the exemplars they hold.

A block is the set of exemplars at or below a node.  Only the members of exemplars are
kept; blocks are listed for the nodes that a comparison asks for, and relations come from
counts, so no set is ever gathered into a row and no table of all blocks is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rcc5
from ..functions.ranks import rank_number
from ..staging import stage
from .match import exemplar_epithets
from .numbering import number_within
from .tree import accepted_of, ancestor_closure, common_length, is_prefix, prefixed, within_interval


#: What comparisons, merged trees and reports read of a node; the parts of its name are not carried along.
KEPT = ("nid side taxonID _ord canonicalName scientificName taxonomicStatus accepted rank sup relation path level pre last post "
        "genus_nid family_nid species_nid n_children n_synonyms").split()


@dataclass(frozen=True)
class Theory:
    """Stored tables that the comparisons read."""

    nodes: DataFrame      # columns KEPT of the nodes with block size, uniqueness, cross MRCA, central node
    members: DataFrame    # (exemplar_id, side, nid, pre, path)
    exemplars: DataFrame  # (exemplar_id, side, nid)
    lookup: DataFrame     # (exemplar_id, rep_a, rep_b, epithet)


def members(exemplars: DataFrame, nodes: DataFrame) -> DataFrame:
    """(exemplar_id, side, nid, pre, path): the exemplars' members that are in a tree."""
    places = nodes.filter("path is not null").select("nid", "pre", "path")
    return exemplars.join(places, "nid").select("exemplar_id", "side", "nid", "pre", "path")


def blocks(members_: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(nid, side, exemplar_id): every exemplar of every node, or of the ``wanted`` nodes (nid).

    The wanted among the nodes above are looked up once per path that members have above
    them, not once per member: the nodes near a root would meet all members in one task.
    """
    if wanted is None:
        return members_.select(F.explode("path").alias("nid"), "side", "exemplar_id").distinct()
    wanted = wanted.select("nid").distinct()
    own = members_.select("nid", "side", "exemplar_id").join(wanted, "nid", "left_semi")
    placed = members_.select(*_above(), "side", "exemplar_id")
    over = _paths_above(members_).withColumn("nid", F.explode("_above")).join(wanted, "nid", "left_semi")
    return own.unionByName(placed.join(over.hint("merge"), ["_up", "_above"]).select("nid", "side", "exemplar_id")).distinct()


def _above() -> list[Column]:
    """The superior and the path above a node; the former only makes the latter easy to sort."""
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return [F.try_element_at(above, F.lit(-1)).alias("_up"), above.alias("_above")]


def _paths_above(rows: DataFrame) -> DataFrame:
    """(_up, _above): the different paths above the nodes, of which there are as many as nodes with inferiors."""
    return rows.select(*_above()).filter("_up is not null").distinct()


def _met_again(members_: DataFrame) -> DataFrame:
    """(exemplar_id, side, path): where the members of one exemplar in one tree come together.

    Of members in walk order each meets the one before it at their common ancestor.  Above
    that, an exemplar has been counted once too often for each such meeting.
    """
    several = members_.groupBy("exemplar_id", "side").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    numbered = stage(number_within(members_.join(several, ["exemplar_id", "side"]), ["exemplar_id", "side"], ["pre"], "_n"), "members")
    before = numbered.select("exemplar_id", "side", (F.col("_n") + 1).alias("_n"), F.col("path").alias("_before"))
    met = numbered.join(before, ["exemplar_id", "side", "_n"])
    return met.select("exemplar_id", "side", F.slice("path", F.lit(1), common_length(F.col("path"), F.col("_before"))).alias("path"))


def cross_mrcas(members_: DataFrame, lookup: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nid, block_size, cross_nid, cross_path): block sizes, and the MRCA in the other tree.

    The MRCA of a set is that of its first and last member in walk order.  A block's size is
    its members less the meetings of members of one exemplar, so no distinct is needed: one
    partial aggregate of a sum and two extremes per node.
    """
    pre = nodes.select("nid", "pre")
    ends = (lookup.join(pre.toDF("rep_a", "pre_a"), "rep_a").join(pre.toDF("rep_b", "pre_b"), "rep_b")
            .select("exemplar_id", "pre_a", "pre_b"))
    other = F.when(F.col("side") == "A", F.col("pre_b")).otherwise(F.col("pre_a"))
    counted = members_.select("exemplar_id", "side", "path", F.lit(1).alias("_w")).unionByName(
        _met_again(members_).withColumn("_w", F.lit(-1)))
    span = counted.join(ends, "exemplar_id").select(F.explode("path").alias("nid"), "_w", other.alias("_other")).groupBy("nid").agg(
        F.sum("_w").alias("block_size"), F.min("_other").alias("lo"), F.max("_other").alias("hi"))
    path = nodes.filter("path is not null").select("pre", "path")
    out = span.join(path.toDF("lo", "lo_path"), "lo").join(path.toDF("hi", "hi_path"), "hi")
    cross = F.slice("lo_path", F.lit(1), common_length(F.col("lo_path"), F.col("hi_path")))
    return out.select("nid", "block_size", cross.alias("cross_path")).withColumn(
        "cross_nid", F.element_at("cross_path", -1))


def monotypic(sized: DataFrame) -> DataFrame:
    """(nid): nodes with exactly one inferior that holds an exemplar."""
    return sized.filter("block_size > 0 and sup is not null").groupBy(F.col("sup").alias("nid")).agg(
        F.count("*").alias("_n")).filter("_n = 1").select("nid")


def central(sized: DataFrame) -> DataFrame:
    """(nid, central, central_relation) for nodes whose own block is empty.

    The nearest node above with exemplars is looked up once per path above such nodes.
    """
    empty = sized.filter("block_size = 0")
    full = sized.filter("block_size > 0").select(F.col("nid").alias("ancestor"))
    over = _paths_above(empty).select("_up", "_above", F.posexplode("_above").alias("_pos", "ancestor"))
    first = over.join(full, "ancestor").groupBy("_up", "_above").agg(
        F.max_by("ancestor", "_pos").alias("ancestor"), F.max("_pos").alias("_pos"))
    near = empty.select("nid", *_above()).join(first.hint("merge"), ["_up", "_above"]).groupBy("nid").agg(
        F.min_by("ancestor", F.size("_above") - F.col("_pos")).alias("central"))
    direct = F.col("sup") == F.col("central")
    return empty.join(near, "nid").select(
        "nid", "central", F.when(direct, F.col("relation")).otherwise(rcc5.LT).alias("central_relation"))


def theorize(nodes: DataFrame, exemplars: DataFrame) -> Theory:
    lookup = stage(exemplar_epithets(exemplars, nodes), "lookup")
    within = stage(members(exemplars, nodes), "members")
    sized = nodes.filter("path is not null").select(*KEPT).join(cross_mrcas(within, lookup, nodes), "nid", "left")
    sized = stage(sized.withColumns({
        "block_size": F.coalesce("block_size", F.lit(0)), "rank_no": rank_number("rank")}), "sized")
    sup = sized.select(F.col("nid").alias("sup"), F.col("block_size").alias("sup_block_size"))
    # links meet their superiors alone, so that the whole rows are sorted once, by nid
    above = sized.filter("sup is not null").select("nid", "sup").distinct().join(sup, "sup")
    mono = monotypic(sized).withColumn("mono", F.lit(True))
    out = (sized.join(above.hint("merge"), ["nid", "sup"], "left").join(mono.hint("merge"), "nid", "left")
           .join(central(sized).hint("merge"), "nid", "left"))
    out = out.withColumns({
        "unique": F.coalesce(F.col("sup_block_size") != F.col("block_size"), F.lit(True)) & F.col("mono").isNull(),
        "central": F.when(F.col("block_size") > 0, F.col("nid")).otherwise(F.col("central")),
        "central_relation": F.when(F.col("block_size") > 0, rcc5.EQ).otherwise(F.col("central_relation"))})
    out = out.withColumn("mono", F.coalesce("mono", F.lit(False))).drop("sup_block_size")
    return Theory(stage(out, "theory"), within, exemplars, lookup)


# -- relations ------------------------------------------------------------------------------


def block_relation(n_u: Column, n_v: Column, n_both: Column) -> Column:
    return (F.when((n_both == n_u) & (n_both == n_v), rcc5.COMPARABLE)
            .when(n_both == n_u, rcc5.LT).when(n_both == n_v, rcc5.GT)
            .when(n_both == 0, rcc5.DISJOINT).otherwise(rcc5.OVERLAP)).cast("int")


def relation_within_block(x: str, y: str) -> Column:
    """Relation of two nodes with the same block, from uniqueness, status and rank."""
    a, b = F.col(x + "accepted"), F.col(y + "accepted")
    p, q = F.col(x + "rank_no"), F.col(y + "rank_no")
    return (
        F.when(F.col(x + "unique") & F.col(y + "unique"), rcc5.EQ)
        .when(~a & b, rcc5.LE).when(a & ~b, rcc5.GE)
        .when(p.isNull() | q.isNull(), rcc5.COMPARABLE)
        .when(p < q, rcc5.LT).when(p == q, rcc5.EQ).otherwise(rcc5.GT)).cast("int")


_CENTRAL = ("nid", "block_size", "unique", "accepted", "rank_no", "path", "cross_path")


def intersections(pairs: DataFrame, theory: Theory) -> DataFrame:
    """(u, v, n_both) for distinct pairs of nodes with exemplars.

    When v is at or above the other-side MRCA of u's exemplars, v holds all of them.  Only
    pairs that are nested neither way are counted, from the smaller block's side.
    """
    j = (pairs.select("u", "v").distinct()
         .join(prefixed(theory.nodes, "u_", "nid", "block_size", "path", "cross_path"), F.col("u") == F.col("u_nid"))
         .join(prefixed(theory.nodes, "v_", "nid", "block_size", "path", "cross_path"), F.col("v") == F.col("v_nid")))
    nested = (F.when(is_prefix(F.col("v_path"), F.col("u_cross_path")), F.col("u_block_size"))
              .when(is_prefix(F.col("u_path"), F.col("v_cross_path")), F.col("v_block_size")))
    j = stage(j.select("u", "v", nested.alias("n_both"),
                       (F.col("u_block_size") <= F.col("v_block_size")).alias("u_small")), "pairs")
    small = F.when(F.col("u_small"), F.col("u")).otherwise(F.col("v"))
    big = F.when(F.col("u_small"), F.col("v")).otherwise(F.col("u"))
    rest = stage(j.filter("n_both is null").select("u", "v", small.alias("nid"), big.alias("_big")), "open")
    held = blocks(theory.members, rest).select("nid", "side", "exemplar_id")
    # an exemplar of the smaller block is in the larger one if a member of it stands below
    spans = prefixed(theory.nodes, "b_", "nid", "pre", "last")
    there = theory.members.select(F.when(F.col("side") == "A", "B").otherwise("A").alias("side"), "exemplar_id", F.col("pre").alias("m_pre"))
    common = (rest.join(held, "nid").join(spans, F.col("_big") == F.col("b_nid"))
              .join(there, ["side", "exemplar_id"]).filter(within_interval("m_", "b_"))
              .select("u", "v", "exemplar_id").distinct().groupBy("u", "v").agg(F.count("*").alias("_n")))
    counted = rest.join(common, ["u", "v"], "left").select("u", "v", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_both"))
    return j.filter("n_both is not null").select("u", "v", "n_both").unionByName(counted)


def compare_central(pairs: DataFrame, theory: Theory) -> DataFrame:
    """(u, v, n_u, n_v, n_both, relation) for nodes that hold exemplars."""
    out = (intersections(pairs, theory)
           .join(prefixed(theory.nodes, "u_", *_CENTRAL[:5]), F.col("u") == F.col("u_nid"))
           .join(prefixed(theory.nodes, "v_", *_CENTRAL[:5]), F.col("v") == F.col("v_nid")))
    sets = block_relation(F.col("u_block_size"), F.col("v_block_size"), F.col("n_both"))
    same = sets == rcc5.COMPARABLE
    return out.select("u", "v", F.col("u_block_size").alias("n_u"), F.col("v_block_size").alias("n_v"), "n_both",
                      F.when(same, relation_within_block("u_", "v_")).otherwise(sets).alias("relation"))


def compare(pairs: DataFrame, theory: Theory) -> DataFrame:
    """Add ``relation`` to pairs (u, v) of nodes of opposite checklists."""
    tie = theory.nodes.select("nid", "central", "central_relation")
    j = (pairs.select("u", "v").distinct()
         .join(tie.toDF("u", "cu", "ru"), "u").join(tie.toDF("v", "cv", "rv"), "v"))
    j = stage(j, "compare")
    mid = compare_central(j.select(F.col("cu").alias("u"), F.col("cv").alias("v")), theory).select(
        F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("relation").alias("rm"))
    # an identity leaves the other relation as it is, which composition with = does too
    relation = rcc5.compose(F.col("ru"), rcc5.compose(F.col("rm"), rcc5.reverse(F.col("rv"))))
    done = j.join(mid, ["cu", "cv"]).select("u", "v", relation.alias("relation"))
    return pairs.join(done.hint("merge"), ["u", "v"])


def estimates(theory: Theory) -> DataFrame:
    """(nid, est, relation): the least node of the other checklist that contains each node.

    Going up from the cross MRCA every block contains the node's own, so sizes decide.  The
    first candidate settles nearly all nodes; only the others look at the chain above it.
    """
    nodes = theory.nodes
    mine = prefixed(nodes.filter("block_size > 0"), "u_", *_CENTRAL, "cross_nid")
    sizes = F.when(F.col("v_block_size") > F.col("u_block_size"), rcc5.LT).otherwise(relation_within_block("u_", "v_"))
    target = prefixed(nodes, "v_", "nid", "block_size", "unique", "accepted", "rank_no")
    first = mine.join(target, F.col("u_cross_nid") == F.col("v_nid")).withColumn("rel", sizes)
    first = stage(first.select(*mine.columns, F.col("v_nid").alias("est"), "rel",
                               rcc5.within(F.col("rel"), rcc5.LE).alias("ok")), "estimate")
    chain = first.filter("not ok").select(
        *mine.columns, F.posexplode(F.slice("u_cross_path", F.lit(1), F.size("u_cross_path") - 1)).alias("_pos", "_up"))
    higher = chain.join(target, F.col("_up") == F.col("v_nid")).withColumn("rel", sizes).filter(rcc5.within(F.col("rel"), rcc5.LE))
    best = higher.groupBy("u_nid").agg(F.max_by("_up", "_pos").alias("est"), F.max_by("rel", "_pos").alias("rel"))
    found = first.filter("ok").select("u_nid", "est", "rel").unionByName(best).select(
        F.col("u_nid").alias("central"), "est", F.col("rel").alias("_rel"))
    return nodes.select("nid", "central", "central_relation").join(found, "central").select(
        "nid", "est", rcc5.compose(F.col("central_relation"), F.col("_rel")).alias("relation"))


def equivalents(estimates_: DataFrame, theory: Theory) -> DataFrame:
    """(nid, est) where the estimate is congruent and both or neither are accepted."""
    flag = theory.nodes.select("nid", "accepted")
    return (estimates_.filter(F.col("relation") == rcc5.EQ).join(flag, "nid")
            .join(flag.toDF("est", "_est_accepted"), "est").filter("accepted = _est_accepted").select("nid", "est"))


def _species_lookup(theory: Theory) -> DataFrame:
    """(exemplar_id, species_a, species_b): accepted species of the two representatives."""
    species = theory.nodes.select("nid", "species_nid")
    return (theory.lookup.join(species.toDF("rep_a", "species_a"), "rep_a")
            .join(species.toDF("rep_b", "species_b"), "rep_b").select("exemplar_id", "species_a", "species_b"))


def intersecting_species(theory: Theory) -> DataFrame:
    """(nid, side, partner): accepted species whose concepts share an exemplar with each accepted species."""
    own = theory.nodes.filter("accepted and rank = 'species'").select("nid")
    held = blocks(theory.members, own).join(_species_lookup(theory).hint("merge"), "exemplar_id")
    partner = F.when(F.col("side") == "A", F.col("species_b")).otherwise(F.col("species_a"))
    return held.select("nid", "side", partner.alias("partner")).filter("partner is not null").distinct()


def buddies(theory: Theory) -> DataFrame:
    """(nid, buddy): the accepted record of the other side with the same exemplar."""
    nodes = theory.nodes
    other = theory.exemplars.join(theory.lookup.select("exemplar_id", "rep_a", "rep_b"), "exemplar_id").select(
        "exemplar_id", "nid", F.when(F.col("side") == "A", F.col("rep_b")).otherwise(F.col("rep_a")).alias("rep"))
    lifted = other.join(accepted_of(nodes).toDF("rep", "v"), "rep").join(nodes.select("nid", "rank"), "nid")
    v = nodes.select(F.col("nid").alias("v"), F.col("rank").alias("v_rank"), F.col("sup").alias("v_sup"))
    q = nodes.select(F.col("nid").alias("v_sup"), F.col("rank").alias("q_rank"))
    j = lifted.join(v, "v").join(q, "v_sup", "left")
    up = (F.col("rank") != F.col("v_rank")) & (F.col("rank") == F.col("q_rank"))
    j = j.select("nid", "exemplar_id", F.when(up, F.col("v_sup")).otherwise(F.col("v")).alias("buddy"))
    same = theory.exemplars.select(F.col("nid").alias("buddy"), "exemplar_id")
    return j.join(same, ["buddy", "exemplar_id"], "left_semi").select("nid", "buddy")


def same_protonym(pairs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Add ``same``: whether both nodes are members of one exemplar."""
    e = exemplars.select("nid", "exemplar_id")
    out = pairs.join(e.toDF("u", "_eu"), "u", "left").join(e.toDF("v", "_ev"), "v", "left")
    return out.select(*pairs.columns, F.coalesce(F.col("_eu") == F.col("_ev"), F.lit(False)).alias("same"))


def compare_locally(pairs: DataFrame, specimens: DataFrame) -> DataFrame:
    """Settle `?` of in-tree pairs (x, y, relation) by whether they share a type specimen."""
    s = specimens.select("nid", "spec")
    out = pairs.join(s.toDF("x", "_sx"), "x", "left").join(s.toDF("y", "_sy"), "y", "left")
    same = F.coalesce(F.col("_sx") == F.col("_sy"), F.lit(False))
    settled = F.when(F.col("relation") != rcc5.NOINFO, F.col("relation")).when(same, rcc5.EQ).otherwise(rcc5.NEQ)
    return out.select(*[c for c in pairs.columns if c != "relation"], settled.cast("int").alias("relation"))


def sibling_relations(nodes: DataFrame, specimens: DataFrame) -> DataFrame:
    """(nid, n_siblings, n_same, n_other): per synonym, how many siblings share its specimen, and how many don't.

    ``compare_locally`` finds `=` for the former and `!=` for the latter.  Counted per superior and
    per (superior, specimen); no pair of siblings is listed.
    """
    rows = nodes.filter("level > 1").select("nid", "sup", "accepted").join(specimens.select("nid", "spec"), "nid")
    siblings = rows.groupBy("sup").agg(F.count("*").alias("_all"))
    alike = rows.groupBy("sup", "spec").agg(F.count("*").alias("_same"))
    out = rows.filter("not accepted").join(siblings, "sup").join(alike, ["sup", "spec"])
    return out.select("nid", (F.col("_all") - 1).alias("n_siblings"), (F.col("_same") - 1).alias("n_same"), (F.col("_all") - F.col("_same")).alias("n_other"))


def siblings_that_meet(nodes: DataFrame, specimens: DataFrame) -> DataFrame:
    """(x, y): each synonym with the first sibling of its specimen, its superior, and the sibling before it in a walk.

    Rows grow with the records, whatever the number of siblings.
    """
    rows = nodes.filter("level > 1 and sup is not null").select("nid", "sup", "accepted").join(specimens.select("nid", "spec"), "nid")
    rows = stage(number_within(rows, ["sup"], ["nid"], "_n"), "siblings")
    first = rows.groupBy("sup", "spec").agg(F.min("nid").alias("y"))
    mine = rows.filter("not accepted")
    before = rows.select("sup", (F.col("_n") + 1).alias("_n"), F.col("nid").alias("y"))
    x = F.col("nid").alias("x")
    return (mine.join(first, ["sup", "spec"]).filter("nid <> y").select(x, "y")
            .unionByName(mine.join(before, ["sup", "_n"]).select(x, "y"))
            .unionByName(mine.filter("sup > 0").select(x, F.col("sup").alias("y")))).distinct()


def cross_tests(compared: DataFrame) -> DataFrame:
    """Add cross_lt and cross_le to compared pairs."""
    lt = F.col("relation").isin(rcc5.LT, rcc5.LE, rcc5.LT | rcc5.DISJOINT)
    return compared.withColumns({"cross_lt": lt, "cross_le": lt | (F.col("relation") == rcc5.EQ)})
