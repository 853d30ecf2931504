"""Records of two checklists that share a type specimen.

No step lists the pairs of a block.  The class of a pair depends on equality of a few
parts, so candidates are summarised once per combination of equal parts and looked up
by it: work grows with the records, also when one epithet holds a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import homotypy as H, rcc5
from ..functions.ranks import rank_number
from ..staging import stage
from .numbering import positions
from .tree import compare_in_tree_v8, prefixed, relation_in_tree

_IN_TREE = ("nid", "sup", "relation", "accepted", "path")


def match_records(nodes: DataFrame) -> DataFrame:
    """One row per tree record with the fields that matching compares."""
    p = F.col("parts")
    families = nodes.filter("rank = 'family'").select(F.col("nid").alias("_fam"), F.col("canonicalName").alias("family"))
    rows = nodes.filter("level > 1").withColumn("_fam", F.coalesce("family_nid", "nid")).join(families, "_fam", "left")
    return rows.select(
        "side", "nid", "taxonID", "_ord", "sup", "relation", "accepted", "path", "genus_above", "canonicalName", "parts",
        "family", H.block_key(p, F.col("taxonID")).alias("key"), H.matched_epithet(p).alias("epithet"),
        p["genus"].alias("genus"), p["token"].alias("token"), p["year"].alias("year"),
        H.importance(F.col("accepted"), p, F.col("n_children"), F.col("n_synonyms"),
                     F.col("scientificName"), F.col("taxonID")).alias("importance"))


def subproblems(records: DataFrame) -> DataFrame:
    """Keys present on both sides with the number of records on each."""
    counts = records.groupBy("key").agg(
        F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"))
    return counts.filter("n_a > 0 and n_b > 0")


def _later_and_first(records: DataFrame) -> DataFrame:
    """Inside a genus, every later record with an epithet and ``first``, the one met first.

    The first is found by a partial aggregate, not by listing the group.
    """
    epithet = F.coalesce(F.when(F.col("parts.epithet") != "", F.col("parts.epithet")), F.col("canonicalName"))
    rows = records.filter("genus_above is not null").withColumn("_ep", epithet)
    met = F.struct(F.slice("path", F.lit(1), F.size("path") - 1), F.col("nid"))
    firsts = rows.groupBy("genus_above", "_ep").agg(F.min_by("nid", met).alias("first"), F.count("*").alias("_n"))
    return rows.join(firsts.filter("_n > 1").drop("_n"), ["genus_above", "_ep"]).filter("nid <> first")


def homotypic_within(records: DataFrame) -> DataFrame:
    """(nid, first): ties inside one checklist, each later record with the first one met."""
    later = prefixed(_later_and_first(records), "x_", *_IN_TREE, "parts", "first")
    head = prefixed(records, "y_", *_IN_TREE, "parts")
    pairs = later.join(head, F.col("x_first") == F.col("y_nid"))
    same_type = H.compare_names(F.col("x_parts"), F.col("y_parts")) >= H.MOTION
    return pairs.filter((relation_in_tree("y_", "x_") != rcc5.DISJOINT) & same_type).select(
        F.col("x_nid").alias("nid"), F.col("y_nid").alias("first"))


def homotypic_within_v8(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by version 8: the two must intersect in the tree, and one be declared the
    other's objective synonym or their names be near enough."""
    later = _later_and_first(records).select("nid", "first", "parts")
    head = records.select(F.col("nid").alias("first"), F.col("parts").alias("_parts"))
    pairs = stage(later.join(head, "first").select(
        F.col("nid").alias("x"), F.col("first").alias("y"), (H.classify_v8(F.col("parts"), F.col("_parts")) >= H.MOTION).alias("near")), "pairs")
    meet = compare_in_tree_v8(pairs, nodes.filter("path is not null")).filter(F.col("relation").bitwiseAND(F.lit(rcc5.DISJOINT)) == 0)
    declared = declared_homotypic(nodes)
    said = (declared.toDF("x", "y").unionByName(declared.toDF("y", "x"))).distinct().withColumn("said", F.lit(True))
    return meet.join(said.hint("merge"), ["x", "y"], "left").filter("near or said").select(F.col("x").alias("nid"), F.col("y").alias("first"))


def declared_homotypic(nodes: DataFrame) -> DataFrame:
    """(nid, sup): synonyms declared objective, tied to their own superior."""
    return nodes.filter(F.col("taxonomicStatus").contains("objective") & (F.col("sup") > 0)).select("nid", "sup")


def with_specimens(records: DataFrame, ties: DataFrame) -> DataFrame:
    """Add ``spec``: the within-checklist type specimen, named after its first record."""
    return records.join(ties, "nid", "left").withColumn("spec", F.coalesce("first", "nid")).drop("first")


def _lookups(records: DataFrame, motion: str, version: int = 7) -> DataFrame:
    """Each record once for every class it can reach, with the parts that must be equal."""
    if motion not in ("family", "never"):
        raise ValueError("motion is 'family' or 'never'")
    if version == 8:
        return _lookups_v8(records, _WAYS_V8 if motion == "family" else _WAYS_V8[:4])
    author = F.col("token").isNotNull() & F.col("year").isNotNull()
    genus = F.col("genus").isNotNull()

    def way(code: int, allowed: Column, *equal: str) -> Column:
        fields = [F.when(F.lit(f in equal), F.col(f)).alias(f) for f in ("genus", "token", "year", "family")]
        return F.when(allowed, F.struct(F.lit(code).alias("cls"), *fields))

    ways = [way(H.HOMOTYPIC, author & genus, "genus", "token", "year"),
            way(H.CORRECTION, genus & F.col("token").isNotNull(), "genus", "token"),
            way(H.CORRECTION, genus & F.col("year").isNotNull(), "genus", "year")]
    if motion == "family":
        ways.append(way(H.MOTION, author & F.col("family").isNotNull(), "token", "year", "family"))
    rows = records.filter("epithet is not null").select(
        "side", "spec", "nid", "importance", "key", "epithet", F.explode(F.array(*ways)).alias("_w")).filter("_w is not null")
    # the fields that need not be equal are '' here; a real part is never ''
    bare = [F.coalesce(F.col("_w." + f), F.lit("")).alias(f) for f in ("genus", "token", "year", "family")]
    return rows.select("side", "spec", "nid", "importance", "key", "epithet", F.col("_w.cls").alias("cls"), *bare)


_EQUAL = ["key", "epithet", "cls", "genus", "token", "year", "family"]

#: Ways of meeting in version 8, and the least class of those who meet so.
_WAYS_V8 = [("all", H.HOMOTYPIC), ("any token", H.CORRECTION), ("any year", H.CORRECTION), ("any middle", H.MIDDLE), ("family", H.MOTION)]
#: Those of the last way whose genera agree, or are unknown: not moved.
_UNMOVED = ("family, genus", H.HETEROTYPIC)
_BOTH_KNOWN, _NEITHER = "~", "0"


#: Parts whose being unknown decides how a partner agrees, and whether a name is a protonym.
_TOLD = ("e", "t", "y", "m", "g", "p")


def _told() -> Column:
    """Which of those parts are known: one of 64 sets."""
    p = F.col("parts")
    known = {"e": p["epithet"].isNotNull(), "t": p["token"].isNotNull(), "y": p["year"].isNotNull(), "m": H.middle_v8(p).isNotNull(),
             "g": p["genus"].isNotNull(), "p": F.coalesce(p["protonymp"], F.lit(False))}
    return sum(F.when(known[c], 1 << i).otherwise(0) for i, c in enumerate(_TOLD)).cast("int")


def _with_theirs(records: DataFrame) -> DataFrame:
    """Add ``theirs``: which sets of known parts the other side's records of the same key have, as a bitmap.

    Records whose key the other side lacks are gone.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _told())
    sets = records.groupBy(_other(F.col("side")).alias("side"), "key").agg(F.bit_or(bit).alias("theirs"))
    return records.join(sets, ["side", "key"])


def _lookups_v8(records: DataFrame, ways: list[tuple[str, float]]) -> DataFrame:
    """Each record under every combination of tags by which a partner can agree with it.

    An unknown part agrees with any.  Two parts agree in one of four ways: both are known
    and equal, only A's is known, only B's is, or neither.  A known part has the tags of the
    first way (`=` and its value) and of its own side; an unknown one those of the other
    side and of neither.  So a pair shares exactly one tag of each part that agrees, none of
    one that doesn't, and equality of tags finds all partners without listing pairs.

    A tag says whether the partner's part is known, so combinations of tags are listed only
    where the other side has a record of the same key with just these parts known.

    Where both epithets are known no token or year may be unknown; elsewhere one may.
    """
    p, side, way, theirs = F.col("parts"), F.col("side"), F.col("way.name"), F.col("theirs")

    def those(part: str, known: bool) -> Column:
        """The other side's sets in which the part is known, or is not."""
        bits = sum(1 << n for n in range(1 << len(_TOLD)) if bool(n >> _TOLD.index(part) & 1) == known)
        return theirs.bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint"))

    def tag(text: Column, left: Column = theirs) -> Column:
        return F.struct(text.alias("tag"), left.alias("theirs"))

    def tags(part: str, value: Column) -> Column:
        known, unknown = those(part, True), those(part, False)
        return F.when(value.isNotNull(), F.array(tag(F.concat(F.lit("="), value), known), tag(side, unknown))).otherwise(
            F.array(tag(_other(side), known), tag(F.lit(_NEITHER), unknown)))

    anything = F.array(tag(F.lit("")))
    nothing = F.slice(anything, 1, 0)

    def both_known(part: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(tag(F.lit(_BOTH_KNOWN), those(part, True)))).otherwise(nothing)

    by_family = way.isin("family", _UNMOVED[0])
    # two protonyms in different genera clash: only one may be, or neither
    protonym = F.when(F.coalesce(p["protonymp"], F.lit(False)), F.array(tag(side, those("p", False)))).otherwise(
        F.array(tag(_other(side), those("p", True)), tag(F.lit(_NEITHER), those("p", False))))
    choices = {
        "e": tags("e", p["epithet"]),
        "t": F.when(way == "any token", both_known("t", p["token"])).otherwise(tags("t", p["token"])),
        "y": F.when(way == "any year", both_known("y", p["year"])).otherwise(tags("y", p["year"])),
        "m": F.when(by_family | (way == "any middle"), anything).otherwise(tags("m", H.middle_v8(p))),
        "g": F.when(way == "family", anything).otherwise(tags("g", p["genus"])),
        "p": F.when(by_family, protonym).otherwise(anything),
        "f": F.when(by_family, F.when(F.col("family").isNotNull(), F.array(tag(F.col("family")))).otherwise(nothing)).otherwise(anything),
    }
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(code)).alias("cls")) for name, code in ways])
    rows = _with_theirs(records).select("side", "spec", "nid", "importance", "key", "parts", "family", "theirs", F.explode(listed).alias("way"))
    for name, found in choices.items():
        rows = rows.withColumn("_tag", F.explode(found)).filter("_tag.theirs <> 0")
        rows = rows.withColumns({name: F.col("_tag.tag"), "theirs": F.col("_tag.theirs")}).drop("_tag")
    unknown = sum(((~F.col(c).startswith("=")) & (F.col(c) != _BOTH_KNOWN)).cast("int") for c in "ty")
    rows = rows.filter(unknown <= F.when(F.col("e").startswith("="), 0).otherwise(1))
    # stored: it is read twice, and groups meet by all their columns, not by the key alone
    return stage(rows.select(
        "side", "spec", "nid", "importance", "key", F.col("e").alias("epithet"), "way.cls", F.concat_ws("\u0001", "g", "m", "p").alias("genus"),
        F.col("t").alias("token"), F.col("y").alias("year"), F.col("f").alias("family")), "lookups")


def _other(side: Column) -> Column:
    return F.when(side == "A", "B").otherwise("A")


def candidate_matches_v8(records: DataFrame, motion: str = "family") -> DataFrame:
    """Per record the number of partners in each class of version 8, counted without listing pairs."""
    ways = [*_WAYS_V8, _UNMOVED] if motion == "family" else _WAYS_V8[:4]
    rows = _lookups_v8(records.withColumn("spec", F.col("nid")), ways)
    sizes = rows.groupBy(F.col("side").alias("_side"), *_EQUAL).agg(F.count("*").alias("_n"))
    hit = rows.withColumn("_side", _other(F.col("side"))).join(sizes, ["_side", *_EQUAL])
    full = F.col("cls") == H.HOMOTYPIC

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_n")).otherwise(0))

    found = hit.groupBy("side", "nid").agg(
        total(full).alias("full"), total(F.col("cls") == H.CORRECTION).alias("nearly"),
        # those who agree on everything and are found by any token, by any year as well
        (total(full & F.col("token").startswith("=")) + total(full & F.col("year").startswith("="))).alias("again"),
        total(F.col("cls") == H.MIDDLE).alias("middle"), total(F.col("cls") == H.MOTION).alias("family"),
        total(F.col("cls") == _UNMOVED[1]).alias("unmoved"))
    per = {H.HOMOTYPIC: F.col("full"), H.CORRECTION: F.col("nearly") - F.col("again"), H.MIDDLE: F.col("middle") - F.col("full"),
           H.MOTION: F.col("family") - F.col("unmoved")}
    counts = F.array(*[F.struct(F.lit(float(c)).alias("cls"), n.alias("n_partners")) for c, n in per.items()])
    return found.select("side", "nid", F.inline(counts)).filter("n_partners > 0")


def candidate_matches(records: DataFrame, motion: str = "family") -> DataFrame:
    """Per record the number of partners in each class, counted without listing pairs.

    A group of equal parts also holds the pairs that agree on more; these are taken off by
    counting the finer groups.
    """
    rows = _lookups(records.withColumn("spec", F.col("nid")), motion)
    sizes = rows.groupBy(F.col("side").alias("_side"), *_EQUAL).agg(F.count("*").alias("_n"))
    hit = rows.withColumn("_side", _other(F.col("side"))).join(sizes, ["_side", *_EQUAL])
    by_token = (F.col("cls") == H.CORRECTION) & (F.col("token") != "")
    totals = hit.groupBy("side", "nid").agg(
        F.sum(F.when(F.col("cls") == H.HOMOTYPIC, F.col("_n")).otherwise(0)).alias("full"),
        F.sum(F.when(by_token, F.col("_n")).otherwise(0)).alias("gt"),
        F.sum(F.when((F.col("cls") == H.CORRECTION) & ~by_token, F.col("_n")).otherwise(0)).alias("gy"),
        F.sum(F.when(F.col("cls") == H.MOTION, F.col("_n")).otherwise(0)).alias("ty"))
    out = totals
    if motion == "family":
        # partners of the same family that agree on genus as well are homotypic, not moved
        exact = records.filter("genus is not null and token is not null and year is not null and family is not null and epithet is not null")
        group = ["key", "epithet", "genus", "token", "year", "family"]
        near = exact.groupBy(F.col("side").alias("_side"), *group).agg(F.count("*").alias("near"))
        overlap = exact.withColumn("_side", _other(F.col("side"))).join(near, ["_side", *group]).select("nid", "near")
        out = totals.join(overlap.hint("merge"), "nid", "left")
    else:
        out = totals.withColumn("near", F.lit(0))
    counts = F.array(
        F.struct(F.lit(H.HOMOTYPIC).alias("cls"), F.col("full").alias("n_partners")),
        F.struct(F.lit(H.CORRECTION).alias("cls"), (F.col("gt") + F.col("gy") - 2 * F.col("full")).alias("n_partners")),
        F.struct(F.lit(H.MOTION).alias("cls"), (F.col("ty") - F.coalesce("near", F.lit(0))).alias("n_partners")))
    return out.select("side", "nid", F.inline(counts)).filter("n_partners > 0")


def _two_best(rows: DataFrame, group: list[str], candidate: str, order: list[Column]) -> DataFrame:
    """First and second row per group; Spark limits each partition before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(window)).filter("_r <= 2")


def partner_groups(records: DataFrame, motion: str = "family", version: int = 7) -> DataFrame:
    """Each specimen once per group of equal parts that both sides have; ``n`` partners there.

    The partners of a specimen are the other side's specimens in its groups, those at its
    best class in the groups marked ``top``.  The table lists all of them without pairs.
    """
    mine = _lookups(records, motion, version).select("side", "spec", *_EQUAL).distinct()
    sizes = mine.groupBy(*_EQUAL).agg(
        F.count_if(F.col("side") == "A").alias("_a"), F.count_if(F.col("side") == "B").alias("_b"))
    met = mine.join(sizes.filter("_a > 0 and _b > 0"), _EQUAL)
    # a window over one specimen's groups, as a join with its best class would meet the groups twice
    best = F.max("cls").over(Window.partitionBy("side", "spec"))
    return met.select(
        "side", "spec", *_EQUAL, F.when(F.col("side") == "A", F.col("_b")).otherwise(F.col("_a")).alias("n"),
        (F.col("cls") == best).alias("top"))


def partner_counts(groups: DataFrame) -> DataFrame:
    """(side, spec, n_partners): distinct partner specimens at the best class.

    Groups are added up.  A partner met in several groups is taken off again; those are
    counted per set of groups, of which there are as many as different parts, not specimens.
    """
    sets = groups.groupBy("side", "spec", "cls").agg(
        F.sort_array(F.collect_list(F.struct(*_EQUAL))).alias("set"), F.sum("n").alias("_n"), F.first("top").alias("top"))
    many = sets.filter(F.size("set") > 1)

    def two(df: DataFrame, name: str) -> DataFrame:
        rest = lambda x, i: F.transform(F.slice(F.col(name), i + 2, F.size(name)), lambda y: F.struct(x.alias("x"), y.alias("y")))
        return df.withColumn("_two", F.explode(F.flatten(F.transform(name, rest))))

    theirs = two(many.groupBy(_other(F.col("side")).alias("side"), "cls", F.col("set").alias("_set")).agg(F.count("*").alias("_m")), "_set")
    both = two(many.filter("top").select("side", "cls", "set").distinct(), "set").join(theirs.hint("merge"), ["side", "cls", "_two"])
    shared = F.array_intersect("set", "_set")
    # two sets meet once for any two groups they share: the first two count
    again = both.filter((F.col("_two.x") == shared[0]) & (F.col("_two.y") == shared[1])).groupBy("side", "cls", "set").agg(
        F.sum(F.col("_m") * (F.size(shared) - 1)).alias("_again"))
    return sets.filter("top").join(again.hint("merge"), ["side", "cls", "set"], "left").select(
        "side", "spec", (F.col("_n") - F.coalesce("_again", F.lit(0))).alias("n_partners"))


def _with_places(records: DataFrame, version: int) -> DataFrame:
    """Records with their place by importance and specimen for ``importance``.

    Each record is looked up in several ways; a place is a number that hash aggregates can
    take the least of, where texts would be shuffled and sorted with every lookup.
    """
    compared = ("parts", "family") if version == 8 else ("epithet", "genus", "token", "year", "family")
    kept = records.select("side", "spec", "nid", "importance", "key", *compared)
    placed = positions(kept, ["importance.status", "importance.form", "importance.children", "importance.synonyms",
                              "importance.scientific", "importance.taxonID", "spec"], "_place")
    return placed.withColumn("importance", F.col("_place")).drop("_place")


def _group_text() -> Column:
    """The equal parts as one text: the class and the lengths of the parts tell where each begins."""
    texts = [c for c in _EQUAL if c != "cls"]
    lengths = [F.concat(F.length(c).cast("string"), F.lit(",")) for c in texts]
    return F.concat(F.col("cls").cast("string"), F.lit(","), *lengths, *texts)


def best_matches(records: DataFrame, motion: str = "family", version: int = 7) -> DataFrame:
    """Per specimen: its best class and its first two partner specimens in that class.

    ``second`` is NULL when the partner is unique.  The rules ask whether there is one or
    more, and compare the two most important; ``partner_groups`` has all of them and
    ``partner_counts`` their exact number.
    """
    rows = _lookups(_with_places(records, version), motion, version)
    # equal parts are told by one text, and a number leads every sort by it
    rows = rows.select("side", "spec", "cls", F.col("importance").alias("_imp"), _group_text().alias("_group")).withColumn("_g", F.xxhash64("_group"))
    group = ["_g", "_side", "_group"]
    specimens = rows.groupBy("_g", F.col("side").alias("_side"), "_group", F.col("spec").alias("cand")).agg(F.min("_imp").alias("_imp"))
    two = _two_best(specimens, group, "cand", [F.col("_imp")]).drop("_r")
    # records of one specimen in one group are not made distinct here: what they see is summed up below
    mine = rows.select("_g", _other(F.col("side")).alias("_side"), "_group", "side", "spec", "cls")
    seen = mine.join(two.hint("merge"), group)
    ranked = seen.groupBy("spec", "cand", "side").agg(
        F.max("cls").alias("cls"), F.min("_imp").alias("_imp"))
    top = _two_best(ranked, ["spec", "side"], "cand", [F.col("cls").desc(), F.col("_imp")])
    out = top.groupBy("side", "spec").agg(
        F.max("cls").alias("cls"),
        F.max(F.when(F.col("_r") == 1, F.col("cand"))).alias("first"),
        F.max(F.when(F.col("_r") == 2, F.col("cand"))).alias("second"), F.max(F.when(F.col("_r") == 2, F.col("cls"))).alias("_cls"))
    return out.select("side", "spec", "cls", "first", F.when(F.col("_cls") == F.col("cls"), F.col("second")).alias("second"))


def representatives(members: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, side, rep): the record that stands for a specimen on each side.

    Order: higher rank, no ancestor in the group, protonym, accepted, more children,
    older, earlier name.
    """
    info = nodes.select("nid", "side", "path", "accepted", "n_children", "canonicalName",
                        rank_number("rank").alias("_rank"), F.col("parts.protonymp").alias("_proto"),
                        F.col("parts.year").alias("_year"))
    members = members.select(group, "nid").distinct()
    rows = members.join(info, "nid")
    # a record can only be inside another where a group has several of one side
    crowds = members.join(nodes.select("nid", "side"), "nid").groupBy(group, "side").agg(F.count("*").alias("_n")).filter("_n > 1")
    above = rows.join(crowds.hint("merge"), [group, "side"], "left_semi").select(
        group, F.col("nid").alias("_below"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("nid"))
    lower = above.join(rows.select(group, "nid").hint("merge"), [group, "nid"], "left_semi").select(
        group, F.col("_below").alias("nid"), F.lit(1).alias("_inside")).distinct()
    order = F.struct(
        F.coalesce(-F.col("_rank"), F.lit(0)), F.coalesce("_inside", F.lit(0)),
        (~F.coalesce("_proto", F.lit(False))).cast("int"), (~F.col("accepted")).cast("int"),
        -F.col("n_children"), F.coalesce("_year", F.lit("9999")), F.col("canonicalName"), F.col("nid"))
    return rows.join(lower.hint("merge"), [group, "nid"], "left").groupBy(group, "side").agg(F.min_by("nid", order).alias("rep"))


def match_decisions(best: DataFrame, nodes: DataFrame, ties: DataFrame, version: int = 7) -> DataFrame:
    """One row per A specimen with a candidate: what the mutual-best rules decide.

    Columns: spec, cls, outcome, and the tied specimens ``u1``-``v1`` and, for a double tie, ``u2``-``v2``.
    """
    several = ties.select(F.col("first").alias("spec"), "nid").unionByName(
        ties.select(F.col("first").alias("spec"), F.col("first").alias("nid")).distinct())
    # no side of these joins is broadcast unasked, also where empty tables around it fall away
    reps = representatives(several, nodes, "spec").select("spec", "rep").hint("merge")
    ambiguous = best.filter("second is not null").select("spec", "first", "second")
    for end in ("first", "second"):
        ambiguous = ambiguous.join(reps.select(F.col("spec").alias(end), F.col("rep").alias("_" + end)), end, "left")
        ambiguous = ambiguous.withColumn("_" + end, F.coalesce("_" + end, end))
    if version == 8:
        pairs = ambiguous.select("spec", F.col("_first").alias("x"), F.col("_second").alias("y"))
        related = compare_in_tree_v8(pairs, nodes.filter("path is not null"))
        flag = nodes.select("nid", "accepted")
        related = related.join(flag.toDF("x", "x_accepted"), "x").join(flag.toDF("y", "y_accepted"), "y")
    else:
        tree = nodes.select(*_IN_TREE)
        related = (ambiguous.select("spec", "_first", "_second")
                   .join(prefixed(tree, "x_"), F.col("_first") == F.col("x_nid"))
                   .join(prefixed(tree, "y_"), F.col("_second") == F.col("y_nid"))
                   .withColumn("relation", relation_in_tree("x_", "y_")))
    checked = related.select(
        "spec", (F.col("relation").bitwiseAND(F.lit(rcc5.DISJOINT)) != 0).alias("apart"),
        (F.col("x_accepted") & F.col("y_accepted")).alias("both_accepted"))
    full = best.join(checked.hint("merge"), "spec", "left")
    a = full.filter("side = 'A'").select("spec", "cls", "first", "second", "apart", "both_accepted")
    b = full.filter("side = 'B'").select(F.col("spec").alias("first"), F.col("first").alias("b_first"),
                                         F.col("second").alias("b_second"), F.col("apart").alias("b_apart"))
    j = a.join(b.hint("merge"), "first", "left")
    many, back_many = F.col("second").isNotNull(), F.col("b_second").isNotNull()
    outcome = (
        F.when(many & ~F.col("both_accepted"), "not both accepted")
        .when(many & F.col("apart"), "B ambiguity")
        .when(many, "double B")
        .when(F.col("b_first").isNull(), "no return")
        .when(back_many & F.col("b_apart"), "A ambiguity")
        .when(back_many, "double A")
        .when(F.col("b_first") != F.col("spec"), "vee")
        .otherwise("match"))
    double_a, double_b = F.col("outcome") == "double A", F.col("outcome") == "double B"
    tied = double_a | double_b | (F.col("outcome") == "match")
    return j.withColumn("outcome", outcome).select(
        "spec", "cls", "outcome",
        F.when(tied, F.when(double_a, F.col("b_first")).otherwise(F.col("spec"))).alias("u1"),
        F.when(tied, F.col("first")).alias("v1"),
        F.when(double_a, F.col("b_second")).when(double_b, F.col("spec")).alias("u2"),
        F.when(double_a, F.col("first")).when(double_b, F.col("second")).alias("v2"))


def mutual_best(decisions: DataFrame) -> DataFrame:
    """(u, v): ties between A and B specimens."""
    ends = F.array(F.struct(F.col("u1").alias("u"), F.col("v1").alias("v")),
                   F.struct(F.col("u2").alias("u"), F.col("v2").alias("v")))
    return decisions.filter("u1 is not null").select(F.inline(ends)).filter("u is not null").distinct()


def match_review(decisions: DataFrame) -> DataFrame:
    """Specimens whose candidates led to no tie."""
    return decisions.filter("u1 is null").select("spec", "cls", "outcome")


def review_counts(decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """The same with the number of candidates."""
    return match_review(decisions).join(counts.filter("side = 'A'").select("spec", "n_partners"), "spec")


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the least node id reachable over the edges.

    Pairs that touch nothing else are done at once.  For the rest each round takes the
    least label among the neighbours (a partial aggregate, so a hub costs one row per map
    task) and then jumps to the label of that label.
    """
    both = stage(edges.select(F.col(left).alias("s"), F.col(right).alias("t"))
                 .unionByName(edges.select(F.col(right).alias("s"), F.col(left).alias("t")))
                 .filter("s <> t").distinct(), "edges")
    degree = both.groupBy("s").agg(F.count("*").alias("n"), F.min("t").alias("only"))
    single = degree.filter("n = 1").select("s", "only")
    lone = single.join(single.select(F.col("s").alias("only")), "only", "left_semi")
    paired = stage(lone.select(F.col("s").alias("node"), F.least("s", "only").alias("component")), "pairs")
    rest = both.join(paired.select(F.col("node").alias("s")), "s", "left_anti")
    if rest.isEmpty():
        return paired
    rest = stage(rest, "edges")
    labels = rest.groupBy(F.col("s").alias("node")).agg(F.min("t").alias("t")).select(
        "node", F.least("node", "t").alias("component"))
    labels = stage(labels, "labels")
    while True:
        around = (rest.join(labels, F.col("t") == F.col("node")).groupBy(F.col("s").alias("node"))
                  .agg(F.min("component").alias("_near")))
        closer = labels.join(around, "node").select("node", "component", F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_far"))
        moved = closer.join(jump, "_new", "left").select(
            "node", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") < F.col("component")).alias("_moved"))
        moved = stage(moved, "labels")
        labels = moved.select("node", "component")
        if moved.filter("_moved").isEmpty():
            break
    return paired.unionByName(labels)


_TOP_EXEMPLAR = -1


def _with_top(members: DataFrame, nodes: DataFrame) -> DataFrame:
    tops = nodes.filter("level = 1").select(F.lit(_TOP_EXEMPLAR).cast("bigint").alias("exemplar_id"), "side", "nid")
    return members.select("exemplar_id", "side", "nid").unionByName(tops)


def exemplars_from(records: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(exemplar_id, side, nid): members of specimens found in both checklists, roots included."""
    component = connected_components(edges).select(F.col("node").alias("spec"), "component")
    rows = records.join(component, "spec").select("component", "side", "nid", "_ord")
    ids = rows.filter("side = 'A'").groupBy("component").agg(F.min("_ord").alias("exemplar_id"))
    return stage(_with_top(rows.join(ids.hint("merge"), "component"), nodes), "exemplars")


def read_exemplars(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exemplars given as rows (checklist, taxonID, exemplar id); records that share an id merge."""
    rows = _given(table).join(nodes.filter("level > 1").select("side", "taxonID", "nid"), ["side", "taxonID"])
    rows = stage(rows.select("side", "nid", "sid").distinct(), "given")
    edges = rows.select(F.col("nid").alias("u"), (-F.col("sid") - 10).alias("v"))
    component = connected_components(edges)
    members = rows.join(component, F.col("nid") == F.col("node")).select("component", "side", "nid", "sid")
    ids = members.groupBy("component").agg(
        F.min("sid").alias("exemplar_id"), F.count_if(F.col("side") == "A").alias("_a"),
        F.count_if(F.col("side") == "B").alias("_b")).filter("_a > 0 and _b > 0")
    both = members.select("component", "side", "nid").distinct().join(ids, "component")
    return stage(_with_top(both, nodes), "exemplars")


def _given(table: DataFrame) -> DataFrame:
    side = F.when(F.col("checklist").isin("A", "0"), "A").when(F.col("checklist").isin("B", "1"), "B")
    return table.select(side.alias("side"), "taxonID", F.col("exemplar id").cast("bigint").alias("sid"))


def unknown_exemplars(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an exemplar table that name no record."""
    return _given(table).join(nodes.select("side", "taxonID"), ["side", "taxonID"], "left_anti")


def exemplar_epithets(exemplars: DataFrame, nodes: DataFrame) -> DataFrame:
    """(exemplar_id, rep_a, rep_b, epithet): representatives and a label, the lookup table of exemplars."""
    reps = representatives(exemplars, nodes, "exemplar_id")
    wide = reps.groupBy("exemplar_id").agg(
        F.max(F.when(F.col("side") == "A", F.col("rep"))).alias("rep_a"),
        F.max(F.when(F.col("side") == "B", F.col("rep"))).alias("rep_b"))
    label = F.coalesce(F.when(F.col("parts.epithet") != "", F.col("parts.epithet")), F.col("parts.genus"), F.col("canonicalName"))
    named = nodes.select(F.col("nid").alias("rep_a"), label.alias("epithet"))
    return wide.join(named, "rep_a", "left")


def exemplar_stats(records: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Per side: records, specimens, records with an exemplar, exemplars."""
    mine = exemplars.filter("exemplar_id >= 0").select("exemplar_id", "nid")
    return records.join(mine, "nid", "left").groupBy("side").agg(
        F.count("*").alias("records"), F.count_distinct("spec").alias("specimens"),
        F.count("exemplar_id").alias("with_exemplar"), F.count_distinct("exemplar_id").alias("exemplars"))


def exemplar_table(exemplars: DataFrame, lookup: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an exemplar file, the roots left out."""
    names = nodes.select("nid", "taxonID", "canonicalName")
    return (exemplars.filter("exemplar_id >= 0").join(lookup.select("exemplar_id", "epithet"), "exemplar_id")
            .join(names, "nid")
            .select(F.col("exemplar_id").alias("exemplar id"), "epithet", F.col("side").alias("checklist"), "taxonID", "canonicalName")
            .orderBy("exemplar id", "checklist", "canonicalName", "taxonID"))
