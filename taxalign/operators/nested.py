"""Trees as nested text, `(b,c*,(e)d)a`: children in brackets before their parent.

A text is one value of a table.  Reading takes all texts of the table apart into tokens and
works on these; writing puts the pieces of all trees together from intervals of a walk.
A name ending in `*` is a synonym.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import known


def _rank(name: Column) -> Column:
    """Rank told by the form of a name: two or three words, the first with a capital."""
    words = F.split(name, " ")
    small = lambda i: (F.lower(F.get(words, F.lit(i))) == F.get(words, F.lit(i))) & (F.upper(F.get(words, F.lit(i))) != F.get(words, F.lit(i)))
    capital = F.coalesce(name.rlike(r"^\p{Lu}"), F.lit(False))
    return (F.when(capital & (F.size(words) == 2) & small(1), "species")
            .when(capital & (F.size(words) == 3) & small(1) & small(2), "subspecies").otherwise(""))


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, token, level, starts, named): brackets, commas and names with their place and depth.

    ``level`` of a bracket is the depth outside it, of anything else the depth it stands at.
    """
    cut = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"[(),]|[^(),]+"), F.lit(0))).alias("at", "token"))
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)
    row = Window.partitionBy(key).orderBy("at")
    return cut.withColumns({"depth": depth, "before": F.lag("token").over(row), "after": F.lead("token").over(row)}).withColumn(
        "level", F.when(opens, F.col("depth") - 1).otherwise(F.col("depth")))


def unbalanced(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key): texts whose brackets don't match."""
    tokens = _tokens(df, key, text)
    return tokens.groupBy(key).agg(F.min("depth").alias("_least"), F.max_by("depth", "at").alias("_end")).filter("_least < 0 or _end <> 0").select(key)


def read_nested(df: DataFrame, key: str, text: str) -> DataFrame:
    """Checklist rows of every text: key, taxonID, canonicalName, parentNameUsageID, acceptedNameUsageID, taxonomicStatus, taxonRank.

    Ids count the taxa of a text as a walk meets them, parents first.  A taxon begins at its
    opening bracket, or at its name if it has no children; the two belong together because
    brackets of one depth take turns.  Its parent is the taxon that begins at the last
    opening bracket one level up.
    """
    tokens = _tokens(df, key, text)
    name = ~F.col("token").isin("(", ")", ",")
    # a place for a taxon: a closing bracket, or a leaf; the name follows or stands there
    blank = F.lit("")
    closing = tokens.filter("token = ')'").select(
        key, "at", "level", F.lit(True).alias("inner"), F.when(~F.col("after").isin("(", ")", ","), F.col("after")).otherwise(blank).alias("name"))
    leaf = tokens.filter(name & F.coalesce(F.col("before") != ")", F.lit(True))).select(key, "at", "level", F.lit(False).alias("inner"), F.col("token").alias("name"))
    # a leaf without a name: nothing between an opening bracket or comma and a comma or closing bracket
    empty = tokens.filter(F.col("token").isin("(", ",") & F.coalesce(F.col("after"), F.lit(")")).isin(",", ")")).select(
        key, (F.col("at") + 0.5).alias("at"), F.col("depth").alias("level"), F.lit(False).alias("inner"), blank.alias("name"))
    first = tokens.filter("at = 0 and token = ','").select(key, F.lit(-0.5).alias("at"), F.lit(0).cast("long").alias("level"), F.lit(False).alias("inner"), blank.alias("name"))
    opening = tokens.filter("token = '('").select(key, "at", "level", F.lit(None).cast("boolean").alias("inner"), F.lit(None).cast("string").alias("name"))
    events = opening
    for more in (closing, leaf, empty, first):
        events = events.unionByName(more)
    # within one depth an opening bracket is the latest before its closing one
    here = Window.partitionBy(key, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("inner").isNull(), F.col("at")), ignorenulls=True)
    events = events.withColumn("begins", F.when(F.col("inner"), opened.over(here)).otherwise(F.col("at")))
    # one level up, the latest opening bracket encloses a taxon
    lifted = events.filter("inner is not null").select(key, F.col("begins").alias("at"), "name", (F.col("level") - 1).alias("level"), F.lit(True).alias("taxon"))
    around = opening.select(key, "at", F.lit(None).cast("string").alias("name"), "level", F.lit(False).alias("taxon")).unionByName(lifted)
    last = F.last(F.when(~F.col("taxon"), F.col("at")), ignorenulls=True).over(
        Window.partitionBy(key, "level").orderBy("at", "taxon").rowsBetween(Window.unboundedPreceding, -1))
    taxa = around.withColumn("_above", last).filter("taxon")
    number = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    taxa = taxa.select(key, "at", "_above", "name", number.cast("string").alias("taxonID"))
    parents = taxa.select(key, F.col("at").alias("_above"), F.col("taxonID").alias("_parent"))
    out = taxa.join(parents, [key, "_above"], "left").withColumn("_parent", F.coalesce("_parent", F.lit("")))
    synonym = F.col("name").endswith("*")
    plain = F.trim(F.when(synonym, F.substring("name", F.lit(1), F.length("name") - 1)).otherwise(F.col("name")))
    return out.select(
        key, "taxonID", plain.alias("canonicalName"), F.when(synonym, "").otherwise(F.col("_parent")).alias("parentNameUsageID"),
        F.when(synonym, F.col("_parent")).otherwise("").alias("acceptedNameUsageID"),
        F.when(synonym, "synonym").otherwise("accepted").alias("taxonomicStatus"), _rank(plain).alias("taxonRank"))


def write_nested(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, text): the tree below each root (nid) as one text, in the order of a walk.

    A piece goes where its node's interval begins (an opening bracket, or a leaf's name) or
    ends (a closing bracket and the name); of intervals that end together the deepest ends
    first.  Rows with the status `equivalent` are left out.
    """
    spans = roots.select(F.col("nid").alias("root")).join(nodes.select(F.col("nid").alias("root"), "side", F.col("pre").alias("_pre"), F.col("last").alias("_last")), "root")
    above = spans.select("root")
    held = nodes.filter("path is not null and taxonomicStatus <> 'equivalent'").select("nid", "sup", "path", "level", "pre", "last", "accepted", "canonicalName")
    # a node belongs to the roots on its path; roots are few beside the nodes
    inside = held.withColumn("root", F.explode("path")).join(above, "root")
    label = F.concat("canonicalName", F.when(F.col("accepted"), "").otherwise("*"))
    kids = held.groupBy(F.col("sup").alias("nid")).agg(F.min("pre").alias("_first"))
    firsts = kids.select(F.col("nid").alias("sup"), F.col("_first").alias("pre"), F.lit(True).alias("first"))
    inside = inside.join(kids.select("nid", F.lit(True).alias("has")), "nid", "left").join(firsts, ["sup", "pre"], "left")
    comma = F.when(F.coalesce("first", F.lit(False)) | (F.col("nid") == F.col("root")), "").otherwise(",")
    piece = lambda at, phase, depth, text: F.struct(at.alias("at"), F.lit(phase).alias("phase"), depth.alias("depth"), text.alias("text"))
    level, nothing = F.col("level"), F.lit(0)
    pieces = F.when(F.coalesce("has", F.lit(False)), F.array(
        piece(F.col("pre"), 0, nothing, F.concat(comma, F.lit("("))), piece(F.col("last"), 1, -level, F.concat(F.lit(")"), label)))).otherwise(
        F.array(piece(F.col("pre"), 0, nothing, F.concat(comma, label))))
    # one text per root, as long as its tree: it is one value of the result
    listed = F.sort_array(F.collect_list("p"))
    return inside.select("root", F.explode(pieces).alias("p")).groupBy("root").agg(
        F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"))
