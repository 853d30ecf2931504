"""Connected components of links that no driver or task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.tables import drop, write


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``links`` (u, v).

    Alternates two steps until nothing changes: every node ties its larger neighbours, then
    its smaller ones, to the smallest it knows.  Both are an aggregate with partial minima
    and a join that has one row per node on one side, so a node with any number of links is
    fine.  Rounds grow with the logarithm of a component's size.
    """
    links = write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)).alias("s")).alias("mark")
    before = links.agg(mark).first()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = write(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        drop(links)
        links, now = following, following.agg(mark).first()
        if now == before:
            break
        before = now
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (u, v) with the components u_in and v_in of their ends; a node without a label is its own."""
    for end in ("u", "v"):
        known = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        pairs = pairs.join(known, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    return pairs


def joined(labels: DataFrame, links: DataFrame, whole: bool = False) -> DataFrame:
    """``labels`` (node, component) after components have been joined by ``links`` (u, v), as a written table.

    Each component that is linked to a smaller one hooks onto the smallest; hooks form a
    forest, whose roots pointer jumping finds.  A component with several smaller neighbours
    may need another turn for the others; ``whole`` takes turns until no link leads from one
    component to another.

    Most turns have few links, labels or hooks, so small ones may be broadcast.
    """
    while True:
        apart = labelled(links, labels).where("u_in <> v_in")
        hooks = apart.groupBy(F.greatest("u_in", "v_in").alias("c")).agg(F.min(F.least("u_in", "v_in")).alias("p"))
        hooks = write(hooks.withColumn("open", F.lit(True)), "hooks", merge=False)
        if hooks.isEmpty():
            drop(hooks)
            return labels
        while True:
            above = hooks.select(F.col("c").alias("p"), F.col("p").alias("q"), F.lit(True).alias("moved"))
            jumped = hooks.join(above, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.coalesce("moved", F.lit(False)).alias("open"))
            jumped = write(jumped, "hooks", merge=False)
            drop(hooks)
            hooks = jumped
            if hooks.where("open").isEmpty():
                break
        new = hooks.join(labels.select(F.col("node").alias("c")), "c", "left_anti").select(F.col("c").alias("node"), F.col("p").alias("component"))
        old = labels.join(hooks.select(F.col("c").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        following = write(old.unionByName(new), "labels", merge=False)
        drop(labels, hooks)
        labels = following
        if not whole:
            return labels
