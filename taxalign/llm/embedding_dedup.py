"""Near-duplicate embeddings by collision-counting projections.

Vectors of length one are projected on ``m`` orthonormal directions.  Two vectors collide
on a direction if the second lies in the window of half-width ``w`` around the first.  For
a cosine of ``c`` the squared differences over all directions sum to ``2 - 2 c`` at most,
so fewer than ``(2 - 2 c) / w**2`` directions lie outside the window: every pair with the
cosine has at least ``m`` less that many collisions.  With ``w`` set so that ``MISS`` of
the directions may miss, that count is the threshold and its recall is one, not an
estimate; pairs that reach it are verified by the cosine of the original vectors.

*Work.*  Equal vectors form a class and are compared once.  Classes are sorted by their
first projection and cut into blocks of ``BLOCK``; blocks meet if their ranges come within
the widest difference that a pair with the cosine can have.  Each meeting counts
collisions query by query against the windows of the other projections, a byte per
projection, and returns per vector the number of links, and enough links to span the
components inside the meeting.  So no list of pairs is written, and a group of any size
costs counts.  Work still grows with the square of the number of different vectors: in
many dimensions one projection separates little, and each of its windows holds a large
part of all vectors.

Defined results: null or empty vectors, and those with null or non-finite components or only
zeros, link with nothing; vectors of different dimensions
don't link; rows that repeat an id count as vectors of their own and share a node's id; a
null id is counted as a row and has the component's smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow
from taxalign.llm.components import components
from taxalign.llm.tables import write
from taxalign.operators.numbering import number_within

COSINE = 0.95
DIRECTIONS, MISS = 40, 0.44
#: Vectors of a block, and queries that are compared with a block at a time.
BLOCK, QUERIES = 8192, 64
#: A product of matrices that is this near the threshold is computed again, pair by pair.
CLOSE = 1e-9
_SEED = 20_26


def directions(dim: int) -> np.ndarray:
    """``min(dim, DIRECTIONS)`` orthonormal columns, the same for every worker."""
    square = np.random.default_rng(_SEED + dim).standard_normal((dim, dim))
    return np.linalg.qr(square)[0][:, :min(dim, DIRECTIONS)]


def allowed(m: int, cosine: float) -> tuple[float, int]:
    """Half-width of the windows, and how many of ``m`` directions may miss."""
    miss = max(int(MISS * m), 1)
    return float(np.sqrt((2.0 - 2.0 * cosine) / miss)) + 1e-6, miss


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is brought to one first, so no square over- or underflows."""
    scaled = raw / np.abs(raw).max(axis=1)[:, None]
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def quantised(unit: np.ndarray) -> np.ndarray:
    """Projections as bytes, a row per direction; the outermost values share a byte."""
    p = unit @ directions(unit.shape[1])
    return np.clip(np.rint(p * 254.0) + 128.0, 0, 255).astype(np.uint8).T.copy()


def candidates(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the vectors ``y`` collide often enough with each of ``x``; both as bytes."""
    m = len(x)
    half, miss = allowed(m, cosine)
    half = min(int(np.ceil(half * 254.0)) + 1, 127)
    counts = np.zeros((x.shape[1], y.shape[1]), np.uint8)
    for k in range(m):
        low = (x[k].astype(np.int16) - half).astype(np.uint8)  # bytes wrap: only more may collide
        counts += (y[k][None, :] - low[:, None]) <= 2 * half
    return counts >= m - miss


def linked(x: np.ndarray, qx: np.ndarray, y: np.ndarray, qy: np.ndarray, cosine: float):
    """Yield (rows of x, rows of y) with the cosine; ``x`` and ``y`` are units in double."""
    for at in range(0, len(x), QUERIES):
        some = slice(at, at + QUERIES)
        maybe = candidates(qx[:, some], qy, cosine)
        if maybe.mean() > 0.02:
            product = x[some] @ y.T
            i, j = np.nonzero(maybe & (product >= cosine - CLOSE))
            open_ = product[i, j] < cosine + CLOSE
        else:
            i, j = np.nonzero(maybe)
            open_ = np.ones(len(i), bool)
        # by one formula for every pair, however many meet here
        good = ~open_
        good[open_] = np.einsum("ij,ij->i", x[some][i[open_]], y[j[open_]]) >= cosine
        i, j = i[good], j[good]
        if len(i):
            yield i + at, j


class Forest:
    """Spanning links among ``n`` places."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            differ = a != b
            if not differ.any():
                return
            u, v = u[differ], v[differ]
            high, low = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            np.minimum.at(label, high, low)
            while not np.array_equal(label, label[label]):
                label[:] = label[label]


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, usable) of every row."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    return rows.withColumn("usable", usable)


def _blocks(classes: DataFrame) -> DataFrame:
    """(class, dim, lead, block): classes in order of their first projection."""
    found: dict[int, np.ndarray] = {}

    def first(dim: int) -> np.ndarray:
        if dim not in found:
            found[dim] = directions(dim)[:, 0].copy()
        return found[dim]

    def project(batches):
        for batch in batches:
            lists = batch.column(1)
            lead = np.zeros(batch.num_rows)
            for i, v in enumerate(lists):
                unit = units(np.array(v.values)[None, :])[0]
                lead[i] = unit @ first(len(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.value_lengths(), pa.array(lead)], ["class", "dim", "lead"])

    leads = map_arrow(classes.select("class", "v"), project, "class long, dim int, lead double")
    placed = number_within(leads, ["dim"], ["lead", "class"], "place")
    return placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("long")).drop("place")


def near_copies(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, n_links, component_id and kept of every row of ``df``."""
    rows = write(_vectors(df, key, vector), "vectors")
    good = rows.where("usable")
    classes = good.groupBy("v").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    classes = write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    placed = write(_blocks(classes).join(classes, "class"), "placed")
    ranges = placed.groupBy("dim", "block").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    ranges = write(ranges, "ranges")  # a row for each ``BLOCK`` classes
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + 1e-6
    x, y = (ranges.select("dim", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "low", "high")]) for p in "xy")
    near = (F.col("x_block") <= F.col("y_block")) & (F.col("y_low") <= F.col("x_high") + reach)
    pairs = x.join(y, "dim").where(near).select("dim", F.col("x_block").alias("i"), F.col("y_block").alias("j"))
    ends = pairs.select("dim", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("block"))
    members = placed.select("dim", "block", "class", "size", "v")

    def compare(table: pa.Table) -> pa.Table:
        n = table.num_rows
        block, of = (table.column(c).to_numpy() for c in ("block", "class"))
        order = np.lexsort((of, block))
        block, of, size = block[order], of[order], table.column("size").to_numpy()[order]
        raw = np.array(table.column("v").combine_chunks().flatten()).reshape(n, -1)[order]
        unit = units(raw)
        bytes_ = quantised(unit)
        low, high = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        cut = int(np.searchsorted(block, low, "right"))
        base = 0 if low == high else cut
        links, forest = np.zeros(n, np.int64), Forest(n)
        for i, j in linked(unit[:cut], bytes_[:, :cut], unit[base:], bytes_[:, base:], cosine):
            j = j + base
            if low == high:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, size[j], n).astype(np.int64) + np.bincount(j, size[i], n).astype(np.int64)
            forest.add(i, j)
        some = np.flatnonzero(links)
        return pa.table({"class": of[some], "links": links[some], "root": of[forest.label[some]]})

    met = ends.join(members, ["dim", "block"])
    # meetings are heavy and few: each is a group of its own, of two blocks at most
    found = write(met.groupBy("dim", "i", "j").applyInArrow(compare, "class long, links long, root long"), "meetings")
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v"))
    labels = components(edges)
    named = classes.join(sums, "class", "left").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = write(named.select("class", "v", "size", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("v", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.where("usable").join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
