"""N-gram Jaccard join by signature trees.

A document's set holds its distinct shingles of ``WIDTH`` words, as 64-bit hashes.  Equal
sets form a class and are compared once.

1. *Sets.*  One pass gives each document the size of its set, two digests of it and a token
   bitmap of ``SIG`` bits, and counts all tokens in a sketch of fixed size.
2. *Prefixes.*  Under any order of tokens, two sets with the similarity share a token among
   the first ``n - ceil(0.75 n) + 1`` of either.  Tokens that the sketch shows as frequent
   come last, so common passages seldom enter a prefix.  The sketch only chooses the order.
3. *Groups.*  Prefix entries meet by token; those whose token occurs in one class only are
   gone.  A frequent token's entries are dealt over many tasks for this.
4. *Chains.*  Neighbours in each group, by size, and each entry with the first of its group
   come before all others.  Large groups of near copies become one component this way, at
   the cost of their entries, not their pairs.
5. *Trees.*  Groups that still hold several components become trees: leaves of ``LEAF``
   entries, parents of ``FAN`` nodes.  A node has the OR of its bitmaps, its range of sizes,
   the most tokens that share bits inside one set, and its range of components.  A dual
   traversal from the roots drops a pair of nodes if even the largest overlap that the
   common bits allow is short of what the smallest sizes need, if the size ranges are too
   far apart, or if both lie in one and the same component.  Leaves that remain are
   compared entry by entry under the same bound, and what is left is verified.  Two sets
   meet in every group that both are in; the pair is made in the first one only, by token,
   as far as the ``LEAST`` smallest tokens of each tell.

Verification intersects whole sets, the likeliest pair of each class first; then those of
the rest whose ends are still in different components, for a few rounds, and all that are
left after these.  A pair inside one component is never needed, since
components are what is asked for; no pair between components is skipped.

Defined results: null texts, and texts without words, have size 0 and their own id as
component; fewer than ``WIDTH`` words are one shingle; documents that repeat an id are
compared by their own sets, and a null id has the smallest id of its group.  A clash of
64-bit digests (N**2 / 2**65 for N different sets) would join two sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow, steps, utf8
from taxalign.llm.components import joined, labelled
from taxalign.llm.tables import drop, fresh, release, write
from taxalign.llm.words import mix, word_hashes
from taxalign.operators.numbering import number_within

WIDTH = 5
#: Similarity as a fraction, so that thresholds are exact.
NUM, DEN = 75, 100
SIG = 512
LEAF, FAN = 64, 8
#: Counters of the sketch, and the parts it is summed in.
SKETCH, SLICES = 1 << 22, 64
#: Rounds in which each class has its likeliest pair verified, before all the rest is.
ROUNDS = 3
#: Least tokens of a class by which a pair is told to have met in another group already.
LEAST = 32
#: Tasks over which a frequent token's entries are dealt.
SALTS = 64

_WORDS = SIG // 64
_SIGS = [f"s{i}" for i in range(_WORDS)]
_WEIGHTS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch."""
    raw, begins = utf8(batch.column(column))
    words, texts = word_hashes(raw, begins)
    bounds = np.searchsorted(texts, np.arange(batch.num_rows + 1))
    m = len(words) - WIDTH + 1
    grams = np.zeros(0, np.uint64)
    if m > 0:
        grams = words[:m] * _WEIGHTS[0]
        for j in range(1, WIDTH):
            grams += words[j:m + j] * _WEIGHTS[j]
        grams = mix(grams)
    out = []
    for i in range(batch.num_rows):
        low, high = bounds[i], bounds[i + 1]
        if high - low >= WIDTH:
            out.append(np.unique(grams[low:high - WIDTH + 1]))
        elif high > low:
            short = (words[low:high] * _WEIGHTS[:high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(grams[:0])
    return out


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """Two digests of a set, whatever its order; signed, as Spark's longs are."""
    salted = mix(tokens ^ np.uint64(0xA0761D6478BD642F))
    a = int(mix(np.array([salted.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])
    b = int(mix(tokens ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).view(np.int64))
    return a, b


def signature(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(SIG, np.uint8)
    bits[(tokens >> np.uint64(32)) % np.uint64(SIG)] = 1
    return np.packbits(bits).view(np.int64)


def wide_bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap that grows with the set: two to four bits per token, a power of two in all."""
    size = max(1 << (2 * len(tokens)).bit_length(), 64)
    bits = np.zeros(size, np.uint8)
    bits[(tokens >> np.uint64(8)) % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """Largest overlap that two wide bitmaps allow; the longer one is folded to the shorter."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    common = int(np.bitwise_count(x & y).sum())
    # a bit of one set that the other lacks stands for a token outside the overlap
    return min(n_x - int(np.bitwise_count(x).sum()), n_y - int(np.bitwise_count(y).sum())) + common


def _select(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))


def _first_pass(df: DataFrame) -> DataFrame:
    """Rows (id, n, a, b, s0…) for documents; rows (slice, counts) for the sketch."""
    kind = df.schema["id"].dataType.simpleString()
    id_type = _arrow_type(df)

    def run(batches):
        counts, waiting, held = np.zeros(SKETCH, np.uint16), [], 0

        def add():
            if waiting:
                new = np.bincount(np.concatenate(waiting), minlength=SKETCH)
                counts[:] = np.minimum(counts + new, np.iinfo(np.uint16).max)
                waiting.clear()

        for batch in steps(batches, 1):
            sets = shingle_sets(batch, 1)
            n = batch.num_rows
            found = [digests(s) for s in sets]
            sigs = np.array([signature(s) for s in sets]).reshape(n, _WORDS)
            for s in sets:
                waiting.append((s % np.uint64(SKETCH)).astype(np.int64))
                held += len(s)
            if held >= SKETCH:
                add()
                held = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)),
                 *(pa.array(np.ascontiguousarray(sigs[:, i])) for i in range(_WORDS)), pa.array([wide_bitmap(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        add()
        parts = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(np.split(counts, SLICES)) if part.any()]
        if parts:
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3 + _WORDS)), pa.nulls(n, pa.binary()),
                                              pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names)

    names = ["id", "n", "a", "b", *_SIGS, "wide", "slice", "counts"]
    return map_arrow(df, run, f"id {kind}, n long, a long, b long, {', '.join(f'{s} long' for s in _SIGS)}, wide binary, slice int, counts binary")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)


def _levels(sketch: DataFrame) -> np.ndarray:
    """Level of each bucket of the sketch: 0, or how far it stands out, in powers of two.

    The sketch has ``SKETCH`` counters whatever the input, so it may come to the driver.
    """

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(x.as_py()), np.uint16).astype(np.int64)
                sums[i] = sums.get(i, 0) + part
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    counts = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for row in map_arrow(sketch.repartition("slice"), add, "slice int, counts binary").collect():
        counts[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    counts = counts.ravel()
    usual = float(np.median(counts))
    excess = counts - usual - 6 * np.sqrt(usual) - 16
    return np.where(excess > 0, np.log2(np.maximum(excess, 1)) + 1, 0).astype(np.uint8)


def prefix(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a set that any similar set shares one of, and which are frequent."""
    n = len(tokens)
    size = n - -(-NUM * n // DEN) + 1 if n else 0
    level = levels[(tokens % np.uint64(SKETCH)).astype(np.int64)]
    usual = tokens[level == 0]
    if len(usual) >= size:
        return usual[:size], np.zeros(size, bool)  # tokens are sorted by hash
    order = np.lexsort((tokens, level))[:size]
    return tokens[order], level[order] > 0


def _entries(df: DataFrame, levels) -> DataFrame:
    """(token, hot, a) for the prefix of each document; copies inside a step count once."""

    def run(batches):
        levels_here = levels.value
        for batch in steps(batches, 1):
            seen, columns = set(), ([], [], [])
            for tokens in shingle_sets(batch, 1):
                if not len(tokens) or (a := digests(tokens)[0]) in seen:
                    continue
                seen.add(a)
                head, hot = prefix(tokens, levels_here)
                columns[0].append(head.view(np.int64))
                columns[1].append(hot)
                columns[2].append(np.full(len(head), a, np.int64))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["token", "hot", "a"])

    return map_arrow(df, run, "token long, hot boolean, a long")


def _shared(entries: DataFrame) -> DataFrame:
    """Distinct entries (token, a) of tokens that are in several classes.

    A frequent token's entries are dealt over ``SALTS`` tasks, so a first look only drops
    rare tokens; the second has few entries left and counts each token as a whole.  Tokens
    with the same classes say the same, and one of them stays.
    """
    salt = F.when(F.col("hot"), F.pmod("a", F.lit(SALTS))).otherwise(0).cast("int")
    group = Window.partitionBy("token", "salt")
    several = F.min("a").over(group) != F.max("a").over(group)
    found = entries.withColumn("salt", salt).withColumn("several", several).where("several or hot")
    found = write(found.select("token", "a").distinct(), "entries")
    tokens = found.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a").cast("decimal(20,0)")).alias("s"))
    chosen = tokens.where("n > 1").groupBy("n", "s").agg(F.min("token").alias("token"))
    out = write(found.join(chosen.select("token"), "token", "left_semi"), "entries")
    drop(found)
    return out


def _excess(n: str, sig: list[Column]) -> Column:
    return F.col(n) - _bits(sig)


def _bits(words: list[Column]) -> Column:
    total = F.bit_count(words[0])
    for word in words[1:]:
        total = total + F.bit_count(word)
    return total


def _and(x: str, y: str) -> Column:
    return _bits([F.col(f"{x}{s}").bitwiseAND(F.col(f"{y}{s}")) for s in _SIGS])


def _needed(n: Column) -> Column:
    """Least overlap of two sets whose sizes sum to ``n``, times ``DEN + NUM``."""
    return n * NUM


def _may_match(x: str = "x_", y: str = "y_") -> Column:
    """Whether two sets with these sizes and bitmaps can be similar."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    sizes = (F.least(nx, ny) * DEN >= F.greatest(nx, ny) * NUM)
    common = _and(x, y)
    # a bit of one set that the other lacks stands for a token outside the overlap
    most = F.least(nx - F.col(f"{x}bits") + common, ny - F.col(f"{y}bits") + common)
    return sizes & (most * (DEN + NUM) >= _needed(nx + ny))


def _chains(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v): each entry v with the one before it, and with the first, of its group.

    u precedes v by size and digest.
    Groups are cut where a task's range ends; nothing depends on it, since trees come after.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, a = (batch.column(i).to_numpy() for i in (0, 1))
            if held is not None:
                token, a = np.append(held[0], token), np.append(held[1], a)
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            pivots = a[np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))]
            if held is not None:
                pivots[token == held[0][0]] = held[2]
            same = np.flatnonzero(~first)
            x, y = np.concatenate([a[same - 1], pivots[same]]), np.concatenate([a[same], a[same]])
            keep = x != y
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["u", "v"])
            held = (token[-1:], a[-1:], pivots[-1])

    sized = entries.join(classes.select("a", "n"), "a")
    ordered = sized.repartitionByRange("token", "n", "a").sortWithinPartitions("token", "n", "a").select("token", "a")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return labelled(pairs, labels).where("u_in <> v_in").drop("u_in", "v_in")


def _signed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps allow."""
    side = {p: classes.select(*[F.col(c).alias(f"{p}{c}") for c in classes.columns]) for p in ("x_", "y_")}
    both = pairs.join(side["x_"], F.col("u") == F.col("x_a")).join(side["y_"], F.col("v") == F.col("y_a"))
    return both.where(_may_match()).select("u", "v")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that wide bitmaps allow, with the share of overlap that these allow.

    What is shuffled is a thirtieth of whole sets.
    """

    def run(batches):
        for batch in batches:
            columns = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))
            sizes = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            most = np.array([most_shared(x, nx, y, ny) for x, nx, y, ny in columns], np.int64)
            keep = pa.array(most * (DEN + NUM) >= NUM * sizes)
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), pa.array(most / sizes))], ["u", "v", "score"])

    side = {p: classes.select(F.col("a").alias(u), F.col("wide").alias(f"{p}wide"), F.col("n").alias(f"{p}n")) for p, u in (("x", "u"), ("y", "v"))}
    both = pairs.join(side["x"], "u").join(side["y"], "v").select("u", "v", "xwide", "xn", "ywide", "yn")
    return map_arrow(both, run, "u long, v long, score double")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, tokens) of the classes in ``wanted`` (a, rep), read from one text of each."""

    def run(batches):
        for batch in steps(batches, 1):
            sets = shingle_sets(batch, 1)
            yield pa.RecordBatch.from_arrays([pa.array([digests(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["a", "tokens"])

    texts = docs.join(wanted.select("rep").distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    return map_arrow(texts, run, "a long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    both = pairs.join(sets.select(F.col("a").alias("v"), F.col("tokens").alias("y")), "v")
    both = both.join(sets.select(F.col("a").alias("u"), F.col("tokens").alias("x")), "u").select("u", "v", "x", "y")
    return map_arrow(both, run, "u long, v long")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the component of their class, of groups that hold several."""
    out = write(entries.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")), "labelled")
    mixed = out.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return out.join(mixed.select("token"), "token", "left_semi")


def _tree_pairs(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components that no bound rules out, by dual traversal."""
    # numbered while rows are narrow
    placed = number_within(entries.join(classes.select("a", "n"), "a"), ["token"], ["component", "n", "a"], "place")
    least = entries.groupBy("a").agg(F.slice(F.sort_array(F.collect_list("token")), 1, LEAST).alias("least"))
    placed = placed.select("token", "component", "a", F.floor((F.col("place") - 1) / LEAF).cast("long").alias("node"))
    placed = placed.join(classes.join(least, "a"), "a").withColumn("earlier", F.expr("filter(least, t -> t < token)")).drop("least")
    placed = write(placed, "leaves")
    bits = [F.bit_or(s).alias(s) for s in _SIGS]
    nodes = [write(placed.groupBy("token", "node").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("bits")).alias("excess"),
        F.min("component").alias("c_low"), F.max("component").alias("c_high"), *bits), "nodes")]
    while nodes[-1].agg(F.max("node")).first()[0]:
        up = nodes[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        nodes.append(write(up.groupBy("token", "node").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("excess").alias("excess"),
            F.min("c_low").alias("c_low"), F.max("c_high").alias("c_high"), *bits), "nodes"))

    def side(level: int, p: str) -> DataFrame:
        out = nodes[level].select(*[F.col(c).alias(f"{p}{c}") for c in nodes[level].columns])
        return out.withColumn(f"{p}up", F.floor(F.col(f"{p}node") / FAN).cast("long"))

    several = (F.col("x_c_low") != F.col("x_c_high")) | (F.col("y_c_low") != F.col("y_c_high")) | (F.col("x_c_low") != F.col("y_c_low"))
    sizes = (F.col("x_high") * DEN >= F.col("y_low") * NUM) & (F.col("y_high") * DEN >= F.col("x_low") * NUM)
    most = F.least(_and("x_", "y_") + F.least("x_excess", "y_excess"), "x_high", "y_high")
    possible = several & sizes & (most * (DEN + NUM) >= _needed(F.col("x_low") + F.col("y_low")))
    pairs = nodes[-1].select("token", F.col("node").alias("i"), F.col("node").alias("j"))
    for level in range(len(nodes) - 2, -1, -1):
        x, y = side(level, "x_"), side(level, "y_")
        below = pairs.join(x, (F.col("token") == F.col("x_token")) & (F.col("i") == F.col("x_up")))
        below = below.join(y, (F.col("token") == F.col("y_token")) & (F.col("j") == F.col("y_up")) & (F.col("x_node") <= F.col("y_node")) & possible)
        pairs, above = write(below.select("token", F.col("x_node").alias("i"), F.col("y_node").alias("j")), "node_pairs"), pairs
        drop(above)
    x, y = (placed.select(*[F.col(c).alias(f"{p}{c}") for c in placed.columns]) for p in ("x_", "y_"))
    found = pairs.join(x, (F.col("token") == F.col("x_token")) & (F.col("i") == F.col("x_node")))
    found = found.join(y, (F.col("token") == F.col("y_token")) & (F.col("j") == F.col("y_node")) & (F.col("x_component") != F.col("y_component"))
                       & ((F.col("i") != F.col("j")) | (F.col("x_a") < F.col("y_a"))) & _may_match() & ~F.arrays_overlap("x_earlier", "y_earlier"))
    out = write(found.select(F.least("x_a", "y_a").alias("u"), F.greatest("x_a", "y_a").alias("v")).distinct(), "pairs")
    drop(placed, pairs, *nodes)
    return out


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id of every row of ``df``."""
    spark = df.sparkSession
    texts = _select(df, key, text)
    first = write(_first_pass(texts), "sets")
    docs = first.where("slice is null").select("id", "n", "a", "b", *_SIGS, "wide")
    levels = spark.sparkContext.broadcast(_levels(first.where("slice is not null").select("slice", "counts")))
    entries = _shared(_entries(texts, levels))
    levels.unpersist()
    used = entries.select("a").distinct()
    known = docs.where("n > 0").join(used, "a").groupBy("a").agg(F.min("n").alias("n"), F.min("id").alias("rep"), F.min("wide").alias("wide"), *[F.min(s).alias(s) for s in _SIGS])
    known = write(known.withColumn("bits", _bits([F.col(s) for s in _SIGS]).cast("long")), "classes")
    classes = known.drop("rep", "wide")

    def similar(maybe: DataFrame) -> DataFrame:
        """Those of the screened pairs whose sets are similar, as a written table."""
        named = write(maybe.select(F.explode(F.array("u", "v")).alias("a")).distinct(), "named")
        sets = write(_sets(texts, known.join(named, "a").select("rep")), "tokens")
        out = write(_verified(maybe.select("u", "v"), sets.join(named, "a", "left_semi")), "links", merge=False)
        drop(sets, named)
        return out

    def resolved(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components after all similar pairs among ``pairs`` are linked."""
        open_, kept = write(_screened(pairs, known), "screened"), []
        for turn in range(ROUNDS + 1):
            if open_.isEmpty():
                break
            likely = F.max_by("u", F.struct("score", "u")).alias("u")
            now = write(open_.groupBy("v").agg(likely).select("u", "v"), "likely") if turn < ROUNDS else open_
            kept.append(similar(now))
            if turn == ROUNDS:
                break
            labels = joined(labels, kept[-1])
            rest = write(_between(open_.join(now, ["u", "v"], "left_anti"), labels), "screened")
            drop(open_, now)
            open_ = rest
            release(open_)
        drop(open_)
        for links in kept:
            labels = joined(labels, links, whole=True)
        drop(*kept)
        return labels

    labels = write(spark.createDataFrame([], "node long, component long"), "labels", merge=False)
    labels = resolved(labels, _signed(_chains(entries, classes), classes))
    apart = write(_labelled(entries, labels), "apart")
    if not apart.isEmpty():
        labels = resolved(labels, _tree_pairs(apart, classes))
    drop(apart, entries)
    release(labels)
    rows = docs.select("id", "n", "a").join(labels.withColumnRenamed("node", "a"), "a", "left")
    rows = rows.withColumn("component", F.coalesce("component", "a"))
    least = rows.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    rows = rows.join(least, "component", "left")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest key.

    A row without words is in no group and stays.  Rows that repeat a key stay or go
    together: they stay if one of them is the first of its group.
    """
    found = similar_groups(df, key, text).where(F.col(key).eqNullSafe(F.col("component_id")))
    stay = fresh(df, "stay")
    stays = found.select(F.col(key).alias(stay)).distinct()
    return df.join(stays, F.col(f"`{key}`").eqNullSafe(F.col(stay)), "left_semi")
