"""Token counts of whole texts under a public sentencepiece model.

A text longer than ``CHUNK`` characters is cut into overlapping chunks, which Spark deals
out, so no task encodes a huge document whole.  Each chunk is encoded with offsets and two
neighbours are spliced at a common boundary inside their overlap.

*Stable boundaries.*  Merges join adjacent characters into pieces of the vocabulary.  Where
no piece holds the characters ``a`` and ``b`` side by side, no token ever spans ``a|b`` and
what stands left of it has no say in how the right side is merged, nor the other way
round.  That proves the boundary from the vocabulary alone, whatever chunk shows it.

*Resynchronisation.*  Chunk ``i`` covers ``[c_i, c_(i+1) + overlap)``.  The splice is the
first stable boundary after ``c_(i+1)``; where the overlap holds none, it is doubled until
it does or the text ends.  Each chunk then counts the tokens between its two splices and
checks that a token begins at both; one that doesn't is an error, never a wrong count.

Texts up to ``CHUNK`` are one chunk.  Their tokens are counted between stable boundaries,
and a bounded memo keeps counts of stretches that were met before.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows and ids
give a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Counts of stretches that a worker remembers.
MEMO = 300_000
_JOINED = 1 << 13
_STRETCH = re.compile(" +[^ ]*")
SPACE = "▁"


class Model:
    """A sentencepiece model, its token lengths in bytes, and the pairs its pieces hold."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(len(pieces))]
        self.n_bytes = np.array([1 if self.sp.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)])
        self.pairs = {p[i:i + 2] for p, keep in zip(pieces, plain) if keep for i in range(len(p) - 1)}
        self.opens = np.array([keep and p.startswith(SPACE) for p, keep in zip(pieces, plain)])
        if any(x[1] == SPACE and x[0] != SPACE for x in self.pairs):
            raise ValueError("pieces of this model hold spaces inside; a space isn't a stable boundary")
        self.memo: dict[str, int] = {}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1] not in self.pairs

    def next_stable(self, text: str, after: int, before: int) -> int | None:
        """First stable boundary in ``(after, before]``, the text's end included."""
        for at in range(after + 1, min(before, len(text) - 1) + 1):
            if self.stable(text, at):
                return at
        return len(text) if before >= len(text) else None

    def learn(self, stretches: set[str]) -> None:
        """Count the tokens of stretches without spaces inside, many at a time."""
        if len(self.memo) + len(stretches) > MEMO:
            self.memo.clear()
        block, size = [], 0
        for word in stretches:
            block.append(word)
            size += len(word) + 1
            if size >= _JOINED:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.sp.encode(" ".join(words)), np.int64)
        begins = np.append(np.flatnonzero(self.opens[ids]), len(ids))
        self.memo.update(zip(words, np.diff(begins).tolist(), strict=True))

    def count_many(self, texts: list[str]) -> list[int]:
        plain: list[list[str]] = []
        rest: list[list[str]] = []
        for text in texts:
            text = text.replace(SPACE, " ")
            if not text:
                plain.append([])
                rest.append([])
            elif "  " in text or text[0] == " " or text[-1] == " ":
                runs = _STRETCH.findall(" " + text)
                plain.append([x[1:] for x in runs if len(x) > 1 and x[1] != " "])
                rest.append([x[1:] for x in runs if len(x) == 1 or x[1] == " "])
            else:
                plain.append(text.split(" "))
                rest.append([])
        fresh = set().union(*plain).difference(self.memo)
        if fresh:
            if len(self.memo) + len(fresh) > MEMO:
                fresh = set().union(*plain)
            self.learn(fresh)
        get = self.memo.__getitem__
        return [sum(map(get, p)) + sum(self._spaced(x) for x in r) for p, r in zip(plain, rest)]

    def _spaced(self, stretch: str) -> int:
        """Tokens of a stretch with several spaces at its front, the first one left out."""
        return len(self.sp.encode(stretch)) if stretch else 1


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def chunks(text: str, m: Model, size: int = CHUNK, overlap: int = OVERLAP):
    """Yield (index, chunk, splice into it, splice out of it), both in characters of the chunk."""
    text = text.replace(" ", SPACE)
    begin, splice, index = 0, 0, 0
    while True:
        edge = begin + size
        if edge >= len(text):
            yield index, text[begin:], splice - begin, len(text) - begin
            return
        wide, out = overlap, None
        while (out := m.next_stable(text, edge, edge + wide)) is None:
            wide *= 2  # no proven boundary in the overlap
        yield index, text[begin:max(out, min(edge + wide, len(text)))], splice - begin, out - begin
        if out >= len(text):
            return
        begin, splice, index = edge, out, index + 1
        if splice >= begin + size:  # the overlap outgrew a chunk
            begin = splice - 1


def count_between(chunk: str, splice_in: int, splice_out: int, m: Model) -> int:
    """Tokens of ``chunk`` between two splices; offsets of the encoding prove both."""
    ids = np.array(m.sp.encode(chunk), np.int64)
    front = len(SPACE.encode())  # the space that the library puts before a text
    begins = np.concatenate([[0], np.cumsum(m.n_bytes[ids])])
    low = len(chunk[:splice_in].encode()) + front if splice_in else 0
    high = len(chunk[:splice_out].encode()) + front
    a, b = np.searchsorted(begins, [low, high])
    if begins[a] != low or begins[b] != high:
        raise ValueError("chunks of a text could not be aligned")
    return int(b - a)


def token_counts(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of each row's whole text."""
    kind = df.schema[key].dataType.simpleString()
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), value.alias("value"))

    def short(batches):
        m = model(model_file)
        for batch in batches:
            n = m.count_many(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    def cut(batches):
        m = model(model_file)
        for batch in batches:
            for row in range(batch.num_rows):
                parts = list(chunks(batch.column(3)[row].as_py(), m, chunk, overlap))
                same = pa.array([row] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), batch.column(2).take(same)]
                    + [pa.array(c, t) for c, t in zip(zip(*parts), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "row", "n_bytes", "part", "chunk", "splice_in", "splice_out"])

    def encode(batches):
        m = model(model_file)
        for batch in batches:
            n = [count_between(*x, m) for x in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64())], ["key", "row", "n_bytes", "n_tokens"])

    size = F.octet_length("value").cast("long")
    is_long = F.char_length("value") > chunk
    whole = map_arrow(rows.where(~is_long).select("key", size.alias("n_bytes"), "value"), short, f"key {kind}, n_bytes long, n_tokens long")
    # a row's number ties its chunks together: keys may repeat
    pieces = map_arrow(rows.where(is_long).select("key", F.monotonically_increasing_id().alias("row"), size.alias("n_bytes"), "value"), cut,
                       f"key {kind}, row long, n_bytes long, part long, chunk string, splice_in long, splice_out long")
    dealt = pieces.repartition(F.xxhash64("row", "part")).select("key", "row", "n_bytes", "chunk", "splice_in", "splice_out")
    counted = map_arrow(dealt, encode, f"key {kind}, row long, n_bytes long, n_tokens long")
    spliced = counted.groupBy("key", "row", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens")).drop("row")
    return whole.unionByName(spliced).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
