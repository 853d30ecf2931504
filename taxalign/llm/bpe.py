"""Byte-level BPE encoding and decoding by a local rank file.

The tiktoken library encodes; Spark deals the texts out.  A long text is first cut by a
regular expression at safe boundaries and its parts are encoded one after the other, so
that the library never matches its pattern over more than about ``LONG`` characters at
once.  A boundary between a character that isn't white space and a following space is
safe: every match of the pattern has white space only at its front or throughout, no
match begins with what precedes, and the pattern looks ahead only past white space.

Decoding joins the raw bytes of the ids; the result is exact for texts of any script.

Defined results: a null or empty text has no ids, no bytes.  Repeated rows and repeated
ids give a row each.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow

#: Characters of a text that are encoded at once, about.
LONG = 1 << 15

_SAFE = re.compile(r"(?<=[^\s])(?= )")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of about ``size`` characters.

    Where no safe boundary follows, the part goes on to the next one, or to the end.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc: tiktoken.Encoding, size: int = LONG) -> list[int]:
    text = text or ""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text, size):
        ids += enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids)


def encoded(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of each text, an array of int."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode(t, enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return map_arrow(_columns(df, key, text), run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decoded(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the raw bytes that the ids stand for; null ids count as none."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [decode(x or [], enc) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["key", "bytes"])

    return map_arrow(_columns(df, key, ids), run, f"key {df.schema[key].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return digests of both.

    Columns: ``key``, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes).
    """

    def run(batches):
        enc = encoding(rank_file, pattern)
        decimal = [b"%d" % i for i in range(enc.n_vocab)]
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for value in batch.column(1):  # one text's ids at a time
                ids = encode(value.as_py(), enc)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(_columns(df, key, text), run, schema).withColumnRenamed("key", key)


def _columns(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
