"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language.  A word's
probability is the sum over all its segmentations into pieces, by a forward algorithm; a
text's is the product over its words, and the language with the highest one is predicted.
The score is that language's share when all languages are equally likely beforehand.

*Learning.*  Words are counted per language over all rows that may be learned from, inside
tasks first.  Rounds of expectation and maximisation then run over the table of distinct
words: tasks hold one expected count per language and piece, whatever the input.

Words are runs of letters with their marks, lower-cased, with the vocabulary's mark for a
word's begin in front.  Those longer than ``LONG`` characters are summed as a whole too, in
logarithms, as their probabilities leave the range of floats.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text when nothing can be learned from (``keep_identified`` then keeps all texts with a letter); equal scores give the language first by code point;
a null id counts as the text ``null`` for the split; repeated rows give a row each.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow, steps
from taxalign.llm.tables import drop, write
from taxalign.llm.words import mix

UNKNOWN = "und"
ROUNDS = 2
#: Longest word, mark included, whose sums are taken without logarithms.
LONG = 24
#: Probability of a character that the vocabulary lacks, and the count that every piece has beforehand.
RARE, PRIOR = 1e-9, 0.02
#: Words whose scores a worker remembers, and words that it counts before it passes counts on.
MEMO, COUNTED = 200_000, 200_000
#: Distinct words whose segmentations are summed at a time.
AT_ONCE = 30_000
MARK = "▁"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


_ASCII_WORD = re.compile("[a-z]+")


def words(text: str) -> list[str]:
    text = text.lower()
    return [MARK + w for w in (_ASCII_WORD if text.isascii() else _WORD).findall(text)]


class Vocabulary:
    """Pieces by the hash of their characters; ids begin at 2.

    Id 0 stands for no piece and 1 for an unknown character.
    """

    _BASE, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces) + 2
        self.keys = np.zeros((1 << self._SLOTS) + 64, np.uint64)
        self.ids = np.zeros(len(self.keys), np.int32)
        by_length: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(at)
        for n, places in by_length.items():
            codes = self.codes([pieces[i] for i in places])
            hashes = np.zeros(len(places), np.uint64)
            for j in range(n):
                hashes = self.longer(hashes, codes[:, j])
            for h, at in zip(mix(hashes), places):
                slot = int(h >> np.uint64(64 - self._SLOTS))
                while self.keys[slot]:
                    slot += 1
                self.keys[slot], self.ids[slot] = h, at + 2

    @staticmethod
    def codes(same_length: list[str]) -> np.ndarray:
        raw = "".join(same_length).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw, np.uint32).reshape(len(same_length), -1).astype(np.uint64)

    def longer(self, hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
        return hashes * self._BASE + code + np.uint64(1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        hashes = mix(hashes)
        slots = (hashes >> np.uint64(64 - self._SLOTS)).astype(np.int64)
        keys = self.keys[slots]
        out = np.where(keys == hashes, self.ids[slots], 0)
        open_ = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(open_):
            slots[open_] += 1
            keys = self.keys[slots[open_]]
            hit = keys == hashes[open_]
            out[open_[hit]] = self.ids[slots[open_[hit]]]
            open_ = open_[~hit & (keys != 0)]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return Vocabulary([sp.id_to_piece(i) for i in plain])


class Lattice:
    """All pieces inside words of one length."""

    def __init__(self, same_length: list[str], pieces: Vocabulary):
        codes = pieces.codes(same_length)
        self.n = codes.shape[1]
        self.spans = [(i, j) for j in range(1, self.n + 1) for i in range(max(0, j - pieces.longest), j)]
        place = {span: k for k, span in enumerate(self.spans)}
        found = np.zeros((len(self.spans), len(same_length)), np.int32)
        for i in range(self.n):
            hashes = np.zeros(len(same_length), np.uint64)
            for j in range(i + 1, min(self.n, i + pieces.longest) + 1):
                hashes = pieces.longer(hashes, codes[:, j - 1])
                found[place[i, j]] = pieces.find(hashes)
            single = found[place[i, i + 1]]
            single[single == 0] = 1
        self.ids = found  # a row per span

    def forward(self, p) -> list[np.ndarray]:
        """Summed probability of each prefix; ``p`` gives a span's probabilities by its place."""
        sums: list[np.ndarray] = [None] * (self.n + 1)
        sums[0] = np.ones_like(p(0))
        for k, (i, j) in enumerate(self.spans):
            step = sums[i] * p(k)
            sums[j] = step if sums[j] is None else sums[j] + step
        return sums

    def expected(self, p, weights: np.ndarray) -> list[np.ndarray]:
        """Expected use of each span over all segmentations, times the word's weight."""
        before = self.forward(p)
        after: list[np.ndarray] = [np.zeros_like(before[0]) for _ in range(self.n + 1)]
        after[self.n] = weights / before[self.n]
        out: list[np.ndarray] = [None] * len(self.spans)
        for k in range(len(self.spans) - 1, -1, -1):
            i, j = self.spans[k]
            step = p(k) * after[j]
            out[k] = before[i] * step
            after[i] = after[i] + step
        return out

    def log_forward(self, p) -> list[np.ndarray]:
        """Natural logarithms of ``forward``."""
        sums: list[np.ndarray] = [None] * (self.n + 1)
        sums[0] = np.zeros_like(p(0))
        with np.errstate(divide="ignore"):
            for k in self._used():
                i, j = self.spans[k]
                step = sums[i] + np.log(p(k))
                sums[j] = step if sums[j] is None else np.logaddexp(sums[j], step)
        return sums

    def _used(self) -> list[int]:
        return np.flatnonzero(self.ids.any(axis=1)).tolist()

    def log_sum(self, p) -> np.ndarray:
        """Natural logarithm of the words' probabilities."""
        return self.log_forward(p)[-1] if self.n > LONG else np.log(self.forward(p)[-1])

    def uses(self, p, weights: np.ndarray):
        """(place of a span, its expected use) by ``expected``, in logarithms for long words."""
        if self.n <= LONG:
            yield from enumerate(self.expected(p, weights))
            return
        before = self.log_forward(p)
        after: list[np.ndarray] = [None] * (self.n + 1)
        after[self.n] = -before[self.n]
        with np.errstate(divide="ignore"):
            for k in reversed(self._used()):
                i, j = self.spans[k]
                step = np.log(p(k)) + after[j]
                yield k, weights * np.exp(before[i] + step)
                after[i] = step if after[i] is None else np.logaddexp(after[i], step)


def lattices(distinct: list[str], pieces: Vocabulary, at_once: int = 4096):
    """(places in ``distinct``, lattice of those words), of one length each."""
    by_length: dict[int, list[int]] = {}
    for at, word in enumerate(distinct):
        by_length.setdefault(len(word), []).append(at)
    for length, places in by_length.items():
        step = max(1, at_once * LONG // max(length, LONG))
        for i in range(0, len(places), step):
            some = places[i:i + step]
            yield np.array(some), Lattice([distinct[x] for x in some], pieces)


def log_probabilities(distinct: list[str], pieces: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability, a column per language."""
    logs = np.zeros((len(distinct), table.shape[1]))
    for places, lattice in lattices(distinct, pieces):
        logs[places] = lattice.log_sum(lambda k: table[lattice.ids[k]])
    return logs


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))) % 4 == 2


def _counts(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows to learn from."""
    rows = df.where(~held_out(key) & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        held: dict[str, Counter] = {}
        more = 0  # what long words take, in words

        def out():
            for name, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in steps(batches, 1):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(value or "")
                held.setdefault(name, Counter()).update(found)
                if max(map(len, found), default=0) > LONG:
                    more += sum(len(w) for w in found if len(w) > LONG) // LONG
            if sum(map(len, held.values())) + more > COUNTED:
                yield from out()
                more = 0
        yield from out()

    return map_arrow(rows, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages, by code point, and the probability of each piece (row) in each (column).

    The result has one number per language and piece of the vocabulary, whatever the input.
    """
    spark = df.sparkSession
    counts = write(_counts(df, key, text, lang), "words")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_file)
    size = pieces.size
    table = np.full((size, len(names)), 1.0 / size)
    table[0], table[1] = 0.0, RARE
    for _ in range(rounds if names else 0):
        shared = spark.sparkContext.broadcast(table)

        def run(batches):
            now, order, found = shared.value, {x: i for i, x in enumerate(names)}, vocabulary(vocabulary_file)
            sums = np.zeros(now.size)
            held: list[pa.RecordBatch] = []

            def add():
                if not held:
                    return
                table = pa.Table.from_batches(held)
                held.clear()
                column = np.array([order[x] for x in table.column(0).to_pylist()])
                weights = table.column(2).to_numpy().astype(float)
                for places, lattice in lattices(table.column(1).to_pylist(), found):
                    of = column[places]
                    for k, use in lattice.uses(lambda k: now[lattice.ids[k], of], weights[places]):
                        np.add.at(sums, lattice.ids[k] * now.shape[1] + of, use)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(x.num_rows for x in held) >= AT_ONCE:
                    add()
            add()
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some])], ["cell", "n"])

        used = map_arrow(counts, run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        table = np.full(table.size, PRIOR)
        table[used.column("cell").to_numpy()] += used.column("n").to_numpy()
        table = table.reshape(size, len(names))
        table[:2] = 0.0
        table /= table.sum(axis=0)
        table[1] = RARE
    drop(counts)
    return names, table


class _Scorer:
    def __init__(self, names: list[str], table: np.ndarray, pieces: Vocabulary):
        self.names, self.table, self.pieces = names, table, pieces
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.logs = np.zeros((0, len(self.names)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [words(t or "") for t in texts]
        seen = set().union(*found)
        if len(self.at) > MEMO or self.letters > MEMO * LONG:
            self.forget()
        fresh = sorted(seen.difference(self.at))
        if fresh:
            self.letters += sum(map(len, fresh))
            self.logs = np.concatenate([self.logs, log_probabilities(fresh, self.pieces, self.table)])
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
        lang, score = [], np.zeros(len(texts))
        for i, some in enumerate(found):
            if not some or not self.names:
                lang.append(UNKNOWN)
                continue
            logs = self.logs[np.fromiter(map(self.at.__getitem__, some), np.int64, len(some))].sum(axis=0)
            best = int(np.argmax(logs))
            lang.append(self.names[best])
            score[i] = 1.0 / np.exp(logs - logs[best]).sum()
        return lang, score


_SCORERS: dict[str, _Scorer] = {}


def _scorer(model: str, names: list[str], table: np.ndarray, pieces: Vocabulary) -> _Scorer:
    """The scorer of a model; a worker keeps the words that it knows from task to task."""
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = _Scorer(names, table, pieces)
    return _SCORERS[model]


def _scored(df: DataFrame, vocabulary_file: str, key: str, text: str, lang: str, rounds: int, finish, schema) -> DataFrame:
    """Rows of ``df`` through ``finish(batch, languages, scores, whether any language was learned)``; its last column is the text."""
    names, table = learn(df, vocabulary_file, key, text, lang, rounds)
    shared = df.sparkSession.sparkContext.broadcast(table)
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*inner, held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    at, model = len(inner) + 1, uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(model, names, shared.value, vocabulary(vocabulary_file))
        for batch in steps(batches, at):
            yield finish(batch, *scorer.predict(batch.column(at).to_pylist()), bool(names))

    return map_arrow(rows, run, schema)


def languages(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> DataFrame:
    """``key``, held_out, lang_pred and score of every row of ``df``."""
    narrow = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, text, lang))])

    def finish(batch, names, scores, learned):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 2), pa.array(names, pa.string()), pa.array(scores)], ["key", "held_out", "lang_pred", "score"])

    schema = f"key {df.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return _scored(narrow, vocabulary_file, key, text, lang, rounds, finish, schema).withColumnRenamed("key", key)


def keep_identified(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``df`` whose text has a language; rows that are ``und`` go.

    If no language could be learned, only texts without a letter go.
    """
    n = len(df.columns)

    def finish(batch, names, scores, learned):
        if not learned:
            names = [MARK if words(x or "") else UNKNOWN for x in batch.column(batch.num_columns - 1).to_pylist()]
        keep = pa.array([x != UNKNOWN for x in names], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(n)], [f"c{i}" for i in range(n)])

    schema = ", ".join(f"c{i} {field.dataType.simpleString()}" for i, field in enumerate(df.schema))
    return _scored(df, vocabulary_file, key, text, lang, rounds, finish, schema).toDF(*df.columns)
