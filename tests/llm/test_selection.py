"""Importance resampling, chat formatting and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxalign.llm import chat_format, importance, ranked_search

DOCS = "doc_id long, text string, score long, rank string, row string, ID_ string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    some = [" ".join(rng.choices("the of Zebra été 12x a-b in_on straße NAÏVE w%d" .split() + [f"v{i}" for i in range(30)], k=rng.randint(0, 60))) for _ in range(120)]
    return [*some, *some[:10], None, "", " \n\t", "İstanbul ſ K", "x" * 70_000 + " the", "the " * 3000]


def rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x", "y", "z") for i, t in zip(ids, texts)], DOCS)


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, item long")


# -- importance resampling ------------------------------------------------------------------


def resampled(texts, target, n, size, percent, ids):
    def grams(text):
        w = words(text)
        return [" ".join(w[i:i + k]).encode() for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    raw, aim = (Counter(zlib.crc32(g) % size for t in x for g in grams(t)) for x in (texts, target))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + size) / ((raw[b] + 1.0) * (t_all + size)))) for b in range(size)]
    out = []
    for i, t in zip(ids, texts):
        g = [gain[zlib.crc32(x) % size] for x in grams(t)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, t in zip(out, texts) if len(words(t)) >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("n,percent", [(1, 10), (2, 55), (1, 100), (1, 0)])
def test_resample(spark, texts, n, percent):
    ids = [None if i == 50 else i for i in range(len(texts))]
    got = importance.resample(rows(spark, texts, ids), items(spark, texts[3:9] + [None]), longest=n, buckets=500, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == resampled(texts, texts[3:9], n, 500, percent, ids)


def test_resample_repeated_rows_and_empty_tables(spark, texts):
    df = rows(spark, [texts[0] + " the" * 30] * 400, [5] * 400)
    got = importance.resample(df, items(spark, [])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41)) and len({r.score for r in got}) == 1
    assert importance.resample(df.limit(0), items(spark, texts)).count() == 0


def test_kth_key(spark):
    rng = random.Random(1)
    values = [(rng.randint(0, 5), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(values, "score long, id long, row long")
    want = sorted(values, key=lambda v: (-v[0], v[1] is None, v[1] or 0, v[2]))
    for k in (1, 2, 250, 499, 500):
        assert tuple(importance.kth(df, k)) == want[k - 1]


# -- ranked search --------------------------------------------------------------------------


def searched(texts, queries, k, ids):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    n_all, l_all = sum(map(bool, split)), sum(map(len, split))
    tfs = [Counter(s) for s in split]
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, q in enumerate(queries):
        found = []
        for i, (c, s) in enumerate(zip(tfs, split)):
            m = 50 + 50 * len(s) * n_all // l_all if s else 0
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(q))) if c[t])
            if score > 0:
                found.append((ids[i], score))
        found.sort(key=lambda f: (-f[1], f[0] is None, f[0]))
        out += [(item, rank, i, score) for rank, (i, score) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search(spark, texts, k):
    queries = [*texts[:12], "nowhere", "", None, "v1 v1 V2", "the", "12x straße"]
    ids = [None if i == 50 else i for i in range(len(texts))]
    df = rows(spark, texts, ids).repartition(5)
    got = ranked_search.search(df, items(spark, queries), k=k).collect()
    assert sorted(map(tuple, got), key=str) == searched(texts, queries, k, ids)


def test_search_in_blocks_and_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 600)
    monkeypatch.setattr(ranked_search, "CHUNK", 40)
    queries = texts[:12]
    got = ranked_search.search(rows(spark, texts), items(spark, queries), k=3).collect()
    assert sorted(map(tuple, got), key=str) == searched(texts, queries, 3, range(len(texts)))


def test_search_repeated_rows_and_empty_tables(spark, texts):
    df = rows(spark, ["v1 v2"] * 80 + ["v3"] * 200, [3] * 280)
    got = ranked_search.search(df, spark.createDataFrame([(1, "v1")] * 2, "item_id long, text string")).collect()
    assert Counter(r["rank"] for r in got) == {i: 2 for i in range(1, 51)} and {r.doc_id for r in got} == {3}
    assert ranked_search.search(df.limit(0), items(spark, ["v1"])).count() == 0
    assert ranked_search.search(df, items(spark, [])).count() == 0


def test_no_accumulators_after_the_bound():
    rng = np.random.default_rng(1)
    n, k = 400, 5
    lists = {0: (np.arange(10), np.full(10, 900))} | {t: (np.sort(rng.choice(n, 300, replace=False)), rng.integers(1, 9, 300)) for t in range(1, 6)}
    query = [(t, 10) for t in range(6)]
    full = np.zeros(n, np.int64)
    for t, w in query:
        np.add.at(full, lists[t][0], w * lists[t][1])
    got = ranked_search.accumulate(query, lists, n, k, np.zeros(0, np.int64))
    assert np.count_nonzero(got) == 10 and np.array_equal(got[:10], full[:10])


# -- chat formatting ------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, id string, spans string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "[/INST", "<", "</s></s>", "\\", None, "", "é\n[INST]", "<</s>", "[[INST]]"]
    data = [(c, t, r, nasty[(c + t) % len(nasty)], "x", "y") for c in range(24) for t, r in enumerate(("system", "user", "assistant", None, "assistant", "[INST]"))]
    data += [(None, 1, "user", "a", "x", "y"), (None, None, "assistant", "first", "x", "y"), (7, 2, "assistant", nasty[9], "x", "y")]
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), CONVERSATIONS)
    turns = {}
    for c, t, r, x, *_ in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or 0, d[2] is not None, d[2] or "", d[3] is not None, d[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = {r.conv_id: r for r in chat_format.formatted(df).collect()}
    for r in chat_format.read_back(chat_format.formatted(df)).collect():
        own, loss = turns.pop(r.conv_id), "".join(x for role, x in turns_of(r.conv_id, made) if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert loss == "".join(x for role, x in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(made[r.conv_id].text))
    assert not turns
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


def turns_of(conv, made):
    return chat_format.turns_of(made[conv].text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(), st.lists(st.sampled_from([*chat_format.CONTROLS, "<", "[", "\\", "/", "s>", "INST]", "x"])).map("".join)), max_size=4))
def test_escaping_is_reversible(turns):
    text, _ = chat_format.compiled(chat_format.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat_format.turns_of(text) == turns
    assert not any(c in chat_format.escape(t) for _, t in turns for c in chat_format.CONTROLS)


@pytest.mark.parametrize("template,want", [
    ("a{# no #}{{ 'b' + \"c\\n\" }}{{ 1 + 2 }}", "abc\n3"),
    ("{% for m in xs %}{{ m }}{% if not loop.last %}, {% endif %}{% endfor %}.", "u, v."),
    ("{% if y.z == 3 and 'u' in xs or none %}yes{% elif true %}no{% endif %}", "yes"),
    ("{% if y.q %}1{% elif y['z'] > 4 %}2{% else %}3{% endif %}", "3"),
    ("{% set n = xs | length %}{{ n }}{{ xs[1] | upper }}{{ xs[9] }}{{ missing.deep }}", "2V"),
    ("{% if false %}x{% endif %}{% if 1 == 1 %}k{% else %}l{% endif %}m", "km"),
    ("  {%- if true -%}  t  {%- endif -%}  ", "t"),
    ("{{ xs.append }}", ""),
])
def test_template_language(template, want):
    assert chat_format.compiled(template)({"xs": ["u", "v"], "y": {"z": 3}})[0] == want


def test_constants_are_folded():
    tree = chat_format.fold_body(chat_format.parse("a{% if 1 < 2 %}{{ 'b' | upper }}{% endif %}{{ '<s>' | escape }}{% if false %}{{ x }}{% endif %}c"))
    assert tree == (chat_format.Text(chat_format.Const("aB<\\s>c")),)


@pytest.mark.parametrize("template", ["{% for x in y %}", "{{ x.__class__ }}", "{{ x() }}", "{{ x | open }}", "{% import os %}", "{{ 'a }}", "{% endif %}", "{{ }}"])
def test_faulty_and_forbidden_templates(template):
    with pytest.raises(chat_format.TemplateError):
        chat_format.compiled(template)


def test_generation_spans_nest():
    text, spans = chat_format.compiled("x{% generation %}a{% generation %}b{% endgeneration %}{% endgeneration %}{% generation %}{% endgeneration %}y")({})
    assert (text, spans) == ("xaby", [(1, 3)])
