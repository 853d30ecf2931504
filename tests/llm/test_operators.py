"""The corpus operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
from decimal import Decimal
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from taxalign.llm import bpe, embedding_dedup, exact_dedup, html_text, language_id, mixing, ngram_join, quality, sharding, token_counts
from taxalign.llm.components import joined, labelled
from taxalign.llm.tables import write

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string"


def documents(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdeforst", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(6)]
    near = [" ".join(w if i != 30 else "changed" for i, w in enumerate(b.split())) for b in base for _ in range(3)]
    long = sentence(rng, 12_000)
    return [*base, *near, *base[:2], base[0].replace(" ", " \n\t"), None, "", "   ", "one two", "one two", "One  TWO", long, long + " end", "12 34 !?"]


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def closed(n, links):
    label = list(range(n))
    while True:
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_ngram_join(spark, texts):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {(i, len(s), c) for i, (s, c) in enumerate(zip(sets, closed(len(sets), links)))}
    assert {tuple(r) for r in ngram_join.similar_groups(documents(spark, texts)).collect()} == want


def test_ngram_join_where_near_copies_differ_much(spark):
    rng = random.Random(8)
    words = sentence(rng, 70).split()
    some = [" ".join(f"x{rng.randrange(99)}" if rng.random() < rate else w for w in words) for rate in (0.01, 0.03, 0.05) for _ in range(30)]
    test_ngram_join(spark, some)


def test_wide_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n, m in ((5, 6), (100, 130), (1000, 1200)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m, dtype=np.uint64)]))
        most = ngram_join.most_shared(ngram_join.wide_bitmap(x), len(x), ngram_join.wide_bitmap(y), len(y))
        assert most >= len(np.intersect1d(x, y))


def test_exact_dedup(spark, texts):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    want = {(i, norm.index(t), norm.count(t), norm.index(t) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    assert {tuple(r) for r in exact_dedup.exact_groups(documents(spark, texts)).collect()} == want
    assert exact_dedup.drop_copies(documents(spark, texts)).count() == len(set(norm))


def test_tokenizers_agree_with_their_libraries(spark, texts):
    model = token_counts.model(MODEL).sp
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, texts), MODEL).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(ranks, public_tokenizers.PATTERN)
    for r in bpe.round_trip(documents(spark, texts), ranks, public_tokenizers.PATTERN).collect():
        raw = (texts[r.doc_id] or "").encode()
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_mixing_comes_near_its_targets(spark, texts):
    rows = mixing.mix(documents(spark, texts * 5)).collect()
    assert len(rows) == 5 * len(texts) and all(r.taken <= 2 * r.size for r in rows)


def test_language_id(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(("the and that with of" if i % 2 else "der und nicht eine über").split(), k=9)), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !", None), (103, "the with that", None), (None, "nicht über", None), (104, "und" * 500, "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.languages(df, MODEL).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 80)
    kept = language_id.keep_identified(df, MODEL)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert language_id.languages(df.limit(0), MODEL).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.Vocabulary(["a", "b", "ab", "ba", "aba"])
    p = np.random.default_rng(2).random((pieces.size, 1))
    p[0] = 0

    def brute(word):
        if not word:
            return 1.0
        at = {"a": 2, "b": 3, "ab": 4, "ba": 5, "aba": 6}
        return sum(p[at.get(word[:n], 1 if n == 1 else 0), 0] * brute(word[n:]) for n in range(1, len(word) + 1))

    words = ["ababa", "bacab", "a"]
    assert np.allclose(np.exp(language_id.log_probabilities(words, pieces, p))[:, 0], [brute(w) for w in words])


def test_long_words_are_summed_as_a_whole():
    rng = random.Random(3)
    pieces = language_id.Vocabulary(["a", "b", "ab", "ba", "aba"])
    p = np.random.default_rng(2).random((pieces.size, 2)) * 1e-3
    p[0] = 0
    at = {"a": 2, "b": 3, "ab": 4, "ba": 5, "aba": 6}
    words = ["".join(rng.choices("abc", k=n)) for n in (23, 24, 25, 30, 30, 400)]

    def brute(word, column):
        sums = [Fraction(1)]
        for j in range(1, len(word) + 1):
            sums.append(sum(sums[i] * Fraction(float(p[at.get(word[i:j], 1 if j - i == 1 else 0), column])) for i in range(max(0, j - 3), j)))
        return float(Decimal(sums[-1].numerator).ln() - Decimal(sums[-1].denominator).ln())

    want = [[brute(w, c) for c in (0, 1)] for w in words]
    assert np.allclose(language_id.log_probabilities(words, pieces, p), want)
    # expected uses: in logarithms as without, and each character used once
    word = [words[3]]
    lattice = language_id.Lattice(word, pieces)
    of = lambda k: p[lattice.ids[k], 0] * 1e3
    plain, logs = lattice.expected(of, np.array([2.0])), dict(lattice.uses(of, np.array([2.0])))
    assert all(np.allclose(use, logs.get(k, 0.0)) for k, use in enumerate(plain))
    lattice = language_id.Lattice(words[-1:], pieces)
    used = sum(use[0] * (lattice.spans[k][1] - lattice.spans[k][0]) for k, use in lattice.uses(lambda k: p[lattice.ids[k], 0], np.array([1.0])))
    assert abs(used - 400) < 1e-6


def test_all_texts_with_letters_stay_if_no_language_is_known(spark):
    df = spark.createDataFrame([(0, "the with", None), (1, None, None), (2, "12 !", None), (3, "und", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_identified(df, MODEL).collect()) == [0, 3]
    assert {r.lang_pred for r in language_id.languages(df, MODEL).collect()} == {"und"}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    vectors = [v.tolist() for v in np.concatenate([base, base[:10] + 0.1 * rng.standard_normal((10, 16)), base[:3], 2 * base[:2]])]
    # tiny and huge ones have a direction too
    vectors += [(v * 1e-200).tolist() for v in base[:2]] + [(v * 1e200).tolist() for v in base[1:3]]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    unit = np.array([np.array(v) / np.abs(v).max() for v in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = closed(len(vectors), list(zip(*np.nonzero(near))))
    want = {(i, int(near[i].sum()), label[i], label[i] == i) for i in range(len(vectors))}
    want |= {(i, 0, i, True) for i in range(len(vectors), len(vectors) + len(bad))}
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors + bad)], "vec_id long, embedding array<double>, label int, class string")
    assert {tuple(r) for r in embedding_dedup.near_copies(df).collect()} == want


def test_html_text(spark):
    pages = [f'<nav><ul><li><a href="#">Home {i}</a></li></ul></nav><div class="ad">Buy now {i}.</div><article><h1>Title {i}</h1><p>Some <b>bold</b>\n text, '
             f'number {i} &amp; more words of it.<p>Second part, which goes on.</article><footer>&copy; {i}</footer><script>x("</p>")</script>' for i in range(30)]
    df = spark.createDataFrame([(i, f"u{i}", p, 1) for i, p in enumerate([*pages, None, "", "<p>open <div"])], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert all(got[i].text == f"Title {i} Some bold text, number {i} & more words of it. Second part, which goes on." for i in range(30))
    assert (got[30].text, got[31].text, got[30].n_chars) == ("", "", 0)
    assert html_text.extract(df.limit(0)).count() == 0


def unnamed_page(rng, i):
    """A page in plain div elements with arbitrary class names, the title of its article, and the rest."""
    names = iter("".join(rng.choices("qwxzkjvb", k=3)) for _ in range(20))
    article = [sentence(rng, 7).capitalize(), *(". ".join(sentence(rng, rng.randint(6, 16)).capitalize() for _ in range(rng.randint(2, 6))) + "." for _ in range(rng.randint(3, 8)))]
    box = lambda inner: f'<div class="{next(names)}">{inner}</div>'
    body = box(f"<h1>{article[0]}</h1>" + "".join(f"<p>{x}</p>" for x in article[1:]))
    said = "".join(box(f"<b>{sentence(rng, 1)}</b><p>Comment {sentence(rng, 12)}.</p>") for _ in range(rng.randint(2, 5)))
    comments = box(f"<h3>{sentence(rng, 2)}</h3>{said}")
    side = box(f"<h4>{sentence(rng, 1)}</h4><p>Beside {sentence(rng, 9)}.</p><ul>" + "".join(f'<li><a href="#">{sentence(rng, 3)}</a></li>' for _ in range(5)) + "</ul>")
    menu = box("".join(f'<a href="#">{sentence(rng, 1)}</a> ' for _ in range(6)))
    foot = box(f"<p>&copy; {sentence(rng, 5)}</p>")
    middle = box(body + (comments if i % 3 else "")) + (side if i % 2 else "")
    return f"<html><body>{menu}{middle}{'' if i % 3 else comments}{foot}</body></html>", article[0], " ".join(article[1:])


def test_html_where_nothing_is_named(spark):
    """Trees learned from named pages tell the parts of others by structure."""
    rng = random.Random(12)
    named = [f'<nav><ul><li><a href="#">Home {i}</a></li></ul></nav><div class="ad">{sentence(rng, 6)}</div><article><h1>{sentence(rng, 5)}</h1>'
             + "".join(f"<p>{sentence(rng, rng.randint(20, 60))}. {sentence(rng, 15)}.</p>" for _ in range(5)) + f"</article><footer>&copy; {sentence(rng, 4)}</footer>" for i in range(60)]
    others = [unnamed_page(rng, i) for i in range(30)]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(named)], "page_id long, url string, html string")
    got = html_text.main_texts([page for page, *_ in others], html_text.learn(df))
    # all paragraphs and no other part; a title may be taken for that of another part
    assert all(text in (f"{title} {rest}", rest) for text, (_, title, rest) in zip(got, others))
    assert sum(text != rest for text, (*_, rest) in zip(got, others)) >= 15


def test_html_inline_nodes_and_text_in_body(spark):
    rng = random.Random(9)
    pages = [f'<a href="#">Skip to text</a> <a href="#">Home {i}</a><hr><article><h1>Title {i}</h1><p>{sentence(rng, 20)} with <span class="term">bold</span>er words. '
             f'<span class="advert">Buy now</span></p><p>{sentence(rng, 20)} <a href="#" class="link">more</a>.</p></article><a href="#">Imprint</a>' for i in range(30)]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate([*pages, "Text alone, & no tag."])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(30):
        assert got[i].startswith(f"Title {i} ") and got[i].endswith(" more.") and " bolder words." in got[i]
        assert not any(x in got[i] for x in ("Skip", "Home", "Buy", "Imprint"))
    assert got[30] == "Text alone, & no tag."
    nodes = html_text.parse('one <b>two</b><br>three<div>x</div> <a id="skip">four</a>')
    assert [(n.tag, n.own) for n in nodes] == [("body", 0), (html_text.RUN, 11), ("div", 1), (html_text.RUN, 0), ("a", 4)]


def test_html_sample_counts_different_pages(spark):
    pages = [f"<p>{i}</p>" for i in range(40)]
    df = spark.createDataFrame([(p,) for p in pages for _ in range(50)], "html string")
    want = sorted((hashlib.md5(p.encode()).hexdigest(), p) for p in pages)[:30]
    assert sorted((r.h, r.html) for r in html_text.sampled(df, 30).collect()) == want


def test_html_below_300_open_elements():
    page = "<article>" + "<div>x " * 300 + "<p>deep text</p><script>var hidden = 1;</script><nav><a>Menu</a></nav><p>last</p>"
    nodes = html_text.parse(page)
    assert max(n.depth for n in nodes) == 302
    assert [n.tag for n in nodes if n.depth == 302] == ["p", "script", "nav", "p"]
    assert html_text.main_text(page, None) == "x " * 300 + "deep text Menu last"
    keep = html_text.decode(nodes, np.array([-1.0 if n.tag == "nav" else 1.0 for n in nodes]))
    assert [n.tag for n, k in zip(nodes, keep) if not k] == ["script", "nav"]
    html_text.main_text("<div>a</p>" * 20_000 + "b", None)  # stray end tags are not searched for


def test_no_kept_node_below_a_dropped_one():
    nodes = html_text.parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    keep = html_text.decode(nodes, np.array([0, -1, 3, -1, -5, 2.0]))
    assert keep == [True, True, True, False, False, False]


def test_ngram_join_of_long_sets(spark):
    """Sets of 3,000 shingles, whose bitmaps have far more bits than a signature."""
    rng = random.Random(4)
    base = sentence(rng, 3004).split()
    some = [" ".join(f"x{rng.randrange(9999)}" if rng.random() < rate else w for w in base) for rate in (0.0, 0.01, 0.02, 0.03, 0.06) for _ in range(6)]
    test_ngram_join(spark, some)


def test_mixing_against_brute_force(spark, texts):
    """Targets by water filling; the words taken come as near as whole rows allow."""
    rows = documents(spark, texts * 5)
    got = mixing.mix(rows).collect()
    data = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))) for r in rows.collect()]
    sums = {}
    for _, source, n in data:
        sums[source] = sums.get(source, 0) + n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(3, 2) * sum(sums.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sums[s]}
        if not full:
            target |= share
            break
        target |= {s: Fraction(2 * sums[s]) for s in full}
        left -= sum(2 * sums[s] for s in full)
        open_ -= full
    source_of, size_of = {i: s for i, s, _ in data}, {i: n for i, _, n in data}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size_of[r.doc_id], sums[s]) and abs(r.target - float(target[s])) < 1e-6
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        largest = max(size_of[i] for i in source_of if source_of[i] == s)
        assert abs(n - target[s]) <= largest / 2 + 1


def test_sharding_against_brute_force(spark, texts, tmp_path):
    """Small limits: a shard is the shortest run of leading bits whose rows fit."""
    df = documents(spark, texts * 4).withColumn("shard", F.lit("mine"))
    data = {r.doc_id: len((r.text or "").encode()) for r in df.collect()}
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i in data}
    for limit in (100_000, 700):
        got = {r.doc_id: r for r in sharding.shards(df, limit=limit).collect()}
        for i, r in got.items():
            for depth in range(r.depth + 1):
                inside = [j for j in data if bits[j].startswith(bits[i][:depth])]
                fits = sum(data[j] for j in inside) <= limit or len(inside) == 1
                assert fits == (depth == r.depth)
            assert (r.shard, r.shard_bytes, r.shard_rows, r.n_bytes) == (bits[i][:r.depth], sum(data[j] for j in inside), len(inside), data[i])
    repeated = spark.createDataFrame([(1, "a" * 400), (1, "a" * 400), (1, "b"), (None, "c"), (2, None)], "doc_id long, text string")
    placed = sharding.write_shards(repeated, str(tmp_path / "s"), limit=500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, repeated.collect())) and placed.count() == 5
    assert all(r.b <= 500 for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect())


def test_clashing_names(spark, texts):
    """Columns named like those that the operators add."""
    df = documents(spark, texts[:8]).withColumns({n: F.lit(1) for n in ("_stay_id", "_stay", "stay", "_mix_full", "mix_full", "bytes", "row", "whole", "rest", "group", "component", "node")})
    for keep in (exact_dedup.drop_copies, ngram_join.drop_near_copies, mixing.mixed_rows):
        assert keep(df).columns == df.columns


def test_empty_tables(spark):
    df = documents(spark, ["x"]).limit(0)
    assert all(f(df).count() == 0 for f in (exact_dedup.exact_groups, exact_dedup.drop_copies, ngram_join.similar_groups, ngram_join.drop_near_copies,
                                            mixing.mix, mixing.mixed_rows, sharding.shards))
    assert token_counts.token_counts(df, MODEL).count() == 0
    assert bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_copies(empty).count() == 0


def test_quality_gradient_is_that_of_the_likelihood():
    """Finite differences of the cumulative-link likelihood, for values and thresholds."""
    rng = np.random.default_rng(3)
    f, y, t = rng.normal(size=7), np.array([0, 1, 2, 3, 3, 1, 0]), np.array([-0.7, 0.1, -0.4])

    def loss(f, t):
        upto = np.concatenate([np.zeros((len(f), 1)), 1 - quality.above(f, t), np.ones((len(f), 1))], axis=1)
        return -np.log(upto[np.arange(len(f)), y + 1] - upto[np.arange(len(f)), y]).sum()

    by_f, by_t = quality.gradient(f, y, t)
    for i in range(len(f)):
        step = np.eye(len(f))[i] * 1e-6
        assert abs((loss(f + step, t) - loss(f - step, t)) / 2e-6 - by_f[i]) < 1e-5
    for i in range(len(t)):
        step = np.eye(len(t))[i] * 1e-6
        assert abs((loss(f, t + step) - loss(f, t - step)) / 2e-6 - by_t[i]) < 1e-5


def test_quality_against_descent_over_all_rows(spark):
    """On rows that were not rated, the likelihood is about that of full-batch descent from scratch, or better."""
    import pyarrow as pa

    rng = random.Random(8)
    tell = ("bad awful", "so plain", "fine great")
    rows = [(i, f"{sentence(rng, 4)} {tell[i % 3] if rng.random() < 0.9 else tell[(i + 1) % 3]}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    w, t = quality.learn(df, spark.createDataFrame([(i, i % 3) for i in range(200)], "doc_id long, grade int"), 3)
    begins, cells, values = quality.features(pa.RecordBatch.from_arrays([pa.array([x for _, x in rows])], ["text"]), 0)
    used, at = np.unique(cells, return_inverse=True)
    owner, y = np.repeat(np.arange(len(rows)), np.diff(begins)), np.arange(300) % 3

    def held_out(weights, params):
        f = np.bincount(owner, weights[at] * values, len(rows))
        upto = np.concatenate([np.zeros((len(f), 1)), 1 - quality.above(f, params), np.ones((len(f), 1))], axis=1)
        return -np.log(np.maximum(upto[np.arange(300), y + 1] - upto[np.arange(300), y], 1e-12))[200:].mean()

    best_w, best_t, rated = np.zeros(len(used)), np.array([-0.7, 0.3]), np.arange(300) < 200
    nothing = held_out(best_w, best_t)
    for _ in range(300):
        by_f, by_t = quality.gradient(np.bincount(owner, best_w[at] * values, len(rows))[rated], y[rated], best_t)
        whole = np.concatenate([by_f, np.zeros(100)])
        best_w -= np.bincount(at, whole[owner] * values, len(used)) / 200
        best_t -= 0.5 * by_t / 200
    assert held_out(w[used], t) < 1.25 * held_out(best_w, best_t) < nothing


def test_small_labels_may_be_broadcast(spark, capsys):
    """Components are joined in many turns over few rows, which need no shuffle each."""
    labels = write(spark.createDataFrame([(5, 4)], "node long, component long"), "labels", merge=False)
    links = write(spark.createDataFrame([(5, 6), (6, 1), (8, 9)], "u long, v long"), "links", merge=False)
    out = joined(labels, links, whole=True)
    spark.range(10).withColumnRenamed("id", "node").join(out, "node").explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    near = {(r.u, r.v): (r.u_in, r.v_in) for r in labelled(links, out).collect()}
    assert near == {(5, 6): (1, 1), (6, 1): (1, 1), (8, 9): (8, 8)}


def test_quality(spark):
    rng = random.Random(6)
    tell = ("bad awful", "so plain", "fine great")
    rows = [(i, f"{sentence(rng, 8)} {tell[i % 3]} {sentence(rng, 8)}") for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    rated = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 1), (201, None)], "doc_id long, grade int")
    got = {r.doc_id: r for r in quality.graded(df, rated, 3).collect()}
    held = [got[i] for i in range(200, 300)]
    assert np.mean([r.kept == (r.doc_id % 3 == 2) for r in held]) > 0.9
    assert 0 <= got[900].tail_prob <= got[900].expected_grade <= 2 and got[900].tail_prob == got[901].tail_prob
    assert quality.graded(df.limit(0), rated, 3).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").where(F.lit(True))
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3, 4, 5, texts.index("one two"), len(texts) - 3]
