"""Near-duplicates, search and the two trained models, against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brickyard.llm import classifier, labelled, setsketch, topk, toxicity
from brickyard.llm.vectext import buffers, byte_slices, shingles

SF = "/root/testdata/sf0.01"


def _sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def _classes(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def _near_rows(seed=3, groups=12, size=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        for _ in range(size if g == 0 else rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5, 9))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(own).title() if rng.random() < 0.3 else " ".join(own)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  two\n"), (2005, "one"), (2006, " ".join(vocabulary * 3))]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    for name, value in (("SMALL_BUCKET", 8), ("SKETCH_BLOCK", 8), ("TEXT_BLOCK", 8)):
        monkeypatch.setattr(setsketch, name, value)
    rows = _near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))
    got = setsketch.near_duplicates(docs).collect()
    sets = _sets(rows)
    want = _classes({d: s for d, s in sets.items()})
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_that_only_their_original_links(spark, monkeypatch):
    for name, value in (("SMALL_BUCKET", 4), ("SKETCH_BLOCK", 16), ("TEXT_BLOCK", 16)):
        monkeypatch.setattr(setsketch, name, value)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for d in range(60):
        own = list(base)
        for at in rng.sample(range(0, 120, 6), 2 if d % 4 else 6):
            own[at] = f"x{d}at{at}"
        rows.append((d, " ".join(own)))
    sets = _sets(rows)
    want = _classes(sets)
    assert len(set(want.values())) > 5 and max(Counter(want.values()).values()) > 30
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_shingles_of_long_texts_are_made_part_by_part():
    texts = ["a b c " * 500 + "x" * 3000 + " " + "y" * 5000 + "  end", "w" * 9000, "p q r s t u v " * 300 + " " * 3000 + "zz " + "k" * 900, " " * 5000, "ab " * 2 + "q" * 4000, "", "one"]
    for column in [pa.array([t]) for t in texts] + [pa.array(texts)]:
        whole, parts = shingles(*buffers(column)), shingles(*buffers(column), most=256)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in setsketch.near_duplicates(docs).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("9", "9", True), ("None", "5", False), ("None", "None", False), ("None", "None", False)]
    left = sorted(str(r) for r in setsketch.drop_near_duplicates(docs).collect())
    assert left == sorted(str(r) for r in docs.filter("doc_id = 9 OR doc_id IS NULL AND (text IS NULL OR text LIKE 'q%')").collect() + docs.filter("doc_id = 5").limit(1).collect())
    assert setsketch.near_duplicates(docs.filter("false")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b, both = items[:2000], items[500:2500], items[:2500]
    regs = setsketch.registers(np.concatenate([a, b, both]), np.array([0, 2000, 4000, 6500]))
    assert (setsketch.merged(regs[0], regs[1]) == regs[2]).all()
    n = np.array([2000.0])
    true = 1500 / 2500
    assert setsketch.may_reach(regs[:1], regs[1:2], n, n, true - 0.15)[0, 0]
    assert not setsketch.may_reach(regs[:1], regs[1:2], n, n, true + 0.15)[0, 0]


def test_exact_links_of_sets():
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3], [9])]
    hit = setsketch.linked(sets, 75)
    assert {(i, j) for i, j in zip(*np.nonzero(hit)) if i < j} == {(0, 1), (0, 3), (2, 4)}


def test_shingles_are_distinct_words():
    items, bounds = shingles(*buffers(pa.array(["A b c d e A B C D E", "x", "", None, "\x0b\x0ca"])))
    assert np.diff(bounds).tolist() == [5, 1, 0, 0, 1]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (700, 8)) / 16.0
    x[300:500] = x[300]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [1.0, 2.0]), (904, [3.0, 4.0]), (905, []), (5, x[5].tolist()), (5, x[5].tolist())]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = vectors.filter("vec_id % 50 = 0 OR vec_id IN (903, 301)")
    got = {}
    for r in topk.top_k(vectors, asked, k=5, shard_rows=100, block_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v is not None and len(v) in (2, 8) and None not in v and not np.isnan(v).any()]
    for q in [*range(0, 700, 50), 903, 301]:
        own = dict(whole)[q]
        scored = sorted((-int(own @ v), i) for i, v in whole if i != q and len(v) == len(own))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def test_top_k_of_huge_components_and_empty_tables(spark):
    vectors = topk.quantised(spark.createDataFrame([(1, [1e15, 1.0]), (2, [1e15, 2.0]), (3, [-1e15, 0.0])], "vec_id long, embedding array<double>"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(vectors, vectors.filter("vec_id = 1"), k=2).collect()]
    assert sorted(got) == [(1, 1, 2), (1, 2, 3)]
    assert topk.top_k(vectors.filter("false"), vectors.filter("false")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def _auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("label", "fit", "least"), [("quality", classifier.fit, 0.97), ("toxic", toxicity.fit, 0.85)])
def test_models_on_held_out_labels(corpus, label, fit, least):
    docs, labels = corpus
    held = labelled.remainder(F.col("doc_id"), 3) == 1
    table = labelled.sample(docs, labels, label, ~held, most=2000)
    model = fit(table.column("text").combine_chunks(), table.column("y").to_numpy())
    rows = classifier.score(docs.join(labels.filter(held), "doc_id").select("doc_id", "text", label), model.scores).toPandas()
    assert _auc(rows.score.to_numpy(), rows[label].to_numpy()) >= least
    assert rows.score.between(0, 1).all()


def test_scoring_odd_texts(spark, corpus):
    docs, labels = corpus
    table = labelled.sample(docs, labels, "quality", F.lit(True), most=300)
    model = classifier.fit(table.column("text").combine_chunks(), table.column("y").to_numpy())
    rows = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a\x00b ÉÀ!!" * 40_000, 7), (None, "x", 7), (None, "x", 7)], "doc_id long, text string, Score int")
    got = classifier.score(rows, model.scores).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert classifier.score(rows.filter("false"), model.scores).count() == 0
    empty = labelled.sample(docs.filter("false"), labels, "quality", F.lit(True), most=10)
    assert 0 <= classifier.fit(empty.column("text").combine_chunks(), empty.column("y").to_numpy()).scores(*buffers(pa.array(["a"])))[0] <= 1


def test_scores_do_not_depend_on_batches(corpus):
    docs, labels = corpus
    table = labelled.sample(docs, labels, "toxic", F.lit(True), most=200)
    texts = table.column("text").combine_chunks()
    model = toxicity.fit(texts, table.column("y").to_numpy())
    whole = model.scores(*buffers(texts))
    parts = np.concatenate([model.scores(*buffers(texts.slice(a, b - a))) for a, b in byte_slices(texts, 5000)])
    assert np.allclose(whole, parts)


def test_field_marginals_equal_enumeration():
    import itertools

    crf = toxicity.Crf(np.random.default_rng(2).normal(size=1 << toxicity.BITS), -0.3, np.array([[0.4, -0.2], [-0.7, 0.9]]))
    w = toxicity.words(*buffers(pa.array(["alpha beta gamma delta", "epsilon\nzeta eta"])))
    p, pairs = crf.marginals(w)
    unary = crf.unary(w.index)
    want, seen = np.zeros(len(unary)), np.zeros((2, 2))
    for a, b in zip(w.blocks[:-1], w.blocks[1:]):
        total, own, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            v = np.exp(sum(unary[a + i] * y[i] for i in range(b - a)) + sum(crf.step[y[i - 1], y[i]] for i in range(1, b - a)))
            total += v
            own += v * np.array(y)
            for i in range(1, b - a):
                two[y[i - 1], y[i]] += v
        want[a:b] = own / total
        seen += two / total
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_spans_give_byte_offsets(spark, corpus):
    docs, labels = corpus
    table = labelled.sample(docs, labels, "toxic", F.lit(True), most=1000)
    tagger = toxicity.fit(table.column("text").combine_chunks(), table.column("y").to_numpy())
    text = "Größe über alles, you idiot. Fine day"
    rows = toxicity.spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), tagger).collect()
    assert [text.encode()[r.start : r.end].decode() for r in rows] == [r.word for r in rows]
    assert "idiot" in {r.word for r in rows} and {r.doc_id for r in rows} == {1}


def test_sample_fills_its_bytes_in_seeded_order(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 5 == 0 else 40)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    table = labelled.sample(docs, labels, "toxic", F.lit(True), most=50, most_bytes=16_000)
    assert table.num_rows == 50 and sum(len(t) == 1000 for t in table.column("text").to_pylist()) >= 5
    small = labelled.sample(docs, labels, "toxic", F.lit(True), most=60, most_bytes=16_000 // 10)
    # Texts of over a sixteenth are out, and the rest goes in by the order of hashes until it is full.
    order = sorted((hashlib.md5(f"sample:{i}".encode()).hexdigest(), i) for i in range(60) if i % 5)
    assert small.column("_o").to_pylist() == [h for h, _ in order][: 1600 // 40]


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"copy {i % 3}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 40 + [(2, 1), (2, 0), (2, 0)] + [(i, i % 2) for i in range(3, 30)], "doc_id long, toxic int")
    table = labelled.sample(docs, labels, "toxic", F.lit(True), most=20)
    texts = table.column("text").to_pylist()
    assert len(texts) == 20 == len(set(texts)) and sum(t.startswith("copy") for t in texts) <= 1
    every = labelled.sample(docs, labels, "toxic", F.lit(True), most=100)
    assert every.num_rows == 29 and dict(zip(every.column("text").to_pylist(), every.column("y").to_pylist()))["text 2"] == 0


def _enumerated(unary, step):
    """Marginals of a chain from all its labellings."""
    n, total, p, pairs = len(unary), 0.0, np.zeros(len(unary)), np.zeros((2, 2))
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(u for u, b in zip(unary, y) if b) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


@pytest.mark.parametrize("block", [2, 3, 64])
def test_marginals_are_those_of_whole_lines(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(2)
    unary, step = rng.normal(size=12), rng.normal(size=(2, 2))
    line = np.repeat([0, 1], [9, 3])
    p, pairs = toxicity.chain_marginals(unary, *toxicity.in_blocks(np.zeros(12, dtype=int), line), step)
    (a, pa_), (b, pb) = _enumerated(unary[:9], step), _enumerated(unary[9:], step)
    assert np.allclose(p, np.concatenate([a, b])) and np.allclose(pairs, pa_ + pb)


def test_long_texts_are_scored_like_short_ones():
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["bad", "ugly", "GOOD", "fine!", "Ärger"], size=4000)) + "\nbad good"
    data, offsets = buffers(pa.array([text]))
    tagger = toxicity.Tagger(toxicity.Crf(rng.normal(size=1 << 18), -1.0, rng.normal(size=(2, 2))), np.array([1.0, 1, 1, -2]))
    assert all(np.allclose(a, b) for a, b in zip(tagger.tagged(data, offsets), tagger.tagged(data, offsets, most=700)))
    model = classifier.Model(rng.normal(size=1 << 18), 0.1)
    index, _, n = classifier.features(data, offsets)
    total, words = model.long_total(data, 700)
    assert np.allclose(total, model.weights[index].sum()) and words[0] == n[0]


def test_offsets_are_those_of_the_words(spark):
    texts = ["gut und schäbig", None, "", "schäbig, schäbig"]
    crf = toxicity.Crf(np.zeros(1 << 18), -3.0, np.zeros((2, 2)))
    w = toxicity.words(*buffers(pa.array(["schäbig"])))
    crf.emit[w.index[0]] = 2.0
    crf.emit[0] = 0.0
    tagger = toxicity.Tagger(crf, np.array([1.0, 1, 1, -2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Spans", F.lit(1)).withColumn("_kept", F.lit(2))
    got = {(r.doc_id, s.start, s.end) for r in toxicity.tag(docs, tagger).collect() for s in r.spans}
    assert got == {(0, 8, 16), (3, 0, 8), (3, 10, 18)}
    assert {(r.doc_id, r.start, r.end, r.word) for r in toxicity.spans(docs, tagger).collect()} == {(*x, "schäbig") for x in got}


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], size=6)) for _ in range(30)]
    y = rng.integers(0, 2, 30)
    got = classifier.fit(pa.array(texts), y, epochs=2)
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0
    share = y.mean()
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= 0.02 else -(z[i] - np.sign(z[i]) * 0.02) / ((1 + np.sqrt(n[i])) / 0.3 + 0.5)
    for _ in range(2):
        for text, label in zip(texts, y):
            index, _, count = classifier.features(*buffers(pa.array([text])))
            x = {}
            for i in index.tolist():
                x[i] = x.get(i, 0) + 24.0 / count[0]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-(bias + sum(w[i] * v for i, v in x.items()))))
            g = (p - label) * 0.5 / (share if label else 1 - share)
            for i, v in x.items():
                old = n.get(i, 0.0)
                n[i] = old + (g * v) ** 2
                z[i] = z.get(i, 0.0) + g * v - (np.sqrt(n[i]) - np.sqrt(old)) / 0.3 * w[i]
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / 0.3 * bias
            nb += g * g
            bias = -zb / ((1 + np.sqrt(nb)) / 0.3)
    assert np.isclose(bias, got.bias) and all(np.isclose(weight(i), got.weights[i]) for i in z)
