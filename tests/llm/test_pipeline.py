"""Each stage of the pipeline against a plain version of it, on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from brickyard.llm import classifier, labelled, tokens
from brickyard.llm.vectext import buffers

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage, written and read again as the pipeline does."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        done = spark.read.parquet(f"{at}/{name}")
        out[name] = (docs.collect(), done.collect(), done.columns)
        docs = done
    return out


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixture", "pack"]
    assert all(columns == COLUMNS for name, (_, _, columns) in stages.items() if name != "pack")


def test_quality(spark, stages):
    before, after, _ = stages["quality"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    table = labelled.sample(docs, labels, "quality", labelled.remainder(F.col("doc_id"), 4) != 2, most=pipeline.SAMPLE_ROWS)
    model = classifier.fit(table.column("text").combine_chunks(), table.column("y").to_numpy())
    import pyarrow as pa

    score = {r.doc_id: model.scores(*buffers(pa.array([r.text])))[0] for r in before}
    assert Counter(after) == Counter(r for r in before if score[r.doc_id] >= pipeline.LEAST_QUALITY)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    assert len(good & kept) >= 0.97 * len(good)


def test_line_dedup(stages):
    before, after, _ = stages["line_dedup"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    held, total = Counter(), Counter(r.source for r in before)
    for r in before:
        held.update((r.source, k) for k in {key(x) for x in r.text.split("\n")} if k)
    want = {}
    for r in before:
        drop = lambda x: key(x) and held[r.source, key(x)] >= 5 and held[r.source, key(x)] > pipeline.MOST_LINE_SHARE * total[r.source]  # noqa: B023, E731
        lines = r.text.split("\n")
        rest = [x for x in lines if not drop(x)]
        whole = len(rest) == len(lines) or not any(key(x) for x in rest)
        want[r.doc_id] = r.text if whole else "\n".join(rest)
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)


def test_near_dedup(stages):
    before, after, _ = stages["near_dedup"]
    sets = {}
    for r in before:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert Counter(after) == Counter(r for r in before if find(r.doc_id) == r.doc_id)


def test_mixture(stages):
    before, after, _ = stages["mixture"]
    words = lambda t: len((t or "").encode().split())
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    target, open_sources, left = {}, set(size), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        open_sources -= over
    target |= {s: level * weight[s] for s in open_sources}
    for s in size:
        longest = max(words(r.text) for r in before if r.source == s)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    assert max(Counter(after).values()) <= 3 and set(after) <= set(before)


def test_pack(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["pack"]
    own = Tokenizer.from_file(tokens.tokenizer_path())
    total = sum(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    places = defaultdict(list)
    for r in after:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in after) == total and len(places) <= 1.02 * total / 2048 + 1


def test_run_gives_the_last_stage(spark, stages):
    rows = pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, rows.collect())) == Counter(map(key, stages["pack"][1]))


def test_planted_boilerplate_goes(spark):
    """A notice in one of four languages is in 8 of 200 documents of a source; a line in 3 of them is no boilerplate."""
    notice = lambda i: [f"All rights reserved, language {i % 4}"] if i % 25 < 4 else []
    shared = lambda i: ["said by three"] if i < 3 else []
    rows = [(f"{s}{i}", "\n".join([f"own line {s} {i}", *notice(i), *shared(i)]), "en", s, 0) for s in "ab" for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {f"{s}{i}": "\n".join([f"own line {s} {i}", *shared(i)]) for s in "ab" for i in range(200)}


ODD = "doc_id long, text string, lang string, source string, n_chars long, _score double, copies int, size long, text_key string, line string"


def _odd(spark):
    long = " ".join(f"wort{i % 997}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 300_000), (5, long), (6, "same text of some words that are good to read"), (6, "same text of some words that are good to read"), (None, "no id but words"), (None, None), (7, "a\nb\na"), (8, "a\nb\na")]
    return spark.createDataFrame([(i, t, "en", [None, "s", "t"][k % 3], len(t or ""), 0.5, 7, 7, "clash", "clash") for k, (i, t) in enumerate(rows)], ODD)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    docs, stage = _odd(spark), dict(pipeline.STAGES)[name]
    before, after = docs.collect(), stage(spark, docs, SF).collect()
    nothing = stage(spark, docs.limit(0), SF)
    assert nothing.collect() == []
    ids = Counter(r.doc_id for r in after)
    if name == "pack":
        assert sum(r.length for r in after if r.doc_id in (1, 2)) == 2 and sum(r.piece == 0 for r in after) == len(before)
        return
    assert nothing.columns == docs.columns
    if name == "quality":
        # Equal texts stay or go together, a null text like an empty one.
        assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before} and (1 in ids) == (2 in ids) and ids[6] in (0, 2) and (7 in ids) == (8 in ids)
    elif name == "line_dedup":
        assert Counter(after) == Counter(before)
    elif name == "near_dedup":
        assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2}
    else:
        assert set(after) <= set(before) and max(Counter(after).values()) <= 6 and ids[5] > 0


def test_the_quality_stage_sends_each_text_once(spark):
    import numpy as np

    from brickyard.llm import classifier

    docs = spark.createDataFrame([(1, "a b", "de", 3), (2, None, "en", 0), (3, "", None, 0)], "doc_id long, text string, lang string, n_chars long")
    found = classifier.score(docs, classifier.Model(np.zeros(1 << classifier.BITS), 0.0).scores, keep_text=True)
    assert sorted(map(tuple, found.collect())) == [(1, "a b", "de", 3, 0.5), (2, None, "en", 0, 0.5), (3, "", None, 0, 0.5)]
    sent = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan" in x or "Project" in x)
    assert sent.count("text#") == 1, sent
