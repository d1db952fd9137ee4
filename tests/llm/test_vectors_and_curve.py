"""Vector codes, ball clusters and packing along the curve, against plain loops and the tokenizer's own library."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.llm import ballmeans, curve, segmentcodes, tokens, wholevec

INF, NAN = float("inf"), float("nan")


def _table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, v string, code string, cluster int, _l int")


def _row(i, x, label=None):
    return (i, x, label, "v", "code", -1, 7)


def _vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [[c + rng.gauss(0, spread) for c in centres[rng.randrange(7)]] for _ in range(n)]


ODD = [None, [], [1.0, None] + [0.0] * 62, [NAN] * 64, [INF] + [0.0] * 63, [0.5] * 32]


def _floor(x, scale):
    return [math.floor(scale * c) for c in x]


def _nearest(x, centroids):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))


def _means(old, members):
    return [[sum(col) // len(members[j]) for col in zip(*members[j])] if members[j] else c for j, c in enumerate(old)]


def _plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label), all of one length."""
    whole = [(i, _floor(x, scale), lab) for i, x, lab in rows]
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    first = sorted((i, v) for i, v, _ in whole if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in whole:
                members[_nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = _means(books[p], members)
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    out, label = [], defaultdict(int)
    for i, v, lab in whole:
        best = [_nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        label[lab] += error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, lab))
    return sorted(((i, c, e, label[lab], sha) for i, c, e, lab in out), key=str)


def _plain_clusters(rows, k, rounds, scale):
    whole = [(i, _floor(x, scale)) for i, x in rows]
    h = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((h(i), v) for i, v in whole if i is not None)[:k]]
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in whole:
            members[_nearest(v, centroids)[1]].append(v)
        centroids = _means(centroids, members)
    best = [(i, *_nearest(v, centroids)) for i, v in whole]
    inertia = defaultdict(int)
    for _, d, j in best:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in best), key=str)


def _collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_codes_against_a_plain_loop(spark):
    x = _vectors(220, 64, 1)
    rows = [(1000 - i, v, i % 3 if i % 5 else None) for i, v in enumerate(x)] + [(2000 + i, x[3], 9) for i in range(40)] + [(7, x[4], 1)] * 2 + [(None, x[5], 1)]
    odd = [_row(3000 + i, v) for i, v in enumerate(ODD[:5])]
    got = segmentcodes.compress(_table(spark, [_row(*r) for r in rows] + odd).repartition(5))
    want = _plain_codes(rows, 16, 64, 2, 256)
    # The empty vector is kept, but nothing can be said of it.
    assert _collected(got, *CODES) == sorted([*want, (3001, None, None, next(w[3] for w in want if w[0] == 990), want[0][4])], key=str)


def test_codes_of_other_shapes(spark):
    rows = [(i, v, 0) for i, v in enumerate(_vectors(90, 21, 2))]
    got = segmentcodes.compress(_table(spark, [_row(*r) for r in rows] + [_row(500, [0.1] * 20, 5)]), parts=3, entries=10, rounds=3)
    want = _plain_codes(rows, 3, 10, 3, 256)
    assert _collected(got, *CODES) == sorted([*want, (500, None, None, None, want[0][4])], key=str)
    few = [(i, v, 0) for i, v in enumerate(_vectors(5, 16, 3))]
    assert _collected(segmentcodes.compress(_table(spark, [_row(*r) for r in few])), *CODES) == _plain_codes(few, 16, 64, 2, 256)
    assert segmentcodes.compress(_table(spark, [])).collect() == []
    assert [r.code for r in segmentcodes.compress(_table(spark, [_row(None, [0.1] * 16)])).collect()] == [None]
    with pytest.raises(ValueError):
        segmentcodes.compress(_table(spark, []), entries=300)


def test_codes_of_large_and_equal_components(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.choice((-1, 1)) * 2 ** rng.choice((0, 20, 44))) for _ in range(16)], None) for i in range(80)] + [(900, [0.25] * 16, None)] * 3
    got = segmentcodes.compress(_table(spark, [_row(*r) for r in rows]), parts=4, entries=8)
    held = lambda e: min(e, wholevec.LONG_MAX)
    want = [(i, c, held(e), held(le), s) for i, c, e, le, s in _plain_codes(rows, 4, 8, 2, 256)]
    assert _collected(got, *CODES) == sorted(want, key=str)


def test_bounds_spare_most_exact_distances():
    rng = np.random.default_rng(6)
    for width in (1, 3, 4, 7, 16, 64):
        entries = rng.integers(-500, 500, (64, 1)) + rng.integers(-60, 60, (64, width))
        x = entries[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, width))
        x[:50] = (entries[:50] + entries[1:51]) // 2
        code, d, n = segmentcodes.encode(x, segmentcodes.book(entries))
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        assert n < 0.35 * full.size


def test_code_round_trip(spark):
    x = _vectors(120, 32, 8)
    rows = wholevec.quantised(_table(spark, [_row(i, v) for i, v in enumerate(x)]), scale=256)
    books = segmentcodes.train(rows, parts=8, entries=16, rounds=2)
    for r in segmentcodes.codes(rows, books).collect():
        v = _floor(x[r.vec_id], 256)
        assert sum((a - b) ** 2 for a, b in zip(v, segmentcodes.decoded(books, r.code))) == r.error


def test_clusters_against_a_plain_loop(spark):
    x = _vectors(260, 64, 11, 0.4)
    rows = [(i * 37 % 1009, v) for i, v in enumerate(x)] + [(4000 + i, x[3]) for i in range(90)] + [(5, x[4])] * 2 + [(None, x[6])]
    odd = [_row(6000 + i, v) for i, v in enumerate(ODD)] + [_row(6100, [0.1] * 65)]
    got = ballmeans.cluster(_table(spark, [_row(*r) for r in rows] + odd).repartition(5))
    assert _collected(got, *CLUSTERS) == _plain_clusters(rows, 16, 3, 64)


def test_clusters_of_few_equal_and_large_vectors(spark):
    few = [(i, v) for i, v in enumerate(_vectors(5, 64, 12))] + [(9, [0.0] * 64)] * 30
    assert _collected(ballmeans.cluster(_table(spark, [_row(*r) for r in few])), *CLUSTERS) == _plain_clusters(few, 16, 3, 64)
    rng = random.Random(13)
    large = [(i, [float(rng.choice((-1, 1)) * 2 ** rng.choice((0, 30, 46))) for _ in range(4)]) for i in range(60)]
    held = lambda d: min(d, wholevec.LONG_MAX)
    want = [(i, j, held(d), held(a), held(b), s) for i, j, d, a, b, s in _plain_clusters(large, 6, 3, 64)]
    assert _collected(ballmeans.cluster(_table(spark, [_row(*r) for r in large]), k=6, dim=4), *CLUSTERS) == sorted(want, key=str)
    assert ballmeans.cluster(_table(spark, [])).collect() == []
    assert ballmeans.cluster(_table(spark, [_row(None, [0.1] * 64)])).collect() == []


def test_balls_spare_distances_and_keep_ties():
    rng = np.random.default_rng(14)
    centroids = rng.integers(-300, 300, (16, 8))
    x = centroids[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))
    x[:16] = centroids
    x[16:32] = (centroids + np.roll(centroids, 1, axis=0)) // 2
    at, d = ballmeans.nearest(x, centroids)
    moved = centroids + rng.integers(-9, 10, centroids.shape)
    reach = [math.isqrt(int(d[at == j].max())) + 1 + math.isqrt(int(((moved[j] - centroids[j]) ** 2).sum())) + 1 for j in range(16)]
    balls = ballmeans.balls(moved.tolist(), reach)
    want, best = ballmeans.nearest(x, moved)
    got, near, n = ballmeans.moved(x, at, moved, balls)
    assert (got == want).all() and (near == best).all()
    assert n < 0.5 * 16 * len(x)
    assert any(len(ids) < 15 for ids, _ in balls)


# --- the curve ---


def test_hilbert_curve_steps_to_a_neighbour():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        keys = curve.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(1 << (n * bits)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert curve.hilbert_keys(np.array([[(1 << 15) - 1] * 4]), 15)[0] < 1 << 60


def test_ids_are_packed_in_two_or_four_bytes():
    for ids in ([], [0], [1, 65535], [7, 65536, 2**32 - 1]):
        own = np.array(ids, dtype="<u4")
        raw = curve.packed(own)
        assert len(raw) == (2 if max(ids, default=0) < 65536 else 4) * len(ids)
        assert curve.unpacked(raw, len(ids)).tolist() == ids


def test_tail_is_cut_at_powers_of_two():
    assert curve.tail(0, 2048) == [0]
    assert curve.tail(4096, 2048) == [4096]
    assert curve.tail(2048 + 1300, 2048) == [2048, 3072, 3328, 3344, 3348]


TEXTS = [
    None, "", " ", "a", "Hello, World's END! 123", "ÄÖÜ ß ÀÈ café café ́x", "<|endoftext|> is <|startoftext|>x", "tab\tnew\nline  two   spaces", "don't we'll I'm",
    "日本語 テキスト。 中文", "x" * 5000, "é. É! a b 　 c", "it's.end,of;line:here?yes*no%$&#", "🙂🙂 🙂a", "İstanbul ǅ", "​ zero ​width", "ﬁ ligature ½",
]


def _library(texts, end_id=1):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    return [own.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def _check_packing(rows, pieces, capacity=2048):
    """rows: (id, text) with unique ids."""
    ids = dict(zip([r[0] for r in rows], _library([r[1] for r in rows])))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    assert set(of_doc) == set(ids)
    for d, own in of_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for own in of_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    assert len(of_sequence) <= sum(map(len, ids.values())) // capacity + capacity.bit_length()
    return of_sequence


def test_curve_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(curve, "CHUNK_IDS", 3000)
    monkeypatch.setattr(curve, "RANGE_ROWS", 40)
    rng = random.Random(21)
    words = ["apple", "Bread", "sky", "naïve", "x1", "über", "don't", "日本"]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 700)))) for i in range(120)]
    rows += [(900 + i, "same words again and again") for i in range(80)] + [(5000, " ".join(rng.choices(words, k=40_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "chunk", "key", "n", "ids", "part", "at")}).repartition(6)
    pieces = curve.pack(docs, path=tokens.tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    _check_packing(rows, pieces)
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) for p in pieces)


def test_curve_packing_of_repeated_rows_null_ids_and_an_empty_table(spark):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "d e")] * 2 + [(2, None)], "doc_id long, text string")
    got = curve.pack(docs, path=path).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in got if p.start == 0) == [("1", 4)] * 5 + [("2", 1)] + [("None", 3)] * 2
    assert sum(p.length for p in got) == 27
    empty = curve.pack(docs.limit(0), path=path)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_word_end_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    own, library = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert own.split
    rng = random.Random(22)
    odd = [" ", "  ", "\n", "a", "Z", "é", "é", "́", "İ", "1", ".", "'", "'s", "<|endoftext|>", " ", " ", "ß", "日", "🙂", "\u0085", "½", "-", ",", "<|", "가"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)} c{chr(c)}." for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    # Repetitive words, whose merges overlap, and words of all Latin letters in upper and lower case.
    for letters in ("ah", "ae", "st", "xo", "haw", "ing", "äöü", "éa", "ßs", "theins", "abcdefghijklmnopqrstuvwxyz", "AbÀßÿŒĲŁſÑİı"):
        texts += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(20)) for _ in range(100)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, first = own.encoded(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == want.ids, repr(texts[i])


def test_neighbours_on_the_curve_are_alike():
    rng = random.Random(23)
    topics = [[rng.randrange(40_000) for _ in range(60)] for _ in range(12)]
    docs = [(t, rng.choices(topics[t], k=200)) for t in range(12) for _ in range(40)]
    rng.shuffle(docs)
    first = np.concatenate([[0], np.cumsum([len(d) for _, d in docs])])
    points = curve.coordinates(np.array([i for _, d in docs for i in d]), first)
    assert np.allclose(points[7], curve.long_coordinates(np.array(docs[7][1]))[0])
    same = lambda order: sum(docs[a][0] == docs[b][0] for a, b in zip(order[:-1], order[1:])) / (len(docs) - 1)
    assert same(range(len(docs))) < 0.2 < 0.6 < same(np.argsort(curve.keys(points)))
    assert (curve.coordinates(np.zeros(0, dtype=np.int64), np.array([0, 0])) == 0).all()


def test_new_queries_keep_their_columns(spark):
    from brickyard.llm.queries import QUERIES

    longs = {"op12_curve_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]}
    for name, columns in longs.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns == columns and all(isinstance(f.dataType, T.LongType) for f in df.schema)
        rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
        _check_packing([tuple(r) for r in rows], df.collect())
