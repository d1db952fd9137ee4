"""Token counts, packing, rules, sharding, mixing and line dedup on small tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brickyard.llm import linededup, mixing, packing, queries, rules, setsketch, sharding, tokens

SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(6000))
ODD = [
    (1, "The cat sat. The cat sat. The cat sat on the mat!!", "a"), (2, None, "a"), (3, "", None), (4, "  \t\n ", "b"), (5, LONG, "b"), (6, "naïve café – “quotes” don't, it's 3.14 € x", "a"),
    (7, "a<|endoftext|>b <|endoftext|> c", "b"), (8, "日本語 のテキスト　です 12345", None), (9, "same", "a"), (9, "same", "a"), (None, "no id", "c"), (10, "x" * 5000, "c"), (11, "é à ù\u0085next  two   spaces\r\nline", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_token_counts_equal_the_library(docs, library):
    got = tokens.token_counts(docs.withColumn("N_TOKENS", F.lit(1)), path=tokens.tokenizer_path()).collect()
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_pieces_are_cut_only_where_tokens_end(library):
    codec = tokens.PieceEncoder(tokens.tokenizer_path())
    assert codec.split
    import pyarrow as pa

    from brickyard.llm.vectext import buffers

    texts = [f"ab{chr(c)}cd {chr(c)} e {chr(c)}{chr(c)}f, g{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = codec.counts(*buffers(pa.array(texts)))
    assert got.tolist() == [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_counts_of_other_tokenizers(docs):
    import sentencepiece

    path = tokens.tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.token_counts(docs, path=path).select("n_tokens").collect()
    assert sorted(r[0] for r in got) == sorted(len(own.encode(t or "")) for _, t, _ in ODD)


def test_token_counts_of_an_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), path=tokens.tokenizer_path()).count() == 0


def test_packing_round_trip(docs, library):
    pieces = packing.token_pieces(docs, path=tokens.tokenizer_path(), capacity=256, with_ids=True)
    rows = packing.pack_pieces(pieces, capacity=256, items_per_task=8).collect()
    found = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 256 and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        found[r.sequence_id].append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    assert sum(r.length for r in rows) == want
    assert len(found) <= -(-want // 256) + 1
    whole = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [i for r in whole for i in r.ids] == [*library.encode(LONG, add_special_tokens=False).ids, 0]
    assert all(r.length == 256 for r in whole[1:]) and [r.start for r in whole][0] == 0


def test_packing_an_empty_table(spark):
    pieces = packing.token_pieces(spark.createDataFrame([], SCHEMA), path=tokens.tokenizer_path())
    assert packing.pack_pieces(pieces).count() == 0


def test_best_fit_takes_the_fullest_bin():
    where, offset, fill = packing.best_fit([60, 50, 40, 30, 10], 100)
    assert where == [0, 1, 0, 1, 1] and offset == [0, 0, 60, 50, 80] and fill == [100, 90]


def _words(text):
    return (text or "").encode().split()


def test_ledger_against_brute_force(docs):
    rows = rules.ledger(docs.withColumn("failed_bits", F.lit(9))).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    want = Counter()
    for d, t, _ in ODD:
        w = _words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        held = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want[d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(held)] += 1
    assert got == want


def test_policies_and_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (2,), (3,), (16,), (17,), (0,)], "failed_bits int")
    policy = rules.Policy("t", ("few_words", "repeated_words"))
    assert ledger.filter(rules.passes(policy)).count() == 3
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in rules.ablations(ledger, policy).collect()}
    assert got == {"few_words": (3, 2, 5), "repeated_words": (2, 1, 4)}
    assert rules.ablations(ledger.filter("false"), policy).select("n_failed").first()[0] == 0


def test_sharding_is_balanced_and_gapless(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    rows = sharding.assign(many, shards=8, n_cells=1024).collect()
    assert len(rows) == 4000
    load, slots = Counter(), defaultdict(set)
    for r in rows:
        assert r.size == r.doc_id % 97 + 16 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 97))
        load[r.shard] += r.size
        slots[r.shard].add(r.slot)
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) < 1.02 * mean and min(load.values()) > 0.98 * mean
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 4000


def test_sharding_moves_little_when_a_shard_is_added(spark):
    cells = spark.range(1024).select(F.col("id").alias("cell"), F.lit(100).cast("long").alias("bytes"), F.lit(1).cast("long").alias("n"))
    a = {r.cell: r.shard for r in sharding.place_cells(cells, shards=10, n_cells=1024, replicas=64, slack=0.3).collect()}
    b = {r.cell: r.shard for r in sharding.place_cells(cells, shards=11, n_cells=1024, replicas=64, slack=0.3).collect()}
    assert sum(a[c] != b[c] for c in a) < 0.35 * len(a)


def test_sharding_spreads_a_heavy_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    load = Counter(r.shard for r in sharding.assign(many, shards=8, n_cells=1024).collect())
    assert sum(load.values()) == 3000 and max(load.values()) < 1.02 * 375


def test_sharding_against_a_plain_ring_walk(spark):
    shards, n_cells, replicas, slack = 7, 64, 5, 0.05
    rng = random.Random(3)
    rows = [(i, "t" * rng.choice((0, 5, 50, 900))) for i in range(400)] + [(7, "same")] * 9 + [(None, None)] * 3
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    seen, cells = Counter(), {}
    for d, t in rows:
        row = (d, len(t or "") + 16, zlib.crc32((t or "").encode()))
        copy = seen[row]
        seen[row] += 1
        key = ":".join([str(d) if d is not None else "", str(row[2]), *([str(copy)] if copy else [])])
        cells.setdefault(int(md5(key)[:8], 16) // (2**32 // n_cells), []).append((*row, copy))
    nodes = sorted((int(md5(f"shard:{s}:{v}")[:8], 16), s) for s in range(shards) for v in range(replicas))
    size = {c: sum(r[1] for r in own) for c, own in cells.items()}
    cap, loads, of = sum(size.values()) * (1 + slack) / shards, [0] * shards, {}
    for c in sorted(cells, key=lambda c: (-size[c], c)):
        ahead = [s for p, s in nodes if p >= c * (2**32 // n_cells)] + [s for p, s in nodes if p < c * (2**32 // n_cells)]
        of[c] = next((s for s in ahead if loads[s] + size[c] <= cap), loads.index(min(loads)))
        loads[of[c]] += size[c]
    want, used = [], Counter()
    for c in sorted(cells):
        for r in sorted(cells[c], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1], r[3])):
            want.append((r[0], r[1], r[2], of[c], used[of[c]]))
            used[of[c]] += 1
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards, n_cells=n_cells, replicas=replicas, slack=slack).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == Counter(want)


def test_sharding_odd_rows(docs, spark):
    rows = sharding.assign(docs, shards=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in ODD)
    assert all(r.size == len((t or "").encode()) + 16 for r in rows for d, t, _ in ODD if d == r.doc_id)
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_water_filling(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("b", 100, 1), ("c", 1000, 1), (None, 0, 5)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(rows).collect()}
    # 1110 words: a stops at 30 and b at 300, c takes what is left.
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0, None: 0.0}


def test_mixture_comes_near_its_targets(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 23).cast("int")).alias("text"), F.element_at(F.array(*map(F.lit, "aaaaab")), (F.col("id") % 6 + 1).cast("int")).alias("source"))
    rows = mixing.mix(docs)
    for r in rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("times").alias("m")).collect():
        assert abs(r.t - r.g) <= 1 and r.m <= 3
    again = mixing.mix(docs.repartition(3))
    assert sorted(rows.collect()) == sorted(again.collect())
    assert mixing.sampled(docs).select(F.sum(mixing.word_count(F.col("text")))).first()[0] == rows.agg(F.sum("taken")).first()[0]


def test_mixture_of_odd_rows(docs, spark):
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in ODD)
    assert all(r.size == len(_words(t)) and r.taken <= 3 * r.size for r in rows for d, t, _ in ODD if d == r.doc_id)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert set(mixing.sampled(docs.withColumn("target", F.lit(1))).columns) == {"doc_id", "text", "source", "target"}


def test_line_dedup(spark):
    rows = [(i, "h", f"own {i}\n Menu \nfoot{'er' if i < 5 else ''}") for i in range(10)] + [(20, "g", "Menu\nown"), (21, None, None), (22, None, "Menu\n\nMenu"), (23, "h", "menu"), (24, "h", "Menu")]
    pages = spark.createDataFrame(rows, "id long, host string, text string").withColumn("n_lines", F.lit("old"))
    got = {r.id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_lines(pages, ratio=0.3, least_pages=5).collect()}
    assert got[0] == ("own 0", 3, 2) and got[7] == ("own 7", 3, 2)
    assert got[20] == ("Menu\nown", 2, 0) and got[21] == (None, 0, 0) and got[22] == ("Menu\n\nMenu", 2, 0)
    assert got[24] == ("Menu", 1, 0)  # a page that would lose all stays
    assert linededup.drop_lines(pages.filter("false")).count() == 0


def test_html_lines(spark):
    page = '<html><script>var x="</p>";</script><p>One &amp; <b>two</b></p>\n<!-- no --><p> </p><style>p{}</style>three</html>'
    text = spark.createDataFrame([(page,)], "h string").select(linededup.html_lines(F.col("h"))).first()[0]
    assert [x.strip() for x in text.split("\n") if x.strip()] == ["One &amp;", "two", "three"]


def _bins(rows, capacity):
    """Fill of each sequence, after its pieces were found gapless."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return places


def test_bins_that_nothing_fills_leave_the_rounds(spark, monkeypatch):
    # 600 pieces of over half a sequence and 6 short ones, over about 60 tasks.
    lengths = [60 + i % 30 for i in range(600)] + [9, 12, 15, 20, 25, 30]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rounds, plain = [], packing._round

    def seen(items, *rest):
        rounds.append((items.count(), items.rdd.getNumPartitions()))
        return plain(items, *rest)

    monkeypatch.setattr(packing, "_round", seen)
    rows = packing.pack_pieces(pieces, capacity=100, items_per_task=10).collect()
    assert sorted(r.length for r in rows) == sorted(lengths) and len(_bins(rows, 100)) == 600
    assert len(rounds) <= 4 and all(n <= 2 * before for (_, before), (n, _) in zip(rounds, rounds[1:]))


def test_short_bins_find_the_long_ones_of_other_tasks(spark):
    lengths = [70] * 97 + [30] * 97
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(pieces, capacity=100, items_per_task=5).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert len(_bins(rows, 100)) <= 97 + 20


def test_best_fit_against_a_plain_loop():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(300)]
    where, offset, fill = packing.best_fit(lengths, 100)
    bins = []
    for n, b, at in zip(lengths, where, offset):
        room = [(100 - x, i) for i, x in enumerate(bins) if x + n <= 100]
        assert at == (bins[b] if b < len(bins) else 0)
        assert 100 - at == (min(room)[0] if room else 100)
        bins += [0] * (b + 1 - len(bins))
        bins[b] += n
    assert bins == fill


def test_packing_ends_where_bins_cannot_merge(spark):
    pieces = spark.range(120).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1100).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    rows = packing.pack_pieces(pieces.withColumn("Offset", F.lit("x")), items_per_task=10).collect()
    assert len({r.sequence_id for r in rows}) == 120 and all(r.offset == 0 for r in rows)


def test_equal_rows_spread_over_shards(spark):
    for n in (90, 20_000):
        load = Counter(r.shard for r in sharding.assign(spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))).select("shard").collect())
        assert len(load) == 40 and max(load.values()) - min(load.values()) <= max(1, n // 2000)


def test_sharding_does_not_depend_on_partitions(spark):
    docs = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 13).cast("int")).alias("text"), F.lit(1).alias("copy"))
    once, again = (Counter(map(tuple, sharding.assign(d, shards=7, n_cells=512).collect())) for d in (docs.repartition(3), docs.repartition(9, "text")))
    assert once == again


def test_sharding_moves_little_with_the_settings_of_the_query(spark):
    cells = spark.range(8192).select(F.col("id").alias("cell"), (F.lit(100_000) + F.col("id") % 97 * 500).alias("bytes"), F.lit(1).cast("long").alias("n"))
    a, b = ({r.cell: r.shard for r in sharding.place_cells(cells, shards=n, n_cells=8192).collect()} for n in (40, 41))
    assert sum(a[c] != b[c] for c in a) < 0.1 * len(a)


def test_operators_keep_columns_of_clashing_names(spark):
    extra = ["_host", "_keys", "_lines", "_n", "_d", "_m", "_text_key", "_copy", "text_key", "copies", "_own_id"]
    docs = spark.createDataFrame([(i, f"line one\nline {i} with some more words here", "s") for i in range(12)], SCHEMA)
    for c in extra:
        docs = docs.withColumn(c, F.lit(c))
    for out in (linededup.drop_lines(docs, host_col="source"), rules.ledger(docs), mixing.sampled(docs), setsketch.drop_near_duplicates(docs)):
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in extra)


def test_tables_with_hot_keys_mix_like_others(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 9000
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_all_registered_queries_equal_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    for name, query in queries.QUERIES.items():
        rows = query(spark, sf)
        got = rows.collect()
        assert got and (query.__doc__ or "").strip()
        if name in queries.ORACLES:
            found = con.execute(queries.ORACLES[name])
            names = [c[0] for c in found.description]
            want = Counter(tuple(plain(x) for x in r) for r in found.fetchall())
            assert sorted(names) == sorted(rows.columns)
            assert Counter(tuple(plain(r[c]) for c in names) for r in got) == want, name
