"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballmeans, classifier, curve, labelled, linededup, mixing, packing, rules, segmentcodes, setsketch, sharding, tokens, topk, toxicity
from brickyard.checkpoints import kept


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 5000


def _fitted(docs: DataFrame, labels: DataFrame, label: str, fit, modulus: int, held: int):
    """A model fitted on a sample of the labels that aren't held out."""
    table = labelled.sample(docs, labels, label, labelled.remainder(F.col("doc_id"), modulus) != held, most=SAMPLE_ROWS)
    return fit(table.column("text").combine_chunks(), table.column("y").to_numpy())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (byte offsets of offending words) of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.tag(docs, _fitted(docs, _read(spark, sf_dir, "labels"), "toxic", toxicity.fit, 3, 1))
    return rows.select("doc_id", (labelled.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = classifier.score(docs, _fitted(docs, _read(spark, sf_dir, "labels"), "quality", classifier.fit, 4, 2).scores)
    return rows.select("doc_id", (labelled.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, text, n_lines and n_dropped of every page, without the lines that over a tenth of its host's pages (and at least 5) hold."""
    pages = _read(spark, sf_dir, "pages").select("page_id", linededup.page_host(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    # Both passes read the text of the mark-up, whose patterns cost more than writing it.
    return linededup.drop_lines(kept(pages), ratio=0.1, least_pages=5)


OP2_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'),
                        '<[^>]*>', chr(10), 'g'), '\n[\x20\x09-\x0D]*\n', chr(10), 'g') AS text
  FROM pages
), h AS (
  SELECT host, count(*) AS n_host FROM p GROUP BY host
), l AS (
  SELECT r, host, i, line, nullif(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') AS bare
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p)
), k AS (
  SELECT l.host, bare FROM l JOIN h ON l.host IS NOT DISTINCT FROM h.host WHERE bare IS NOT NULL
  GROUP BY l.host, bare, n_host HAVING count(DISTINCT r) >= 5 AND count(DISTINCT r) > n_host * 0.1
), m AS (
  SELECT l.*, k.bare IS NOT NULL AS hit FROM l LEFT JOIN k ON l.host IS NOT DISTINCT FROM k.host AND l.bare = k.bare
), s AS (
  SELECT r, count(bare) AS n, count(*) FILTER (hit) AS d, string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS rest FROM m GROUP BY r
)
SELECT page_id, host, CASE WHEN d > 0 AND d < n THEN rest ELSE text END AS text, coalesce(n, 0) AS n_lines,
       CASE WHEN d > 0 AND d < n THEN d ELSE 0 END AS n_dropped
FROM p LEFT JOIN s USING (r)
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; five words, similarity 0.75 or more."""
    return setsketch.near_duplicates(_read(spark, sf_dir, "documents"), width=5, percent=75)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (512) of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, path=tokens.tokenizer_path(), limit=512)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, and its verdicts by the base policy and by version 2."""
    rows = rules.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    base, policy = rules.POLICIES["base"], rules.POLICIES["2"]
    return rows.select(*columns, (~rules.passes(base)).alias("base_failed"), rules.passes(policy).alias("kept"), "failed_bits")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
            + 8 * (word_chars > 12 * n_words)::INT + 16 * (10 * n_symbols > 3 * n_words)::INT
            + 32 * (100 * n_dup_lines > 50 * n_lines)::INT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits
FROM b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of version 2 fails, fails alone, and what would be kept without it, over all documents."""
    rows = rules.ledger(_read(spark, sf_dir, "documents").select("text"))
    return rules.ablations(rows, rules.POLICIES["2"])


ABLATIONS_SQL = f"""
WITH o AS ({OP7_SQL}), r(k, rule) AS (VALUES {", ".join(f"({1 << k}, '{rule}')" for k, rule in enumerate(rules.RULES))})
SELECT '2' AS version, rule, count(*) FILTER (failed_bits & k <> 0) AS n_failed, count(*) FILTER (failed_bits = k) AS n_only, count(*) FILTER (failed_bits & ~k = 0) AS n_kept_without
FROM o, r GROUP BY rule
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(_read(spark, sf_dir, "documents"), path=tokens.tokenizer_path(), capacity=2048)
    return packing.pack_pieces(pieces, capacity=2048)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50; a row's own are all rows of its id."""
    vectors = topk.quantised(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard (of 40) and slot of every document under law ``bytes``."""
    rows = sharding.assign(_read(spark, sf_dir, "documents"), shards=40)
    return rows.withColumn("grown_shard", F.lit(None).cast("int"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, at most three times its own."""
    rows = mixing.mix(_read(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce(max(level) FILTER (level * weight <= cap) OVER () * weight, cap::DOUBLE)) AS target
  FROM l
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         row_number() OVER () AS r, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, CASE WHEN whole < 3 THEN target - whole * source_size ELSE 0.0 END AS rest, upto <= rest AS more FROM r
), x AS (
  SELECT *, rest - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0) AS rest_left FROM m
), y AS (
  SELECT *, NOT more AND whole < 3 AS may, abs(rest_left - size) AS gap FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY source, may ORDER BY gap, h, doc_id, size, r) AS k FROM y
)
SELECT doc_id, size, source_size, target,
       (size * (whole + (whole < 3 AND more OR may AND k = 1 AND gap < rest_left)::INT))::BIGINT AS taken
FROM z
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector in 16 parts of 64 entries, its error and that of its label."""
    return segmentcodes.compress(_read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    floored = "((s - (((s % n) + n) % n)) // n)"
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, len(embedding) AS dim, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), d AS (
  SELECT first(dim ORDER BY vec_id, v) AS dim FROM v WHERE vec_id IS NOT NULL AND dim > 0 AND dim % {parts} = 0
), p AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * dim // {parts} + 1, (p + 1) * dim // {parts}) AS x
  FROM v JOIN d USING (dim), range({parts}) AS t(p)
), b AS (
  SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v JOIN d USING (dim) WHERE vec_id IS NOT NULL
), c0 AS MATERIALIZED (
  SELECT p, e, x FROM p JOIN b USING (r) WHERE e < {entries}
)"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT r, p.p, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m
  FROM p JOIN c{i} c ON p.p = c.p GROUP BY r, p.p
)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(f.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT p, e, list({floored}::BIGINT ORDER BY i) AS x FROM (
      SELECT p, e, i, sum(x) AS s, count(*) AS n
      FROM (SELECT a.p, a.m.e AS e, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS i FROM a{i} a JOIN p ON a.r = p.r AND a.p = p.p) GROUP BY p, e, i
    ) GROUP BY p, e
  ) f ON c.p = f.p AND c.e = f.e
)"""
    return out + f""", h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}
), k AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v LEFT JOIN k USING (r), h
"""


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens, along the curve."""
    return curve.pack(_read(spark, sf_dir, "documents"), path=tokens.tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components among 16, after three rounds."""
    return ballmeans.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", scale=64, dim=64)


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS x FROM v WHERE vec_id IS NOT NULL) WHERE c < {k}
)"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c)) AS m FROM v, c{i} GROUP BY r
)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(f.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i
    ) GROUP BY c
  ) f ON c.c = f.c
)"""
    return out + f"""
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.c = m.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_curve_packing": op12_curve_packing,
    "op13_ball_clusters": op13_ball_clusters,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op5_topk": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_ball_clusters": _op13_sql(),
    "quality_ablations": ABLATIONS_SQL,
}
