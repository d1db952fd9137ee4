"""Near-duplicates of word-shingle sets by SetSketch registers.

1. Each text's distinct shingles become a 128-bit set signature and a
   SetSketch: M registers ``floor(1 - log_b(h))`` of the least of
   exponentially distributed hashes, truncated to 16 bits. Registers of two
   sets merge by their maximum. Equal sets are one class from here on.
2. Bands of four registers are the buckets in which classes meet. Within a
   bucket the Jaccard similarity is estimated by the joint likelihood of the
   larger, smaller and equal registers given both set sizes; what may reach
   the threshold joins the same family.
3. Classes of a family are compared exactly on the shingle sets of their
   whole texts. The links' connected components are the result.

Both comparisons look for components, not for all pairs, so large groups go
over *pivots* first: every class is compared with the class of its bucket
that meets most others. That is one row for each class, however large the
group, and joins a group of near copies at once. What is still in several
parts goes on, as pairs of bounded blocks, and blocks of the part that holds
most of a group never meet each other. Nothing is cut short, and no group
lands in one task. A link of similarity s is missed if no band agrees:
at 0.75, (1 - 0.75**4) ** 32 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept
from brickyard.operators.components import components
from .names import fresh
from .vectext import buffers, byte_slices, mix, shingles

SLICE_BYTES = 1 << 20
M = 128
BAND = 4
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 1
#: Similarity below the threshold by about four standard errors of M registers, from which pairs are compared exactly.
CUT = 0.6
#: Buckets of more classes are compared with PIVOT_ROUNDS pivots, one after another, before their blocks are.
SMALL_BUCKET = 64
PIVOT_ROUNDS = 2
#: Rows of a block of sketches, and rows and shingles of a block of texts.
SKETCH_BLOCK = 2048
TEXT_BLOCK = 512
TEXT_BLOCK_SHINGLES = 1 << 19

_STEPS = np.random.default_rng(0x5E7).integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], dtype=np.uint64)


def registers(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sketch of each segment of hashed items: a row of M 16-bit registers; empty segments have zeros."""
    out = np.zeros((len(bounds) - 1, M), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(M):
            least = np.minimum.reduceat(items * _STEPS[k], bounds[full]).astype(np.float64)
            h = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2**-53)) / RATE
            out[full, k] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP)
    return out


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(left, right)


def signatures(items: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits for each segment, the same for equal sets."""
    full = np.flatnonzero(np.diff(bounds))
    sums = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    for k, salt in enumerate(_SALTS):
        if len(full):
            sums[full, k] = np.add.reduceat(mix(items ^ salt), bounds[full])
    raw = sums.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(sums))]


def likely(more: np.ndarray, less: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, cut: float) -> np.ndarray:
    """Whether the joint likelihood's maximum lies at ``cut`` or above, given how many registers are larger and smaller.

    The log-likelihood of the similarity is concave, so the sign of its
    slope at ``cut`` tells.
    """
    more, less = more.astype(np.float64), less.astype(np.float64)
    same = M - more - less
    total = n_left + n_right
    u, v = n_left / total, n_right / total
    possible = np.minimum(u / v, v / u) >= cut
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    dp = lambda x: c / (np.log(BASE) * (1 - x * c))
    x, y = np.maximum(u - v * cut, 1e-9), np.maximum(v - u * cut, 1e-9)
    slope = same * (v * dp(x) + u * dp(y)) / np.maximum(1 - p(x) - p(y), 1e-9) - more * v * dp(x) / np.maximum(p(x), 1e-9) - less * u * dp(y) / np.maximum(p(y), 1e-9)
    return possible & (slope >= 0)


def may_reach(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, cut: float) -> np.ndarray:
    """``likely`` for each row of one block and each row of the other."""
    if len(left) * len(right) <= 2048:
        more = (left[:, None, :] > right[None, :, :]).sum(axis=2)
        less = (left[:, None, :] < right[None, :, :]).sum(axis=2)
    else:
        more = np.zeros((len(left), len(right)), dtype=np.uint8)
        less = np.zeros_like(more)
        for k in range(left.shape[1]):
            x, y = left[:, k][:, None], right[:, k][None, :]
            more += x > y
            less += x < y
    return likely(more, less, n_left[:, None], n_right[None, :], cut)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, exactly."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh_value = np.ones(len(values), dtype=bool)
    fresh_value[1:] = values[1:] != values[:-1]
    number = np.cumsum(fresh_value) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum(fresh_value & shared)[shared] - 1
    both = np.zeros((len(sets), len(sets)), dtype=np.int64)
    step = 4096
    edges = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + step + 1, step))
    for a, b in zip(edges[:-1], edges[1:]):
        held = np.zeros((len(sets), step), dtype=np.float32)
        held[owner[a:b], number[a:b] % step] = 1
        both += (held @ held.T).astype(np.int64)
    hit = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(hit, False)
    return hit


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices, the least vertex that the edges a - b lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        lower = label.copy()
        np.minimum.at(lower, a, least)
        np.minimum.at(lower, b, least)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows of equal keys of a sorted partition, one group at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-2]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


EDGE = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _edges(rows: DataFrame, keys: list[str], compare: Callable[[pa.Table], list[tuple[bytes, bytes]]], within: tuple[str, ...] = ()) -> DataFrame:
    """The edges that ``compare`` finds in each group of rows of equal keys, which come in the order of ``within``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        for group in _groups(batches, keys):
            found += compare(group)
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=EDGE.names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=EDGE.names)

    dealt = rows.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *within)
    return dealt.mapInArrow(run, EDGE)


def _joined(group: pa.Table, hits: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[bytes, bytes]]:
    """Edges that join the parts of a pair of blocks which ``hits`` links.

    ``hits`` gets the rows of the first and of the second block (the same
    rows if there is but one) and gives the places of linked rows. An edge
    leads from a part to the least part that it is linked with, so other
    bands and blocks give the same edges.
    """
    block = group["block"].to_numpy()
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block == block.max())
    if len(first) == len(second) == 1 and first[0] == second[0] or group["left"][0].as_py() != group["right"][0].as_py() and block.min() == block.max():
        return []
    of = group["part"].to_pylist()
    parts = sorted(set(of))
    place = {p: i for i, p in enumerate(parts)}
    part = np.array([place[p] for p in of])
    a, b = hits(first, second)
    a, b = part[a], part[b]
    to = least_reachable(len(parts), a[a != b], b[a != b])
    return [(parts[i], parts[j]) for i, j in enumerate(to.tolist()) if i != j]


def _in_block_pairs(rows: DataFrame, keys: list[str], most: int, weight: Column | None = None, most_weight: int = 1) -> DataFrame:
    """Rows of groups (``keys``) that are still in several parts, once for each pair of blocks that has something to compare.

    A block has about ``most`` rows, and ``most_weight`` of ``weight``. A
    group that fits one block is one pair. In others the part with most rows
    has blocks of its own, which meet all the others but not each other.
    """
    per_part = rows.groupBy(*keys, "part").agg(F.count("*").alias("_rows"), F.sum(weight if weight is not None else F.lit(0)).alias("_weight"))
    blocks = lambda n, w: F.ceil(F.greatest(n / most, w / most_weight if weight is not None else F.lit(0.0))).cast("int")
    groups = (
        per_part.groupBy(*keys)
        .agg(F.count("*").alias("_parts"), F.sum("_rows").alias("_rows"), F.sum("_weight").alias("_weight"), F.max(F.struct("_rows", "_weight", "part")).alias("_main"))
        .filter(F.col("_parts") > 1)
        .withColumn("_one", blocks(F.col("_rows"), F.col("_weight")) <= 1)
        .select(
            *keys, F.col("_main.part").alias("_main"),
            F.when(F.col("_one"), 0).otherwise(blocks(F.col("_main._rows"), F.col("_main._weight"))).alias("_g"),
            F.when(F.col("_one"), 1).otherwise(blocks(F.col("_rows") - F.col("_main._rows"), F.col("_weight") - F.col("_main._weight"))).alias("_h"),
        )
    )
    at = rows.join(groups, keys).withColumn("_in", (F.col("part") == F.col("_main")) & (F.col("_g") > 0))
    own = F.when(F.col("_in"), F.pmod(F.xxhash64("cid"), F.col("_g"))).otherwise(F.col("_g") + F.pmod(F.xxhash64("cid"), F.col("_h"))).cast("int")
    at = at.withColumn("block", own).withColumn("_o", F.explode(F.sequence(F.when(F.col("_in"), F.col("_g")).otherwise(F.lit(0)), F.col("_g") + F.col("_h") - 1)))
    return at.withColumn("left", F.least("block", "_o")).withColumn("right", F.greatest("block", "_o")).drop("_main", "_g", "_h", "_in", "_o")


def _sketched(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, M)


def _likely_pairs(pairs: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """Those of the pairs (cid, pivot) whose sketches may reach the threshold, as edges a, b."""
    sketch = classes.select("cid", "n", "regs")
    both = pairs.join(sketch, "cid").join(sketch.select(F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("regs").alias("pivot_regs")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _sketched(batch["regs"]), _sketched(batch["pivot_regs"])
            n = [batch[c].to_numpy().astype(np.float64) for c in ("n", "pivot_n")]
            good = pa.array(likely((left > right).sum(axis=1), (left < right).sum(axis=1), *n, cut))
            yield pa.RecordBatch.from_arrays([batch["cid"].filter(good), batch["pivot"].filter(good)], names=EDGE.names)

    return both.select("cid", "pivot", "n", "regs", "pivot_n", "pivot_regs").mapInArrow(run, EDGE)


def _in_parts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``part``: the least class that ``edges`` lead to from the row's cid."""
    return rows.join(components(edges).select(F.col("v").alias("cid"), F.col("root").alias("part")), "cid", "left").withColumn("part", F.coalesce("part", "cid"))


def _pivot_edges(rows: DataFrame, classes: DataFrame, cut: float, rounds: int) -> DataFrame:
    """Likely pairs of each row's class (band, key, cid and size of the bucket) and its bucket's pivots."""
    degree = rows.groupBy("cid").agg(F.sum("size").alias("degree"))
    rows = rows.select("band", "key", "cid").join(degree, "cid").withColumn("part", F.col("cid")).withColumn("tried", F.lit(False))
    edges = None
    for again in range(rounds):
        # The class that meets most others, and hasn't been a pivot here, of each bucket in several parts.
        first = F.max_by(F.struct("cid", "part"), F.struct(~F.col("tried"), "degree", "cid"))
        pivots = rows.groupBy("band", "key").agg(first.alias("p"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter(F.col("lo") != F.col("hi"))
        rows = kept(rows.join(pivots.select("band", "key", F.col("p.cid").alias("pivot"), F.col("p.part").alias("pivot_part")), ["band", "key"]))
        pairs = rows.filter(F.col("part") != F.col("pivot_part")).select("cid", "pivot").distinct()
        found = _likely_pairs(pairs, classes, cut)
        edges = kept(found if edges is None else edges.unionByName(found).distinct())
        if again < rounds - 1:
            rows = _in_parts(rows.withColumn("tried", F.col("tried") | (F.col("cid") == F.col("pivot"))).drop("pivot", "pivot_part", "part"), edges)
    return edges


def candidates(classes: DataFrame, *, cut: float, small: int, rounds: int, block: int) -> DataFrame:
    """Edges a, b between classes that share a bucket and whose sketches may reach the threshold.

    All likely pairs of a bucket are connected by them, but most are not
    edges themselves: a family is the edges' connected component. Buckets of
    more than ``small`` classes go over ``rounds`` pivots first.
    """
    met = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = met.groupBy("band", "key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    members = kept(met.join(shared, ["band", "key"]))
    large = members.filter(F.col("size") > small)
    edges = _pivot_edges(large, classes, cut, rounds) if large.limit(1).count() else None
    rows = members.withColumn("part", F.col("cid")) if edges is None else _in_parts(members, edges)

    def compare(group: pa.Table) -> list[tuple[bytes, bytes]]:
        regs, n = _sketched(group["regs"]), group["n"].to_numpy().astype(np.float64)

        def hits(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = []
            for at in range(0, len(first), 256):
                own = first[at : at + 256]
                x, y = np.nonzero(may_reach(regs[own], regs[second], n[own], n[second], cut))
                found.append((own[x], second[y]))
            return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

        return _joined(group, hits)

    left = _in_block_pairs(rows.select("band", "key", "cid", "part"), ["band", "key"], block)
    rest = _edges(left.join(classes.select("cid", "n", "regs"), "cid"), ["band", "key", "left", "right"], compare)
    return kept((rest if edges is None else edges.unionByName(rest)).distinct())


def _sets(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    items, bounds = shingles(*buffers(column), width)
    return [items[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _pivot_links(edges: DataFrame, texts: DataFrame, width: int, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Those of the edges a, b whose sets are linked. A pivot's (b's) text goes once to each block of what it is compared with."""
    sizes = edges.join(texts.select(F.col("cid").alias("a"), "n"), "a").groupBy("b").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    pivots = kept(sizes.select(F.col("b").alias("pivot"), F.ceil(F.greatest(F.col("rows") / block, F.col("n") / block_shingles)).cast("int").alias("g")))
    others = edges.select(F.col("a").alias("cid"), F.col("b").alias("pivot")).join(pivots, "pivot").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int"))
    shown = pivots.select("pivot", F.col("pivot").alias("cid"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("block"))
    rows = others.select("pivot", "block", "cid", F.lit(1).alias("side")).unionByName(shown.withColumn("side", F.lit(0)).select("pivot", "block", "cid", "side"))

    def compare(group: pa.Table) -> list[tuple[bytes, bytes]]:
        pivot, *rest = _sets(group["text"], width)
        ids = group["cid"].to_pylist()
        found = []
        for cid, own in zip(ids[1:], rest):
            both = int((pivot[np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)] == own).sum())
            if 100 * both >= percent * (len(pivot) + len(own) - both):
                found.append((cid, ids[0]))
        return found

    return kept(_edges(rows.join(texts.select("cid", "text"), "cid"), ["pivot", "block"], compare, within=("side",)))


def links(edges: DataFrame, texts: DataFrame, *, width: int, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Edges between classes whose sets are linked; their components are those of all links inside the families.

    ``texts`` has cid, family, size (of the family), weight (its shingles), n
    (shingles of the set) and text. In families beyond one block the
    candidate ``edges`` themselves are compared first.
    """
    large = texts.filter((F.col("size") > block) | (F.col("weight") > block_shingles)).select("cid", "n", "text")
    rows, found = texts.select("cid", "family", "n"), None
    if large.limit(1).count():
        own = edges.join(large.select(F.col("cid").alias("a")), "a", "left_semi")
        found = _pivot_links(own, large, width, percent, block, block_shingles)
    rows = rows.withColumn("part", F.col("cid")) if found is None else _in_parts(rows, found)
    left = _in_block_pairs(rows, ["family"], block, F.col("n"), block_shingles)

    def compare(group: pa.Table) -> list[tuple[bytes, bytes]]:
        return _joined(group, lambda first, second: np.nonzero(linked(_sets(group["text"], width), percent)))

    rest = _edges(left.join(texts.select("cid", "text"), "cid"), ["family", "left", "right"], compare)
    return (rest if found is None else found.unionByName(rest)).distinct()


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles, cid (null without shingles), regs and bands of each document."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType())]
    schema = T.StructType([*fields, T.StructField("cid", T.BinaryType()), T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in byte_slices(batch.column(2), SLICE_BYTES):
                items, bounds = shingles(*buffers(batch.column(2).slice(at, to - at)), width)
                n = np.diff(bounds)
                regs = registers(items, bounds)
                cids = [c if k else None for c, k in zip(signatures(items, bounds), n)]
                raw = regs.tobytes()
                lists = pa.ListArray.from_arrays(np.arange(0, (to - at + 1) * (M // BAND), M // BAND, dtype=np.int32), pa.array(regs.view(np.int64).ravel()))
                arrays = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n), pa.array(cids, pa.binary()), pa.array([raw[2 * M * i : 2 * M * (i + 1)] for i in range(to - at)], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document, and text_key (a hash of the text).

    A null or empty text has no shingles and is its own component; rows with
    a null id never are a component's id unless it has no other (null then,
    and kept is false). Repeated rows are linked like other equal texts, and
    rows equal in id too are kept alike. Other columns are left out.
    """
    sketched = kept(sketches(docs, id_col=id_col, text_col=text_col, width=width))
    classes = sketched.filter(F.col("cid").isNotNull()).groupBy("cid").agg(
        F.min("doc_id").alias("min_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"),
        F.min_by(F.struct("doc_id", "text_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("one"), F.first("regs").alias("regs"), F.first("bands").alias("bands"),
    )
    classes = kept(classes)
    edges = candidates(classes, cut=CUT, small=SMALL_BUCKET, rounds=PIVOT_ROUNDS, block=SKETCH_BLOCK)
    families = components(edges)
    wanted = families.join(classes.select(F.col("cid").alias("v"), "one", "n"), "v")
    wanted = wanted.join(wanted.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "root")
    wanted = wanted.select(F.col("v").alias("cid"), F.col("root").alias("family"), "size", "weight", "n", F.coalesce(F.col("one.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("one.text_key").alias("_key"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    whole = kept(texts.join(wanted, ["_id", "_key"]).select("cid", "family", "size", "weight", "n", "text").dropDuplicates(["cid"]))
    parts = components(links(edges, whole, width=width, percent=percent, block=TEXT_BLOCK, block_shingles=TEXT_BLOCK_SHINGLES))
    joined = classes.select("cid", "min_id", "n_rows").join(parts.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = joined.groupBy("root").agg(F.min("min_id").alias("component"), F.sum("n_rows").alias("n_docs"))
    # Only classes of more than one document need a look-up; the others are their own component.
    found = joined.join(ids, "root").filter(F.col("n_docs") > 1).select("cid", "component")
    out = sketched.join(found, "cid", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all columns stay, whatever they are called.

    Rows that are equal in id and text are one document. Rows without an id
    go if a row with an id is in their group, and stay otherwise.
    """
    key, lost_id, lost_key = fresh(docs.columns, "text_key", "lost_id", "lost_key")
    found = kept(near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, percent=percent))
    lost = found.filter(~F.col("kept") & F.col("component_id").isNotNull()).select(F.col("doc_id").alias(lost_id), F.col("text_key").alias(lost_key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rest = keyed.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col(lost_id)) & (F.col(key) == F.col(lost_key)), "left_anti")
    repeated = found.filter(F.col("kept")).groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    if repeated:
        rest = rest.filter(F.col(f"`{id_col}`").isNull()).unionByName(rest.filter(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, key]))
    return rest.drop(key)
