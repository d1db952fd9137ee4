"""Mixing sources to target weights by capped water-filling.

Targets: a budget of words is shared by weight; a source whose share passes
its cap (a number of epochs of its own size) is clamped there and the excess
goes to the others by weight until none is above. With the sources sorted by
cap / weight this is one pass of prefix sums, so no loop is needed.

Sampling: each document is taken ``floor(target / size)`` times, and once
more while the seeded order of its source's documents fits into the
remaining words. That cut is found on sums of hash buckets; ids and sizes are
put in order only inside the one bucket of each source where the cut falls.
What is left then goes to the one other document whose size comes nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.checkpoints import kept
from .names import fresh
from .repeated import expanded

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that make a bucket: 16 ** 3 buckets for each source.
BUCKET_DIGITS = 3
#: Tables of one row for each source are broadcast up to this many sources; beyond it Spark chooses, and splits skewed joins.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the cycle's values by code point of ``source``, null last. One row per source is expected."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, *, budget: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` (double) to rows of source, source_size and weight.

    ``budget`` is an aggregate over the table (default: all sizes together).
    A source of size 0 gets 0. If the budget exceeds all caps, each source
    gets its cap. Null or non-positive weights count as 0 and get 0.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    rows = sources.withColumn("_w", weight).withColumn("_cap", F.when(F.col("_w") > 0, F.col("source_size") * max_epochs).otherwise(0))
    order = [F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(0.0)).asc(), F.col("source").asc_nulls_last()]
    everything = Window.partitionBy()
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = budget if budget is not None else F.sum("source_size")
    rows = (
        rows.withColumn("_total", total.over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(onwards))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    )
    level = F.max(F.when(F.col("_open") & (F.col("_w") > 0), F.col("_level"))).over(everything)
    shared = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap").cast("double")))
    return rows.withColumn("target", shared).select(*(F.col(f"`{c}`") for c in sources.columns), "target")


def repetitions(rows: DataFrame, targets: DataFrame, *, seed: str = "mix", max_epochs: int = 3) -> DataFrame:
    """Rows of doc_id, source, size and others, each distinct one once, with source_size, target, ``whole``, ``n`` and ``more``.

    Of the ``n`` equal rows, ``more`` are taken ``whole`` + 1 times and the
    others ``whole`` times. The order is md5 of the seed and the id, then the
    size, so a rerun takes the same documents. Rows equal in id and size are
    one in the search for the cut, however many they are.
    """
    others = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # A null source joins like any other value.
    source = [F.coalesce("source", F.lit("")).alias("_k"), F.col("source").isNull().alias("_n")]
    key = ["_k", "_n"]
    counted = kept(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).select("*", *source, h.alias("_h")).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS)))
    plan = targets.select(
        *source, "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    ).withColumn("_rest", F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = kept(plan)
    few = plan.count() <= BROADCAST_SOURCES
    per_source = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    words = F.col("size") * F.col("n")
    sums = counted.groupBy(*key, "_b").agg(F.sum(words).alias("_s"))
    upto = sums.withColumn("_upto", F.sum("_s").over(Window.partitionBy(*key).orderBy("_b")))
    # The cut: the first bucket whose end passes the rest; where none does, every row is before it.
    cut = (
        upto.join(per_source(plan), key)
        .filter(F.col("_upto") > F.col("_rest"))
        .groupBy(*key)
        .agg(F.min("_b").alias("_cut"), F.min_by(F.col("_upto") - F.col("_s"), "_b").alias("_before"), F.first("_rest").alias("_rest"))
    )
    at_cut = counted.join(per_source(cut), key).filter(F.col("_b") == F.col("_cut")).groupBy(*key, "_h", "size").agg(F.sum("n").alias("n"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    end = F.col("_before") + F.sum(words).over(Window.partitionBy(*key).orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = at_cut.withColumn("_end", end).filter(F.col("_end") > F.col("_rest")).groupBy(*key).agg(F.min(F.struct("_h", "size", "n", "_end", "_rest")).alias("c"))
    first = first.select(*key, F.struct("c._h", "c.size").alias("_at"), F.floor((F.col("c._rest") - F.col("c._end")) / F.col("c.size") + F.col("c.n")).alias("_some"))
    plan = kept(plan.join(first, key, "left"))
    place = F.struct("_h", "size")
    # How many of the rows equal in id and size are taken once more.
    more = F.when(F.col("whole") >= max_epochs, 0).when(F.col("_at").isNull() | (place < F.col("_at")), F.col("n")).when(place == F.col("_at"), F.col("_some")).otherwise(0)
    groups = kept(counted.groupBy(*key, "_h", "size").agg(F.sum("n").alias("n")).join(per_source(plan), key).withColumn("_more", more.cast("long")))
    left = groups.groupBy(*key).agg((F.first("_rest") - F.sum(F.col("size") * F.col("_more"))).alias("_left"))
    nearest = (
        groups.filter((F.col("_more") < F.col("n")) & (F.col("whole") < max_epochs))
        .join(per_source(left), key)
        .groupBy(*key)
        .agg(F.first("_left").alias("_left"), F.min(F.struct(F.abs(F.col("_left") - F.col("size")).alias("gap"), "_h", "size")).alias("_best"))
        .filter(F.col("_best.gap") < F.col("_left"))
        .select(*key, F.struct("_best._h", "_best.size").alias("_pick"))
    )
    plan = kept(plan.join(nearest, key, "left"))
    joined = counted.join(per_source(plan), key)
    special = F.coalesce(place == F.col("_at"), F.lit(False)) | F.coalesce(place == F.col("_pick"), F.lit(False))
    extra = F.coalesce((place == F.col("_pick")).cast("long"), F.lit(0))
    plain = joined.filter(~special).withColumn("more", F.when(F.col("whole") >= max_epochs, 0).when(F.col("_at").isNull() | (place < F.col("_at")), F.col("n")).otherwise(0).cast("long"))
    # Two groups of a source at most: their rows differ in other columns only.
    by_group = Window.partitionBy(*key, "_h", "size")
    inside = joined.filter(special).withColumn("_all", F.sum("n").over(by_group))
    wanted = F.when(F.col("whole") >= max_epochs, 0).when(place == F.col("_at"), F.col("_some")).when(F.col("_at").isNull() | (place < F.col("_at")), F.col("_all")).otherwise(0) + extra
    ordered = by_group.orderBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *(F.col(f"`{c}`") for c in others)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(ordered) - F.col("n")
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), wanted - before)).cast("long")).drop("_all")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return plain.unionByName(inside).select(*columns, "source_size", "target", F.col("whole").cast("long").alias("whole"), "n", "more")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"))
    rows = kept(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(cyclic_weights(sizes, weights), max_epochs=max_epochs)
    return repetitions(rows, targets, seed=seed, max_epochs=max_epochs)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times and taken.

    The budget is all words. A null or empty text has size 0 and takes 0; a
    null source is a source of its own, last in the order of weights.
    Repeated rows are documents of their own; further columns are left out.
    An empty table gives an empty result.
    """
    rows = _mixed(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    parts = F.array(F.struct("whole", (F.col("n") - F.col("more")).alias("copies")), F.struct((F.col("whole") + 1).alias("whole"), F.col("more").alias("copies")))
    each = rows.withColumn("part", F.explode(parts)).select("doc_id", "source", "size", "source_size", "target", F.col("part.whole").alias("times"), F.col("part.copies").alias("copies"))
    return expanded(each, "copies", "copy").drop("copy").withColumn("taken", F.col("times") * F.col("size"))


def sampled(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; all columns stay, whatever they are called.

    Rows equal in id, source and text are taken for one another.
    """
    text_key, copy, own_id, own_source, own_key, own_times = fresh(["doc_id", "source", "size", *docs.columns], "_text_key", "_copy", "_own_id", "_own_source", "_own_key", "_own_times")
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    keyed = docs.withColumn(text_key, key)
    narrow = keyed.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{source_col}`").alias("_s"), F.col(f"`{text_col}`").alias("_t"), F.col(text_key).alias("_text_key"))
    mixed = _mixed(narrow, weights, max_epochs, seed, "_i", "_t", "_s", keep=("_text_key",))
    taken = kept(mixed.select("doc_id", "source", "_text_key", (F.col("n") * F.col("whole") + F.col("more")).alias("_times"), F.col("n").alias("_rows")))
    if taken.filter("_rows > 1").limit(1).count():
        keyed = keyed.dropDuplicates([id_col, source_col, text_key])
    taken = taken.filter("_times > 0").select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("_text_key").alias(own_key), F.col("_times").alias(own_times))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & F.col(f"`{source_col}`").eqNullSafe(F.col(own_source)) & (F.col(text_key) == F.col(own_key))
    found = expanded(keyed.join(taken, same), own_times, copy)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
