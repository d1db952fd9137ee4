"""Labelled rows for models that are trained on the driver from a bounded sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.checkpoints import kept, released


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


#: Bytes of text that a sample holds at most, so that the driver's share is bounded whatever the texts' lengths; one text may take a sixteenth of it.
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, *, most: int, most_bytes: int = SAMPLE_BYTES, least_share: float = 0.35, seed: str = "sample", id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """At most ``most`` rows of text and y (0 or 1) in seeded order, for which ``usable`` (over the labels) holds.

    Rows of the rarer label fill up to ``least_share`` of the sample where
    there are so many. Rows without a label, and texts without a row in
    ``labels``, are left out; null texts are empty. An id counts once: with
    its commoner label (0 if both are as common) and one of its texts. Of the
    chosen rows those enter, in seeded order, that ``most_bytes`` of text
    still have room for.
    """
    rows = labels.filter(usable & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
    rows = rows.groupBy("_id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("_id").cast("string")))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    rare = min((0, 1), key=lambda y: counts.get(y, 0))
    n_rare = min(counts.get(rare, 0), int(most * least_share))
    if counts.get(1 - rare, 0) + n_rare < most:
        n_rare = min(counts.get(rare, 0), most - counts.get(1 - rare, 0))
    parts = [rows.filter(F.col("y") == y).withColumn("_o", order).orderBy("_o").limit(n) for y, n in ((rare, n_rare), (1 - rare, most - n_rare))]
    # At most ``most`` short rows, so it is safe to broadcast.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = texts.join(chosen, "_id").filter(F.octet_length("text") <= most_bytes // 16)
    # One row for each of the chosen ids, however often it stands in ``docs``.
    found = kept(found.groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.md5("text"))).alias("text"), F.first("_o").alias("_o"), F.first("y").alias("y")))
    left, inside = most_bytes, []
    for r in found.select("_o", F.octet_length("text").alias("n")).orderBy("_o").collect():
        if r["n"] <= left:
            left -= r["n"]
            inside.append(r["_o"])
    table = found.join(F.broadcast(docs.sparkSession.createDataFrame([(o,) for o in inside], "_o string")), "_o").select("_o", "text", "y").toArrow()
    released(found)
    return table.sort_by([("_o", "ascending"), ("text", "ascending")]).combine_chunks()
