"""A training corpus from raw documents: quality, lines, near-duplicates, mixture and packing.

Each stage takes all that its predecessor kept and returns the columns of
``documents`` (the last one returns packed pieces). A null text counts as an
empty one, null ids and sources are values like others, rows that repeat are
documents of their own, an empty table gives an empty one, and long texts are
taken whole. What a stage does with such rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import classifier, labelled, linededup, mixing, packing, setsketch, tokens
from brickyard.llm.names import fresh
from brickyard.checkpoints import kept

#: Most labelled documents that the quality classifier is fitted on.
SAMPLE_ROWS = 5000
#: Documents that score lower are rejected.
LEAST_QUALITY = 0.5
#: Lines in a larger share of a source's documents are dropped. Sources mix hosts and languages, so that boilerplate is in a few per cent.
MOST_LINE_SHARE = 0.02


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects; it is fitted on labels that aren't held out.

    Null and empty texts have the score of a text without words; equal texts
    have equal scores, so copies stay or go together. Without labels the
    classifier scores every text alike, at 0.5, and nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = labelled.remainder(F.col("doc_id"), 4) != 2
    table = labelled.sample(docs, labels, "quality", usable, most=SAMPLE_ROWS)
    model = classifier.fit(table.column("text").combine_chunks(), table.column("y").to_numpy())
    (score,) = fresh(docs.columns, "_score")
    scored = classifier.score(docs, model.scores, name=score, keep_text=True)
    return scored.filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that more than ``MOST_LINE_SHARE`` of a source's documents, and at least 5, hold.

    No document goes. A null text stays null, an empty one empty; documents
    without a source are one source; a document that would lose all its lines
    keeps them. ``n_chars`` follows the text where lines went.
    """
    found = linededup.drop_lines(docs, host_col="source", ratio=MOST_LINE_SHARE, least_pages=5)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest id.

    Documents without words are alike to nothing and all stay. Rows equal in
    id and text are one document. Rows without an id go if a row with an id
    is in their group, and stay otherwise.
    """
    return setsketch.drop_near_duplicates(docs, width=5, percent=75)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come to their target weights.

    A document stands in the result as often as the mix takes it, none above
    three times for each of its rows. Those without words have size 0 and are
    repeated like the others of their source. A null source is a source.
    """
    return mixing.sampled(docs, weights=(1, 2, 3), max_epochs=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of all documents into sequences of at most 2048.

    A null or empty text is the end token alone; copies are packed each.
    """
    pieces = packing.token_pieces(docs, path=tokens.tokenizer_path(), capacity=2048)
    return packing.pack_pieces(pieces, capacity=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("pack", pack)]

#: Trained models, sketches and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
