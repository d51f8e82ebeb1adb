"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Poor documents go; of near copies one document stays; long passages that repeat across documents are cut out; sources
are mixed to target weights, whole epochs as repeated rows; what is left is encoded as pieces. The text operators
themselves are general; the decisions are made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgraph.llm import common, jaccard, mixing, pieces, quality, suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MOST_BROADCAST = 1_000_000  # rows of 17 bytes that may be broadcast; beyond, texts are shuffled to them


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; columns and rows are otherwise left alone."""
    return quality.classify(docs, common.table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a shingle similarity of 0.8 or more (five words), the row with the least doc_id.

    Rows are told apart by doc_id and text, so null or repeated doc_ids with unlike texts all stay; nulls come last, and
    of one doc_id the least text hash first. Of rows equal in both, one stays. Texts without words link with nothing and stay.
    """
    groups = jaccard.groups(docs, size=5, percent=80).where("n_shingles > 0")
    least = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    texts = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__rows"), F.max(least).alias("__least"))
    marked = texts.where("NOT __least OR __rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__least")
    marked = common.stored(marked, "near-copies")  # only what doesn't simply stay
    near = F.broadcast(marked) if marked.count() <= MOST_BROADCAST else marked
    rows = docs.join(near, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = rows.where("__least").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__row")).select("doc_id", "text", "__row.*")
    return rows.where("__least IS NULL").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that also stand elsewhere; every document stays a row.

    A cut inside a character drops the rest of that character.
    """
    out = suffixes.dedup(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNull(), F.lit(None)).when(F.col("n_removed") == 0, F.col("text")).otherwise(whole_characters("kept"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@F.pandas_udf(StringType())
def whole_characters(kept):
    return kept.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole: the one at which a source meets its target is taken once
    more if that brings the source nearer to the target (half a document counts as nearer).
    """
    mixed = mixing.mix(docs, mixing.label_quality(common.table(spark, sf_dir, "labels")))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(1).cast("int")
    return mixed.withColumn("__time", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's whole text, with whether they decode to it."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables, and its input once it has been read, are deleted."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = common.settled(lambda stage=stage, before=before: stage(spark, before, sf_dir), f"pipeline-{name}")
        if hasattr(before, "stored_at"):
            common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
