"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every source gets a share of the mix by water-filling: shares follow the weights, stop at ``most`` times the source's
size, and what is cut off is shared again by weight. Whole epochs of a source come first; what is left of its target is
filled in ascending order of exponential keys -ln(u) / quality weight, u being a hash of the document, by prefix sums of
sizes. A source of any size is handled: sizes are first summed in key buckets, and rows are only sorted within the one
bucket in which the target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``; weights repeat over sources by code point, null last.

    One row per source is all that is sorted in one place; documents never are.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("__rank", F.row_number().over(in_order) - 1).withColumn("__weight", weight).withColumn("__cap", F.lit(most) * F.col("source_size"))
    by_room = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    up_to, every = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = ranked.withColumns({
        "__caps": F.coalesce(F.sum("__cap").over(up_to), F.lit(0.0)),
        "__open": F.sum("__weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)),
        "__all": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    level = summed.withColumn("__level", (F.col("__all") - F.col("__caps")) / F.col("__open"))
    holds = level.withColumn("__level", F.min(F.when(F.col("__level") * F.col("__weight") <= F.col("__cap"), F.struct("__caps", "__level"))).over(every)["__level"])
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__weight"), F.col("__cap")))
    return holds.select("source", "source_size", target.alias("target"))


def decide(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", share: float = 1.5, most: float = 2.0, most_broadcast: int = 32 << 20) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source, ...)``: doc_id, size, source_size, target, taken and
    two hashes of the row (``__a``, ``__b``). Texts are scanned once and never shuffled. Sources' targets are broadcast if
    they take ``most_broadcast`` bytes at most, and joined by shuffle beyond.

    size: words of the text (null: 0). taken: words that the mix takes of the document, repeats counted; the document
    at which a target is reached gives the words still wanted, so every source meets its target to a word.
    ``quality(doc_id, weight)`` scales the keys (default 1); of several weights of a doc_id the largest counts.
    Sources may be null; documents without words take nothing; rows of one doc_id (or none) are told apart by their text
    and source and, if all is equal, by nothing, so which of them is taken doesn't matter. An empty table gives an empty result.
    """
    unit = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")).cast("binary"))
    uniform = (F.conv(F.substring(unit, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    slim = docs.select("doc_id", "source", common.word_count("text").alias("size"), uniform.alias("__unit"), *row_hashes())
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("__id")).agg(F.max("weight").alias("__quality"))
        slim = slim.join(best, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    else:
        slim = slim.withColumn("__quality", F.lit(1.0))
    slim = slim.withColumn("__key", -F.log("__unit") / F.coalesce(F.col("__quality"), F.lit(1.0)))
    sized = common.stored(slim.withColumn("__bucket", F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS).cast("int")).drop("__unit", "__quality"), "mix-sizes")

    buckets = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__size"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("__size").alias("source_size")), share, most)
    along = Window.partitionBy("source").orderBy("__bucket")
    ends = (
        buckets.withColumn("__before", F.coalesce(F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("__rest", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    )
    # a row a source: its target and the last bucket of which anything is taken beyond whole epochs
    last = F.max(F.when(F.col("__before") < F.col("__rest"), F.struct(F.col("__bucket").alias("bucket"), F.col("__before").alias("before"), F.col("__size").alias("size"))))
    state = common.stored(ends.groupBy(F.col("source").alias("__source")).agg(*[F.first(c).alias(c) for c in ("source_size", "target", "__epochs", "__rest")], last.alias("__last")), "mix-sources")
    bytes_ = state.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 100), F.lit(0))).first()[0]
    near = F.broadcast(state) if bytes_ <= most_broadcast else state
    joined = sized.join(near, F.col("source").eqNullSafe(F.col("__source")))
    at, end = F.col("__last.bucket"), F.col("__last.before") + F.col("__last.size")
    crosses = F.coalesce((F.col("__bucket") == at) & (F.col("__rest") < end), F.lit(False))
    whole = joined.where(~crosses).withColumn("taken", F.col("size") * (F.col("__epochs") + F.coalesce((F.col("__bucket") <= at).cast("long"), F.lit(0))))
    in_bucket = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "__a").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__last.before") - F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    cut = joined.where(crosses).withColumn("taken", F.col("size") * F.col("__epochs") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return whole.unionByName(cut).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "__a", "__b")


def row_hashes() -> list[Column]:
    """96 bits that identify a row by its doc_id, text and source."""
    return [F.xxhash64("doc_id", "text", "source").alias("__a"), F.hash("text", "source", "doc_id").alias("__b")]


def mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (see ``decide``); texts are shuffled once.

    Rows equal in doc_id, text and source share their decisions by number: such rows have few unlike ones, which are kept
    with the number of rows up to them. Extra columns are kept; of names that clash with added ones, the added column wins.
    """
    added = ["size", "source_size", "target", "taken"]
    made = decide(docs, quality, **options).groupBy("__a", "__b", *added).agg(F.count("*").alias("n"))
    made = made.groupBy("__a", "__b").agg(F.array_sort(F.collect_list(F.struct(*added, "n"))).alias("__made"))
    up_to = F.transform("__made", lambda x, i: F.struct(*[x[c].alias(c) for c in added], F.aggregate(F.slice("__made", F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, y: n + y["n"]).alias("up_to")))
    rows = docs.drop(*[c for c in added if c in docs.columns]).select("*", *row_hashes())
    nth = F.row_number().over(Window.partitionBy("__a", "__b").orderBy(F.lit(1)))
    out = rows.join(made.withColumn("__made", up_to), ["__a", "__b"]).withColumn("__nth", nth)
    out = out.withColumn("__one", F.get(F.filter("__made", lambda x: F.col("__nth") <= x["up_to"]), F.lit(0)))
    return out.select("*", *[F.col(f"__one.{c}").alias(c) for c in added]).drop("__a", "__b", "__made", "__nth", "__one")


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights from labels: 2 for good documents, 0.5 for poor ones; documents without a label count as 1."""
    return labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 2.0).otherwise(0.5)).alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = decide(docs, label_quality(common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "taken")
