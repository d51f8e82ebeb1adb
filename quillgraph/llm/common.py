"""What the text operators share: tables, the shared folder, words, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other bytes than ASCII white space; ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The words of ``text``, A-Z lowered, as a DuckDB list.
WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (as in tests on one machine) a temporary folder is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Spark hand Python workers at most ``most`` bytes at once (64 MB by default, of which each side holds copies).

    Results don't depend on it. A smaller setting of the session's is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if now < 1 or now > most:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _STORED.append(path)
    return out


_STORED: list[str] = []  # what this process has stored, in order


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored on the way are deleted."""
    mark = len(_STORED)
    out = stored(make(), name)
    _delete(out.sparkSession, *[p for p in _STORED[mark:] if p != out.stored_at])
    _STORED[mark:] = [out.stored_at]
    return out


def told_apart(df: DataFrame, key: str, other: str) -> DataFrame:
    """``df`` with ``key``, a 64-bit hash, changed where unlike values share it, as ``other``, a second hash, tells.

    Among 10^10 values a few keys are shared by chance; their number is about the square of that by 2^65, so they may be
    broadcast. ``other`` is dropped.
    """
    shared = df.groupBy(key).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo <> hi").select(F.col(key).alias("__shared"))
    shared = stored(shared, "shared-keys")
    if shared.isEmpty():
        return df.drop(other)
    out = df.join(F.broadcast(shared), F.col(key) == F.col("__shared"), "left")
    return out.withColumn(key, F.when(F.col("__shared").isNotNull(), F.xxhash64(key, other)).otherwise(F.col(key))).drop("__shared", other)


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no plan needs any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def returning(work: Callable) -> Callable:
    """``work`` over a partition's batches; then what it has freed goes back to the system.

    Python workers live on from task to task, and without this each keeps the most it ever held.
    """

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def word_count(text: str) -> F.Column:
    """Number of words of a text column (null: 0), without a Python worker."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60, most_hot: int = 20_000) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` -> ``(id, component)``, component being the least id.

    Alternates large-star and small-star steps, so paths of length L need O(log L) rounds. A node's neighbours are
    only aggregated (min) and joined back, never gathered in a list; every step is a table in the shared folder. What
    nodes of very many edges aggregate to is broadcast, so that their edges needn't meet in one task; a node counts as
    such from a share of all edges that at most ``most_hot`` nodes can have.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        hot = max(1000, -(-2 * n // most_hot))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        some = F.broadcast(low.where(F.col("n") >= hot).select(F.col("a").alias("__a"), F.col("m").alias("__m")))
        marked = both.join(some, F.col("a") == F.col("__a"), "left")
        linked = marked.where("__m IS NULL").select("a", "b").join(low.where(F.col("n") < hot).select("a", "m"), "a").unionByName(
            marked.where("__m IS NOT NULL").select("a", "b", F.col("__m").alias("m")))
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return stored(out.where("a <> b").distinct(), name)

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before, n = None, now.count()
    for _ in range(most_rounds):
        half = star(now, True, n)
        drop(now)
        now = star(half, False, n)
        drop(half)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        before, n = seen, seen[0]
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
