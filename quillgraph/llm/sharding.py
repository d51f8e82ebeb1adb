"""Sharding by histogram sort: near equal bytes in every shard.

Exact bytes below candidate key boundaries are counted across all partitions; candidates are refined until every
splitter meets the tolerance (or no key lies between its bounds), then rows are exchanged once. What the driver
sees are the sums between candidates, whose number depends on the shards alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_KEY = -(2**63)


def _packed(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys and ties as 12 bytes that sort as they do."""
    raw = np.empty((len(key), 12), dtype=np.uint8)
    raw[:, :8] = (key.astype(np.int64).view(np.uint64) ^ np.uint64(2**63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, 8:] = (tie.astype(np.int64) + 2**31).astype(">u4").view(np.uint8).reshape(-1, 4)
    return raw.view("S12").ravel()


def _edges(bounds: list[int]) -> np.ndarray:
    return np.array([x.to_bytes(12, "big") for x in bounds], dtype="S12")


def _histogram(keyed: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows below each bound (a key equal to the bound isn't below it)."""
    edges = _edges(bounds)

    def count(batches):
        size, rows = np.zeros(len(edges) + 1, dtype=np.int64), np.zeros(len(edges) + 1, dtype=np.int64)
        for pdf in batches:
            at = np.searchsorted(edges, _packed(pdf["key"].to_numpy(), pdf["tie"].to_numpy()), side="right")
            np.add.at(size, at, pdf["size"].to_numpy())
            np.add.at(rows, at, 1)
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"bin": some, "size": size[some], "n": rows[some]})

    size, rows = np.zeros(len(edges) + 1, dtype=np.int64), np.zeros(len(edges) + 1, dtype=np.int64)
    for b, s, n in keyed.mapInPandas(count, "bin long, size long, n long").groupBy("bin").agg(F.sum("size"), F.sum("n")).collect():
        size[b], rows[b] = s, n
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keyed: DataFrame, parts: int, tolerance: float, probes: int = 32) -> list[int]:
    """``parts - 1`` ascending places that cut ``keyed(key long, tie int, size long)`` into parts of near equal bytes.

    A place is a key and a tie as one number. A splitter is settled when the bytes below it are within ``tolerance`` of
    a part's size from its target, or when its bounds have nothing between them (then the nearer bound is taken).
    """
    low, high, total = keyed.agg(F.min(F.struct("key", "tie")), F.max(F.struct("key", "tie")), F.sum("size")).first()
    if low is None or parts < 2:
        return []
    number = lambda x: (x["key"] + 2**63) * 2**32 + x["tie"] + 2**31
    low, high = number(low), number(high)
    want = [total * i / parts for i in range(1, parts)]
    span = [[low, 0, min(high + 1, 2**96 - 1), total] for _ in want]
    open_, near = set(range(len(want))), tolerance * total / parts
    while open_:
        tried = sorted({lo + (hi - lo) * j // (probes + 1) for i in open_ for lo, _, hi, _ in [span[i]] for j in range(1, probes + 1)} - {low})
        below, _ = _histogram(keyed, tried) if tried else (np.array([]), None)
        for i in list(open_):
            s = span[i]
            k = int(np.searchsorted(below, want[i], side="left"))
            if k > 0 and tried[k - 1] > s[0]:
                s[0], s[1] = tried[k - 1], int(below[k - 1])
            if k < len(tried) and tried[k] < s[2]:
                s[2], s[3] = tried[k], int(below[k])
            if min(want[i] - s[1], s[3] - want[i]) <= near or s[2] - s[0] <= 1:
                open_.discard(i)
    return sorted(lo if w - b <= a - w else hi for w, (lo, b, hi, a) in zip(want, span, strict=True))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, rows_per_sort: int = 2_000_000, bytes_per_sort: int = 1 << 30) -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``shard`` and ``slot`` to ``docs(doc_id, text, ...)``; shards are ranges of doc_id.

    size is the text's UTF-8 bytes (null: none) plus 16. A null doc_id sorts first; rows of one doc_id are told apart by
    a hash of their texts, so one id may span shards and only rows equal in both stay together. Slots follow doc_id,
    then that hash, then the text's checksum. A shard of more than ``rows_per_sort`` rows or ``bytes_per_sort`` bytes is
    sorted in parts. An empty table gives an empty result.
    Extra columns are carried along; of names that clash with added ones, the added column wins.
    """
    spark = docs.sparkSession
    sized = docs.withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16,
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long"),
    })
    key, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY)), F.shiftright(F.xxhash64("text"), 32).cast("int")
    keyed = common.stored(sized.select(key.alias("key"), tie.alias("tie"), "size"), "shard-keys")
    rows, size = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1, -(-rows // (shards * rows_per_sort)), -(-size // (shards * bytes_per_sort)))
    cuts = splitters(keyed, shards * per_shard, tolerance)
    _, below = _histogram(keyed, cuts) if cuts else (None, np.array([], dtype=np.int64))
    starts = np.concatenate([[0], below]).astype(np.int64)
    base = starts - starts[(np.arange(len(starts)) // per_shard) * per_shard]
    edges = _edges(cuts)
    common.drop(keyed)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _packed(key.to_numpy(), tie.to_numpy()), side="right").astype(np.int32))

    offsets = spark.createDataFrame([(i, int(b)) for i, b in enumerate(base)], "__part int, __base long")
    in_part = Window.partitionBy("__part").orderBy(key, tie, "text_crc32", "size")
    return (
        sized.withColumn("__part", part_of(key, tie))
        .withColumn("__row", F.row_number().over(in_part))
        .join(F.broadcast(offsets), "__part")
        .withColumns({"shard": F.floor(F.col("__part") / per_shard).cast("int"), "slot": (F.col("__base") + F.col("__row") - 1).cast("long")})
        .drop("__part", "__row", "__base")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
