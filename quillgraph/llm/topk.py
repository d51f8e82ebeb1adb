"""Exact top-k search: BM25 over an inverted index per shard, with block-max WAND pruning, merged exactly.

Shards are indexed once, into a table in the shared folder. Queries then run in blocks of bounded size: the counts of
their terms over all shards and the mean length give scores that don't depend on the shards, each shard returns its own
best k, and the best k of these are the answer. A sixteenth of the shards answers first; a query's k-th score there is
a floor for the others, which return nothing below it. Within a shard documents lie in blocks; a block's upper bound is the sum
of its terms' largest contributions (the WAND pivot test, made for all blocks at once), and blocks whose bound is below
the k-th score so far are never scored. Queries come to a shard several at once, so that a block's frequent terms are
read once for all queries that reach it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_DOCS, SHARD_BYTES = 8192, 48 << 20
DENSE = 0.04  # terms in more of a shard's documents than this are kept as rows
TOGETHER = 64  # queries whose frequent terms are worked out as one product
NO_ID = -(2**63)
COLUMNS = ("ids", "lengths", "terms", "starts", "docs", "tf")
KINDS = {"ids": "<i8", "lengths": "<i8", "terms": "<i8", "starts": "<i8", "docs": "<u2", "tf": "<u4"}


class Terms(dict):
    """64-bit hashes of terms, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) - 2**63
        return found


def terms_of(text: str | None, seen: Terms) -> np.ndarray:
    """Hashes of all words of a whole text: A-Z lowered, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))


def build(ids: list[int | None], words: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The inverted index of one shard: for each term, in order of its hash, documents and term counts."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate(words) if words else np.empty(0, dtype=np.int64)
    terms, at = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(at.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    starts = np.searchsorted(pair, np.arange(len(terms) + 1) * len(ids))
    return {"ids": np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), "lengths": lengths, "terms": terms, "starts": starts, "docs": pair % max(1, len(ids)), "tf": tf}


def index(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as a table of shards, a row each; nothing is shuffled."""

    def work(batches):
        seen, ids, words, held = Terms(), [], [], 0

        def out():
            made = build(ids, words)
            return pa.RecordBatch.from_arrays([pa.array([made[c].astype(KINDS[c]).tobytes()], pa.binary()) for c in COLUMNS], names=list(COLUMNS))

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                ids.append(i)
                words.append(terms_of(text, seen))
                held += len(text or "")
                if len(ids) == SHARD_DOCS or held > SHARD_BYTES:
                    yield out()
                    ids, words, held = [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, ", ".join(f"{c} binary" for c in COLUMNS))


class Shard:
    """A shard's index with contributions (without idf) worked out for a mean length."""

    def __init__(self, raw: dict[str, bytes], mean: float):
        a = {c: np.frombuffer(raw[c], dtype=KINDS[c]) for c in COLUMNS}
        self.ids, self.terms, self.starts, self.docs = a["ids"], a["terms"], a["starts"], a["docs"].astype(np.int64)
        tf = a["tf"].astype(np.float64)
        self.part = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * a["lengths"] / mean))[self.docs])
        self.blocks = -(-len(self.ids) // BLOCK)
        df = np.diff(self.starts)
        self.row_of = np.full(len(self.terms), -1, dtype=np.int64)
        often = np.flatnonzero(df > max(BLOCK, DENSE * len(self.ids)))
        self.row_of[often] = np.arange(len(often))
        self.rows = np.zeros((self.blocks, len(often), BLOCK))  # a block's rows lie together
        for r, t in enumerate(often.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            self.rows[self.docs[at] // BLOCK, r, self.docs[at] % BLOCK] = self.part[at]
        self.row_tops = self.rows.max(2).T if len(often) else np.zeros((0, self.blocks))

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> list[tuple[int, float]]:
        """As ``tops`` for one query."""
        return self.tops(Asks([(terms, idf)]), k, np.array([floor]))[0]

    def tops(self, asks: Asks, k: int, floor: np.ndarray) -> list[list[tuple[int, float]]]:
        """For each query the best k documents with a positive score of at least its ``floor``, by (score descending, doc_id): exact.

        What frequent terms give is worked out block by block, as one product for all queries whose bound reaches so far.
        Scores are rounded to 9 decimals, which hides the order of summation: copies tie wherever they are.
        """
        if not len(self.terms) or not len(asks.terms):
            return [[] for _ in asks.idf]
        at = np.searchsorted(self.terms, asks.terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == asks.terms
        weight = np.zeros((len(asks.idf), len(self.row_tops)))
        score = np.zeros((len(asks.idf), self.blocks, BLOCK))
        for q, (spots, idf) in enumerate(zip(asks.spots, asks.idf, strict=True)):
            found = here[spots]
            own, gain = at[spots[found]], idf[found]
            row = self.row_of[own]
            dense, sparse = row >= 0, row < 0
            weight[q, row[dense]] = gain[dense]
            begin, gain = self.starts[own[sparse]], gain[sparse]
            n = self.starts[own[sparse] + 1] - begin
            spot = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, dtype=np.int64)
            score[q] = np.bincount(self.docs[spot], weights=self.part[spot] * np.repeat(gain, n), minlength=self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        # bounds of blocks: what the rare terms give is known exactly, the others give their block's largest at most
        bound = (score.max(2) + weight @ self.row_tops) * (1 + 1e-12) + 1e-9
        known = np.zeros(bound.shape, dtype=bool)

        def add(alive: np.ndarray) -> None:
            for b in np.flatnonzero(alive.any(0)).tolist():
                who = np.flatnonzero(alive[:, b])
                score[who, b] += weight[who] @ self.rows[b]
            known[alive] = True

        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, : max(4, -(-2 * k // BLOCK))], True, 1)
        add(first & (bound >= floor[:, None]))
        least = floor.copy()
        for q in range(len(least)):
            got = score[q, known[q]].ravel()
            if len(got) >= k:
                least[q] = max(least[q], np.partition(got, -k)[-k])
        add((bound >= least[:, None]) & ~known)
        return [self._pick(score[q], known[q], k, floor[q]) for q in range(len(least))]

    def _pick(self, score: np.ndarray, known: np.ndarray, k: int, floor: float) -> list[tuple[int, float]]:
        docs = (np.flatnonzero(known)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        docs = docs[docs < len(self.ids)]
        got = score.ravel()[docs]
        if len(got) > k:
            near = got >= np.partition(got, -k)[-k] - 1e-8
            docs, got = docs[near], got[near]
        got = np.round(got, 9)
        fit = (got > 0) & (got >= floor)
        docs, got = docs[fit], got[fit]
        best = np.lexsort((self.ids[docs], -got))[:k]
        return list(zip(self.ids[docs[best]].tolist(), got[best].tolist(), strict=True))


class Asks:
    """Queries of terms and idf that shards answer together: all their terms in order, and where each query's are."""

    def __init__(self, asks: list[tuple[np.ndarray, np.ndarray]]):
        self.idf = [w for _, w in asks]
        self.terms, at = np.unique(np.concatenate([t for t, _ in asks]), return_inverse=True)
        self.spots = np.split(at.astype(np.int32), np.cumsum([len(w) for w in self.idf])[:-1])


def _best(spark: SparkSession, asks: list, floor: dict[int, float], mean: float, k: int):
    """A task's work: the best k of all its shards for each query of a block. The block's size is bounded by its terms."""
    parts = [asks[i : i + TOGETHER] for i in range(0, len(asks), TOGETHER)]
    shared = spark.sparkContext.broadcast([([(q, floor.get(q, 0.0)) for q, _, _ in part], Asks([(t, w) for _, t, w in part])) for part in parts])

    def work(batches):
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(j)[i].as_buffer() for j, c in enumerate(COLUMNS)}, mean)
                for part, several in shared.value:
                    floors = [max(least, -held[q][-1][0]) if len(held.get(q, [])) == k else least for q, least in part]
                    for (q, _), found in zip(part, shard.tops(several, k, np.array(floors)), strict=True):
                        if found:
                            held[q] = sorted([*held.get(q, []), *((-s, d) for d, s in found)])[:k]
        rows = [(q, None if d == NO_ID else d, -s) for q, own in held.items() for s, d in own]
        for at in range(0, len(rows), 50_000):
            q, d, s = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])

    return work


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = 1_000_000) -> DataFrame:
    """Best ``k`` of ``docs(doc_id, text)`` for each of ``queries(query_id, text)``: query_id, rank, doc_id, score.

    A query is the set of its whole text's terms. Documents that share no term with it aren't returned; ties go to the
    smaller doc_id (null first). Null and empty texts match nothing but count for the statistics. Of queries that share
    an id, equal ones are one and others are merged; a null query_id is one more id. Other columns are ignored. An empty table gives an empty result. Queries are dealt to blocks of about
    ``block_terms`` terms by a hash of their ids; a block is what tasks take along.
    """
    spark = docs.sparkSession
    shards = common.stored(index(docs), "topk-index")

    def terms(batches):
        seen = Terms()
        for batch in batches:
            got = [np.unique(terms_of(t.as_py(), seen)).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["query_id", "terms"])

    asked = queries.select(F.col("query_id").cast("long"), "text").mapInArrow(terms, "query_id long, terms array<long>")
    asked = common.stored(asked.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms")), "topk-queries")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n, words = 0, 0

    def size_of(batches):
        for batch in batches:
            for x in batch.column(0):
                length = np.frombuffer(x.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array([len(length)], pa.int64()), pa.array([int(length.sum())], pa.int64())], names=["n", "words"])

    sums = shards.select("lengths").mapInArrow(size_of, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    n, words = sums[0] or 0, sums[1] or 0
    mean = max(words / n, 1e-9) if n else 1.0
    schema = "query_id long, doc_id long, score double"
    parts = [spark.createDataFrame([], schema)]
    blocks = -(-n_terms // block_terms)
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        block = [(q, t.values.to_numpy()) for q, t in zip(got["query_id"].to_pylist(), got["terms"], strict=True) if len(t)]
        if not block:
            continue
        every = np.unique(np.concatenate([t for _, t in block]))

        def held(batches, every=every):
            total = np.zeros(len(every), dtype=np.int64)
            for batch in batches:
                for t, s in zip(batch.column(0), batch.column(1), strict=True):
                    own, df = np.frombuffer(t.as_buffer(), dtype="<i8"), np.diff(np.frombuffer(s.as_buffer(), dtype="<i8"))
                    at = np.searchsorted(own, every)
                    at[at == len(own)] = 0
                    total += np.where(own[at] == every, df[at], 0) if len(own) else 0
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "df"])

        df = np.zeros(len(every))
        counted = shards.select("terms", "starts").mapInArrow(held, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
        df[counted["at"].to_numpy()] = counted["df"].to_numpy()
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        asks = [(q, t, idf[np.searchsorted(every, t)]) for q, t in block]
        first = F.pmod(F.xxhash64("ids"), F.lit(16)) == 0
        ahead = common.stored(shards.where(first).select(*COLUMNS).mapInArrow(_best(spark, asks, {}, mean, k), schema), "topk-part")
        floors = ahead.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") == k).select("query_id", "score").collect()
        floor = {r["query_id"]: r["score"] for r in floors}
        parts += [ahead, common.stored(shards.where(~first).select(*COLUMNS).mapInArrow(_best(spark, asks, floor, mean, k), schema), "topk-part")]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


ORACLE = f"""
WITH d AS (SELECT doc_id, {common.WORDS_SQL} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS w FROM d), tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2),
z AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d), f AS (SELECT w, ln(1 + (z.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, z GROUP BY w, z.n),
g AS (SELECT tf.doc_id, tf.w, f.idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.w) / z.mean)) AS gain FROM tf JOIN f USING (w) JOIN d USING (doc_id), z),
s AS (SELECT q.doc_id AS query_id, g.doc_id, round(sum(g.gain), 9) AS score FROM (SELECT doc_id, w FROM tf WHERE doc_id % 100 = 0) q JOIN g USING (w) GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
