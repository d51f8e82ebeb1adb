"""N-gram Jaccard join with a count-vector R-tree, exact at any corpus size.

A document is the set of its word shingles (hashed to 64 bits). Shingles are hashed to coordinates; the counts make a
point, and the overlap of two documents is at most the sum of their coordinates' minima. R-trees over points bound that
sum from boxes, so only pairs that could reach the threshold are verified on the sets themselves.

A corpus doesn't fit one tree, so points first meet in blocks: sets at most D shingles apart that are split by hash into
more than D groups have an equal group, so blocks of equal groups lose no pair. Empty groups are equal in many unlike
sets; there are so many groups that sets which link have an equal one that isn't empty, and small sets meet by single
shingles. Near copies share most of their groups,
so blocks of the same members are one. Within a block a tree finds the pairs
whose bound passes; what they connect makes hulls, and each hull's sets are joined by a tree and verified. A hull or
block of any size is dealt out by pairs of chunks.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STEP = 1.6  # ratio of the size levels
SPARE = 2  # empty groups that a set may have before they count as groups, at least
FULL = 255  # coordinates are bytes; a full one bounds nothing
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, words: Words, size: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text: A-Z lowered, words between ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    x = h[: len(h) - size + 1] * _A
    for k in range(1, size):
        x = (x ^ (x >> np.uint64(31))) + h[k : len(h) - size + 1 + k]
        x = x * _C
    return np.unique(x ^ (x >> np.uint64(29)))


def apart(n: int, percent: int) -> int:
    """Most shingles in which a set of n and a larger one can differ: i + a + b = u, 100 i >= percent u, i <= n."""
    return n * (100 - percent) // percent


@cache
def spare(least: int, differ: int) -> int:
    """Empty groups that a set of ``least`` or more may have, above those that the hash leaves empty; SPARE if that takes more groups than shingles."""
    out = SPARE
    while (groups := differ + 1 + out) <= least:
        more = SPARE + int(1.3 * groups * math.exp(-least / groups))
        if more <= out:
            return out
        out = more
    return SPARE


def levels(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(level, groups, spare) under which a set of n shingles files itself: its own and all below that a set it may link with has."""
    tops = [16.0]
    while n >= tops[-1]:
        tops.append(tops[-1] * STEP)
    k = len(tops) - 1
    held = [k]
    while k and n * percent < tops[k - 1] * 100:
        k -= 1
        held.append(k)
    out = []
    for level in held:
        differ = apart(math.ceil(tops[level]) - 1, percent)
        empty = spare(math.ceil(tops[level - 1]), differ) if level else SPARE
        out.append((level, differ + 1 + empty, empty))
    return out


def signatures(x: np.ndarray, percent: int) -> np.ndarray:
    """A hash for each group of a set, by level; at the lowest level for each shingle. Sets too small to differ at all have none."""
    if apart(int(np.ceil(len(x) * 100 / percent)), percent) < 1:
        return np.empty(0, dtype=np.int64)
    out, inner = [], _mix(x)
    for level, groups, empty in levels(len(x), percent):
        if not level:  # sets that link share a shingle, and so small a set leaves too many groups empty
            out.append(_mix(inner + _B))
            continue
        g = ((_mix(x + np.uint64(level * int(_C) % 2**64)) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        order = np.argsort(g, kind="stable")
        g = g[order]
        at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        held, sums = g[at], np.add.reduceat(inner[order], at)
        if groups - len(held) > empty:
            held = np.r_[held, np.setdiff1d(np.arange(groups, dtype=np.uint64), held)]
            sums = np.r_[sums, np.zeros(len(held) - len(sums), dtype=np.uint64)]
        out.append(_mix(sums + held * _A + np.uint64((level + 1) * int(_B) % 2**64)))
    return np.concatenate(out).view(np.int64)


def dims_of(n: int) -> int:
    """Coordinates of a set of n: with n / 4 or so, unlike sets of any size stay apart."""
    return min(2048, 1 << max(5, ((n - 1) // 6).bit_length()))


def counts(x: np.ndarray) -> np.ndarray:
    dims = dims_of(len(x))
    return np.minimum(np.bincount((_mix(x + _A) % np.uint64(dims)).astype(np.int64), minlength=dims), FULL).astype(np.uint8)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of unlike dimensions (powers of 2) as rows of the least: coordinates that fall together are added."""
    dims = min(len(p) for p in points)
    full = [p.reshape(-1, dims) for p in points]
    return np.array([np.where((p == FULL).any(0), FULL, np.minimum(p.sum(0, dtype=np.int64), FULL)) for p in full], dtype=np.uint8)


class CountTree:
    """A packed R-tree over count vectors; ``near(q)`` gives the points whose overlap bound with point q passes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int, fan: int = 16):
        self.percent = percent
        sums, squares = points.sum(0, dtype=np.int64), np.einsum("ij,ij->j", points, points, dtype=np.int64)
        spread = (len(points) * squares - sums * sums).argsort()[::-1][:2]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (fan * fan)
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], slab)) if len(points) > fan else np.arange(len(points))
        self.points, self.sizes = points[self.order], sizes[self.order].astype(np.int64)
        self.tiers, high, least, fan_ = [], self.points, self.sizes, fan
        while len(high) > fan_:
            cut = np.arange(0, len(high), fan_)
            high, least = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut)
            self.tiers.append((high, least))
        self.fan = fan_

    def passes(self, q, n, high, least):
        both = np.minimum(high, q)
        return ((100 + self.percent) * both.sum(1, dtype=np.int64) >= self.percent * (n + least)) | (both == FULL).any(1)

    def near(self, point: np.ndarray, n: int) -> np.ndarray:
        at = None
        for high, least in self.tiers[::-1]:
            at = np.arange(len(high)) if at is None else at[at < len(high)]
            at = at[self.passes(point, n, high[at], least[at])]
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
        at = np.arange(len(self.points)) if at is None else at[at < len(self.points)]
        m = self.sizes[at]
        fits = (100 * np.minimum(m, n) >= self.percent * np.maximum(m, n)) & self.passes(point, n, self.points[at], m)
        return self.order[at[fits]]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """Each member with the least of its set, but for that one itself: short paths settle in fewer rounds."""
        return [(i, top) for i in range(len(self.up)) if (top := self.top(i)) != i]


def bound_links(points: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all points whose bounds pass (stars, not the passing pairs themselves)."""
    tree, sets = CountTree(points, sizes, percent), Union(len(points))
    for i in range(len(points)):
        for j in tree.near(points[i], int(sizes[i])).tolist():
            if j < i:
                sets.join(i, j)
    return sets.stars()


def true_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all sets that truly link (stars, as in ``bound_links``): candidates by the tree, verified on the sets."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    points = folded([counts(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tree, union = CountTree(points, sizes, percent), Union(len(sets))
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    for i in range(len(sets)):
        mine = flat[starts[i] : starts[i + 1]]
        near = [j for j in tree.near(points[i], int(sizes[i])).tolist() if j < i and union.top(j) != union.top(i)]
        if not near:
            continue
        mark[mine] = True
        for at in range(0, len(near), 512):
            js = near[at : at + 512]
            both = np.add.reduceat(mark[np.concatenate([flat[starts[j] : starts[j + 1]] for j in js])], np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
            for j, o in zip(js, both.tolist(), strict=True):
                if 100 * o >= percent * (int(sizes[i]) + int(sizes[j]) - o):
                    union.join(i, j)
        mark[mine] = False
    return union.stars()


def _runs(batches):
    """Batches sorted by their first column as tables that split no run of equal keys; small runs stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        other = np.flatnonzero(k != k[-1])
        at = int(other[-1]) + 1 if len(other) else 0
        if at or (held and held[-1].column(0)[0].as_py() != k[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, at)] if at else held).combine_chunks()
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])


def _dealt(df: DataFrame, key: str, member: str, chunk: int) -> DataFrame:
    """Deals groups of over ``chunk`` rows out by pairs of chunks, as ``__deal``, a hash of the key and the pair."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__m")).where(F.col("__m") > chunk)
    large = common.stored(sizes, "large-groups")
    if large.isEmpty():
        return df.withColumn("__deal", F.xxhash64(key))
    parts = F.ceil(F.coalesce("__m", F.lit(1)) / chunk).cast("int")
    joined = df.join(large, key, "left").withColumn("__c", parts).withColumn("__own", F.pmod(F.xxhash64(member, F.lit(3)), F.col("__c")))
    each = joined.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    return each.withColumn("__deal", F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other"))).drop("__m", "__c", "__own", "__other")


def join(docs: DataFrame, size: int = 3, percent: int = 90, chunk: int = 8000, most_broadcast: int = 400_000) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row.

    Two documents link when 100 x intersection >= percent x union of their shingle sets; component_id is the smallest
    doc_id that links reach. Null texts and texts without words have no shingles, link with nothing and keep their own
    doc_id. Equal sets are one node, so groups of copies cost one row. Rows with a null doc_id take part; a component of
    only such rows has a null id. Repeated doc_ids count as documents of their own. An empty table gives an empty result.
    Other columns are ignored.
    """
    return groups(docs, size, percent, chunk, most_broadcast).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, size: int = 3, percent: int = 90, chunk: int = 8000, most_broadcast: int = 400_000) -> DataFrame:
    """``join`` with ``text_hash``, which with doc_id identifies a row's text, and ``component_hash``.

    component_id and component_hash name the component's least row: by doc_id, nulls last, then by text_hash. Rows
    without shingles name themselves.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def describe(batches):
        words = Words()
        for batch in batches:
            n, node, sigs, vecs = [], [], [], []
            for t in batch.column(1):
                x = shingles(t.as_py(), words, size)
                n.append(len(x))
                node.append(xxhash.xxh3_64_intdigest(x.tobytes(), seed=len(x)) - 2**63)
                sigs.append(signatures(x, percent) if len(x) else np.empty(0, dtype=np.int64))
                vecs.append(counts(x).tobytes())
            at = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sigs) if sigs else [], pa.int64())), pa.array(vecs, pa.binary())],
                names=["doc_id", "text_hash", "n", "node", "sigs", "vec"])

    known = common.stored(docs.mapInArrow(common.returning(describe), "doc_id long, text_hash long, n long, node long, sigs array<long>, vec binary"), "jaccard-docs")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = common.stored(known.where("n > 0").groupBy("node").agg(F.min(row).alias("rep")), "jaccard-nodes")

    def shared(batches):
        """Blocks of two or more sets, named by a hash of their members, so that blocks of the same members become one;
        blocks of over ``chunk`` members go out as they come, named by their signature."""
        sig = node = np.empty(0, dtype=np.int64)  # of the block that is still open
        out = None  # the signature of an open block that is going out

        def closed(sig, node):
            at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            sizes = np.diff(np.r_[at, len(sig)])
            block = _mix(np.add.reduceat(_mix(node.view(np.uint64)), at) + sizes.astype(np.uint64) * _A)
            several = np.repeat(sizes > 1, sizes)
            return _batch(node=node[several], block=np.repeat(block.view(np.int64), sizes)[several])

        for batch in batches:
            sig, node = np.r_[sig, batch.column(1).to_numpy()], np.r_[node, batch.column(0).to_numpy()]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]  # copies have the same rows
            sig, node = sig[new], node[new]
            if out is not None and len(sig):
                n = int(np.argmax(np.r_[sig != out, True]))
                yield _batch(node=node[:n], block=sig[:n])
                sig, node, out = sig[n:], node[n:], out if n == len(sig) else None
            if not len(sig):
                continue
            other = np.flatnonzero(sig != sig[-1])
            at = int(other[-1]) + 1 if len(other) else 0
            if at:
                yield closed(sig[:at], node[:at])
            sig, node = sig[at:], node[at:]
            if len(sig) > chunk:
                yield _batch(node=node, block=sig)
                out, sig, node = sig[0], sig[:0], node[:0]
        if len(sig):
            yield closed(sig, node)

    rows = known.select("node", F.explode("sigs").alias("sig")).repartition("sig").sortWithinPartitions("sig", "node")
    members = common.stored(rows.mapInArrow(common.returning(shared), "node long, block long").distinct(), "jaccard-blocks")
    points = known.groupBy("node").agg(F.first("n").alias("n"), F.first("vec").alias("vec")).join(members.select("node").distinct(), "node", "left_semi")
    blocks = _dealt(members.join(points, "node"), "block", "node", 2 * chunk)

    def hull_links(batches):
        for t in _runs(batches):
            cuts, node, n = _starts(t["__deal"].to_numpy()), t["node"].to_numpy(), t["n"].to_numpy()
            vec = [np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in t["vec"]]
            dims, many, out = np.array([len(v) for v in vec]), np.diff(cuts), [(node[:0], node[:0])]
            two = cuts[:-1][many == 2]
            for d in np.unique(dims[two]):
                i = two[(dims[two] == d) & (dims[two + 1] == d)]
                if not len(i):
                    continue
                both = np.minimum(np.array([vec[j] for j in i]), np.array([vec[j + 1] for j in i]))
                ok = ((100 + percent) * both.sum(1, dtype=np.int64) >= percent * (n[i] + n[i + 1])) | (both == FULL).any(1)
                ok &= 100 * np.minimum(n[i], n[i + 1]) >= percent * np.maximum(n[i], n[i + 1])
                out.append((node[i[ok]], node[i[ok] + 1]))
            rest = (many > 2) | ((many == 2) & (dims[cuts[:-1]] != dims[np.minimum(cuts[:-1] + 1, len(dims) - 1)]))
            for a, b in zip(cuts[:-1][rest], cuts[1:][rest], strict=True):
                found = bound_links(folded(vec[a:b]), n[a:b], percent)
                if found:
                    x = np.array(found)
                    out.append((node[a:b][x[:, 0]], node[a:b][x[:, 1]]))
            pairs = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])], axis=1), axis=0)
            yield _batch(a=pairs[:, 0], b=pairs[:, 1])

    hull_edges = blocks.select("__deal", "node", "n", "vec").repartition("__deal").sortWithinPartitions("__deal").mapInArrow(common.returning(hull_links), "a long, b long")
    hulls = common.components(hull_edges.where("a <> b"), "jaccard-hulls").withColumnsRenamed({"id": "node", "component": "hull"})
    chosen = nodes.join(hulls, "node")  # a row a node, however many copies it has
    chosen = common.stored(chosen.select("node", "hull", F.col("rep.doc_id").alias("__id"), F.col("rep.text_hash").alias("__hash")), "jaccard-chosen")
    small = chosen.count() <= most_broadcast
    texts = docs.join(F.broadcast(chosen) if small else chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))

    def sets_of(batches):
        words, met = Words(), set()
        for batch in batches:
            node, sets = batch.column(1).to_pylist(), []
            for t, x in zip(batch.column(0), node, strict=True):
                found = shingles(t.as_py(), words, size) if x not in met else None  # of repeated rows, one will do
                if found is not None and xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)) - 2**63 != x:
                    found = None  # another text with this hash
                if found is not None:
                    met.add(x)
                sets.append(found)
            batch = batch.filter(pa.array([x is not None for x in sets], pa.bool_()))
            sets = [x for x in sets if x is not None]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))], names=["node", "hull", "set"])

    sets = texts.select("text", "node", "hull").mapInArrow(common.returning(sets_of), "node long, hull long, set array<long>")
    sets = common.stored(sets, "jaccard-sets")
    common.drop(members, chosen)
    dealt = _dealt(sets, "hull", "node", chunk)

    def links(batches):
        for t in _runs(batches):
            cuts, node, sets, left, right = _starts(t["__deal"].to_numpy()), t["node"].to_numpy(), t["set"], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    for i, j in true_links([x.values.to_numpy().view(np.uint64) for x in sets.slice(a, b - a)], percent):
                        left.append(node[a + i])
                        right.append(node[a + j])
            yield _batch(a=left, b=right)

    edges = dealt.select("__deal", "node", "set").repartition("__deal").sortWithinPartitions("__deal").mapInArrow(common.returning(links), "a long, b long")
    parts = common.components(edges, "jaccard-links")
    common.drop(sets)
    named = nodes.join(parts, nodes["node"] == parts["id"], "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    named = common.stored(named, "jaccard-named")
    least = named.groupBy("part").agg(F.min("rep").alias("__least"))
    of_node = named.join(least, "part").select(F.col("node").alias("__node"), "__least")
    return known.join(of_node, (F.col("node") == F.col("__node")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("__least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("__least.text_hash")).otherwise(F.col("text_hash")).alias("component_hash"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {common.WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2
"""
