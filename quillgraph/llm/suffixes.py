"""Suffix-array dedup: removes every byte of a string of ``length`` bytes that also starts anywhere else.

Only suffixes at anchors are sorted: an anchor is a place whose k-gram has the least hash of some window of ``length``
bytes, so equal windows have equal anchors at equal places and no repeat is missed. Anchors whose k-gram occurs once are
dropped. The others' suffixes are sorted in runs, cut at common splitters, front-coded and exchanged, of places whose
surroundings a run holds several times only one; each range's runs are merged by a loser tree that keeps every contender's common prefix with the last winner, so known prefixes
are never compared again. Suffixes that share an anchor's k-gram come out side by side; which of their windows are
equal, to the left and right of the anchor, is then decided offset by offset.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM = 32  # bytes of an anchor's k-gram; windows are longer
RUN = 30_000  # suffixes of a run
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_SALT = _RNG.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    of, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(text: np.ndarray, length: int) -> np.ndarray:
    """Places whose k-gram's hash is the least of some window; ties count, so the choice rests on the window alone."""
    if len(text) < length:
        return np.empty(0, dtype=np.int64)
    h, span = _TABLE[text], 1
    while span < GRAM:
        h = h[:-span] * np.uint32(0x9E3779B1 + 2 * span) + h[span:]
        span *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    width = length - GRAM + 1
    low = _slide(h, width, True)
    pad = np.zeros(width - 1, dtype=np.uint32)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, False) == h)


def gram_keys(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the k-gram at each place, and its first 8 bytes as a number that sorts as they do."""
    grams = np.ascontiguousarray(text[at[:, None] + np.arange(GRAM)])
    words = grams.view("<u8").astype(np.uint64)
    key = np.zeros(len(at), dtype=np.uint64)
    for i in range(words.shape[1]):
        key = (key ^ words[:, i]) * _SALT[i]
        key ^= key >> np.uint64(29)
    head = grams.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(2**63)
    return key.view(np.int64), head.view(np.int64)


def front_code(rights: np.ndarray, right_len: np.ndarray, lefts: list[bytes], text: np.ndarray, pos: np.ndarray, times: np.ndarray) -> bytes:
    """A sorted run as bytes: for each suffix its common prefix with the one before and what follows it; ``times`` is the
    number of places (2: two or more) of the run with these surroundings that a suffix stands for."""
    same = np.zeros(len(rights), dtype=np.int64)
    if len(rights) > 1:
        differs = rights[1:] != rights[:-1]
        same[1:] = np.where(differs.any(1), differs.argmax(1), rights.shape[1])
        same[1:] = np.minimum(same[1:], np.minimum(right_len[1:], right_len[:-1]))
    rests = [r.tobytes()[s:n] for r, s, n in zip(rights, same.tolist(), right_len.tolist(), strict=True)]
    heads = struct.pack("<I", len(rests))
    columns = [same.astype("<u2"), right_len.astype("<u2"), np.array([len(x) for x in lefts], dtype="<u2"), text.astype("<i8"), pos.astype("<i8"), times.astype("<u2")]
    return b"".join([heads, *[c.tobytes() for c in columns], *rests, *lefts])


def decode(blob: bytes):
    """Suffixes of a run in order: (common prefix with the one before, right, left, text, place, times)."""
    (n,), at = struct.unpack_from("<I", blob), 4
    columns = []
    for kind, size in (("<u2", 2), ("<u2", 2), ("<u2", 2), ("<i8", 8), ("<i8", 8), ("<u2", 2)):
        columns.append(np.frombuffer(blob, dtype=kind, count=n, offset=at).tolist())
        at += n * size
    same, right_len, left_len, text, pos, times = columns
    left_at = at + sum(right_len) - sum(same)
    right = b""
    for i in range(n):
        more = right_len[i] - same[i]
        right = right[: same[i]] + blob[at : at + more]
        at += more
        yield same[i], right, blob[left_at : left_at + left_len[i]], text[i], pos[i], times[i]
        left_at += left_len[i]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be compared."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merge(blobs: list[bytes]):
    """Merged suffixes of sorted runs: (common prefix with the suffix before, right, left, text, place, times).

    A loser tree; a contender's known prefix is the one it shares with the last winner. Of two contenders with unequal
    known prefixes the longer wins unseen; equal ones are compared from there on, and the loser keeps what they share.
    """
    runs = [decode(b) for b in blobs]
    k = 1
    while k < len(runs):
        k *= 2
    now = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        shared = common_prefix(x[1], y[1], known[a])
        ahead = x[1][shared : shared + 1] <= y[1][shared : shared + 1]
        winner, loser = (a, b) if ahead else (b, a)
        known[loser] = shared
        return winner, loser

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while now[winner] is not None:
        x = now[winner]
        yield (known[winner], *x[1:])
        now[winner] = after = next(runs[winner], None)
        known[winner] = after[0] if after else 0
        node = (winner + k) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1


def covered(groups: np.ndarray, around: np.ndarray, left_len: np.ndarray, right_len: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of groups (equal, neighbouring numbers) that share an anchor: least and greatest offset of the anchor
    in a window that another member has too; -1 if none. All windows of an anchor overlap. A member stands for
    ``times`` places of equal surroundings; of several, every window repeats. ``around`` has a row of bytes for each
    member: what is left of the anchor, padded at its left, and the suffix, padded at its right."""
    m, reach = len(groups), length - GRAM

    def column(c: int) -> np.ndarray:
        return around[:, c].astype(np.uint64) * _SALT[c]

    h = np.zeros(m, dtype=np.uint64)
    for c in range(reach, reach + length):
        h += column(c)
    mark = groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[first, m])
    twos, many = first[sizes == 2], np.flatnonzero(np.repeat(sizes, sizes) > 2)
    low, high = np.full(m, -1), np.full(m, -1)
    for o in range(reach + 1):
        if o:
            h += column(reach - o)
            h -= column(reach + length - o)
        valid = (left_len >= o) & (right_len >= length - o)
        dup = np.zeros(m, dtype=bool)
        dup[twos] = (h[twos] == h[twos + 1]) & valid[twos] & valid[twos + 1]
        dup[twos + 1] = dup[twos]
        some = many[valid[many]]
        if len(some) > 1:
            full = h[some] ^ mark[some]
            order = np.argsort(full)
            same = full[order][1:] == full[order][:-1]
            dup[some[order]] = np.r_[False, same] | np.r_[same, False]
        dup |= valid & (times > 1)
        high[dup] = o
        low[dup & (low < 0)] = o
    return low, high


def repeats(docs: DataFrame, length: int = 200, per_range: int = 60_000) -> DataFrame:
    """Spans ``(text_key, start, end)`` of ``docs(text_key long, text)`` covered by repeated strings of ``length`` bytes.

    text_key identifies a text; equal texts are one text here (their caller knows that all of them repeats).
    """
    docs = docs.where(F.octet_length("text") >= length)
    kinds = "key long, head long, text_key long, pos long, state int"

    def place(batches):
        """Anchors with their k-gram's hash. Those that share it with another one nearby are known to stay (state 2); a
        single one must meet others (1), and of those known one more row tells the others so (0)."""
        met, rows, n = set(), [], 0

        def flush():
            key, head, text, pos = (np.concatenate([r[i] for r in rows]) for i in range(4))
            order = np.argsort(key, kind="stable")
            key, head, text, pos = key[order], head[order], text[order], pos[order]
            same = key[1:] == key[:-1]
            many = np.r_[False, same] | np.r_[same, False]
            tells = np.flatnonzero(np.r_[True, ~same] & many)
            at = np.r_[np.arange(len(key)), tells]
            state = np.r_[np.where(many, 2, 1), np.zeros(len(tells), dtype=np.int64)].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (key, head, text, pos)] + [pa.array(state)], names=["key", "head", "text_key", "pos", "state"])

        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t in met:  # a copy
                    continue
                met.add(t)
                raw = np.frombuffer(x.as_buffer(), dtype=np.uint8)
                every = anchors(raw, length)
                for i in range(0, len(every), RUN):
                    at = every[i : i + RUN]
                    rows.append((*gram_keys(raw, at), np.full(len(at), t, dtype=np.int64), at.astype(np.int64)))
                    n += len(at)
                    if n > 16 * RUN:
                        yield flush()
                        rows, n = [], 0
        if rows:
            yield flush()

    def shared(batches):
        held, matched = None, False
        out_of = lambda pdf: pdf.loc[pdf["state"] == 1, ["head", "text_key", "pos"]]
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k, t, p = (pdf[c].to_numpy() for c in ("key", "text_key", "pos"))
            new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])]
            if not new.all():
                pdf, k = pdf[new], k[new]
            same = k[1:] == k[:-1]
            out = np.r_[matched, same] | np.r_[same, False]
            yield out_of(pdf[:-1][out[:-1]])
            held, matched = pdf.iloc[-1:], bool(out[-1])
        if matched:
            yield out_of(held)

    places = common.stored(docs.mapInArrow(common.returning(place), kinds), "suffix-places")
    placed = places.where("state < 2").repartition("key").sortWithinPartitions("key", "text_key", "pos", "state")
    met = placed.mapInPandas(common.returning(shared), "head long, text_key long, pos long")
    held = common.stored(met.unionByName(places.where("state = 2").select("head", "text_key", "pos")), "suffix-anchors")
    common.drop(places)
    ranges = max(1, -(-held.count() // per_range))
    cuts = held.agg(F.percentile_approx("head", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts if ranges > 1 else [], dtype=np.int64))
    reach = length - GRAM

    def cut_runs(batches):
        rows: list[tuple] = []
        met, n, turn = set(), 0, 0

        def flush():
            """Runs by range, and the spans of places whose surroundings the run holds twice: of those, one goes on."""
            nonlocal turn
            rights, sizes, lefts, text, pos, head = (np.concatenate([r[i] for r in rows]) if i != 2 else [x for r in rows for x in r[2]] for i in range(6))
            marks: dict[bytes, int] = {}
            of = np.array([marks.setdefault(xxhash.xxh3_128_digest(left + right.tobytes(), seed=len(left) * 65536 + n), i) for i, (left, right, n) in enumerate(zip(lefts, rights, sizes.tolist(), strict=True))])
            times = np.minimum(np.bincount(of, minlength=len(of)), 2)
            left_len = np.array([len(x) for x in lefts], dtype=np.int64)
            twice = np.flatnonzero((times[of] > 1) & (left_len + sizes >= length))
            ready = np.concatenate([text[twice], (pos - left_len)[twice], (pos + sizes)[twice]]).astype("<i8").tobytes()
            keep = np.flatnonzero(of == np.arange(len(of)))
            order = keep[np.argsort(rights[keep].view(f"S{length}").ravel(), kind="stable")]
            part = np.searchsorted(cuts, head[order], side="right")
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            got = [(int(part[a]), front_code(rights[o], sizes[o], [lefts[i] for i in o], text[o], pos[o], times[o]), None) for a, b in zip(at[:-1], at[1:], strict=True) for o in [order[a:b]]]
            if ready:
                got.append((turn % (len(cuts) + 1), None, ready))  # dealt out, whatever their range
                turn += 1
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in got], pa.int32()), *(pa.array([g[i] for g in got], pa.binary()) for i in (1, 2))], names=["part", "run", "ready"])

        for batch in batches:
            for t, x, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if t in met:  # a copy of a text that has been handled
                    continue
                met.add(t)
                every = np.unique(places.values.to_numpy())
                raw = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8), np.zeros(length, dtype=np.uint8)])
                body = raw.tobytes()
                for i in range(0, len(every), RUN):
                    at = every[i : i + RUN]
                    head = raw[at[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(2**63)
                    rows.append((np.ascontiguousarray(raw[at[:, None] + np.arange(length)]), np.minimum(len(raw) - length - at, length), [body[max(0, p - reach) : p] for p in at.tolist()], np.full(len(at), t), at, head.view(np.int64)))
                    n += len(at)
                    if n >= RUN:
                        yield flush()
                        n = 0
        if rows:
            yield flush()

    wanted = held.groupBy(F.col("text_key").alias("__key")).agg(F.collect_list("pos").alias("places"))
    runs = docs.join(wanted, F.col("text_key") == F.col("__key")).select("text_key", "text", "places").mapInArrow(common.returning(cut_runs), "part int, run binary, ready binary")

    def merged(batches):
        def spans(blobs):
            group, last = 0, None
            own: dict[bytes, int] = {}  # 128-bit hashes of this group's unlike surroundings
            around = bytearray()  # of all members held, a row each
            groups, lefts, rights, times = array("q"), array("q"), array("q"), array("q")
            member, text, pos = array("q"), array("q"), array("q")
            width = reach + length

            def close():
                if len(member) and len(own) == 1 and times[-1] == 1:  # alone
                    for c in (groups, lefts, rights, times, member, text, pos):
                        c.pop()
                    del around[-width:]

            def found():
                whole = np.frombuffer(around, dtype=np.uint8).reshape(-1, width)
                low, high = covered(np.array(groups), whole, np.array(lefts), np.array(rights), np.array(times), length)
                at, place = np.array(member), np.array(pos)
                keep = high[at] >= 0
                out = (np.array(text)[keep], (place - high[at])[keep], (place - low[at] + length)[keep])
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["text_key", "start", "end"])

            for x in merge(blobs):
                if last is None or x[0] < GRAM:
                    close()
                    own.clear()
                    group += 1
                    if len(times) > 10_000 or len(member) > 500_000:
                        yield found()
                        around = bytearray()
                        for c in (groups, lefts, rights, times, member, text, pos):
                            del c[:]
                elif last[3:5] == x[3:5]:
                    continue
                last = x
                row = x[2].rjust(reach, b"\0") + x[1].ljust(length, b"\0")
                mark = xxhash.xxh3_128_digest(row, seed=len(x[2]) * 65536 + len(x[1]))
                at = own.get(mark)
                if at is None:
                    at = own[mark] = len(times)
                    around += row
                    for c, v in zip((groups, lefts, rights, times), (group, len(x[2]), len(x[1]), 0), strict=True):
                        c.append(v)
                times[at] += x[5]
                member.append(at)
                text.append(x[3])
                pos.append(x[4])
            close()
            if len(member):
                yield found()

        part, blobs = None, []
        for batch in batches:
            for p, b, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b is None:
                    text, start, end = np.frombuffer(r.as_buffer(), dtype="<i8").reshape(3, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (text, start, end)], names=["text_key", "start", "end"])
                    continue
                if p != part and blobs:
                    yield from spans(blobs)
                    blobs = []
                part = p
                blobs.append(b)
        if blobs:
            yield from spans(blobs)

    out = runs.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions("part").mapInArrow(common.returning(merged), "text_key long, start long, end long")
    out = common.stored(out, "suffix-spans")
    common.drop(held)
    return out


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) to ``docs(doc_id, text, ...)``.

    Texts are UTF-8 bytes, null being empty; matches never cross documents, and all copies of a repeated string go. Texts
    shorter than ``length`` stay whole. Rows are told apart by their texts alone: of equal texts of at least ``length``
    bytes nothing is left, whatever their doc_ids; nulls and repeats in other columns don't matter. An empty
    table gives an empty result. Other columns are carried along; of names that clash, the added column wins.
    """
    whole = F.coalesce("text", F.lit(""))
    keyed = common.told_apart(docs.withColumns({"__key": F.xxhash64(whole), "__other": F.xxhash64(F.lit(7), whole)}), "__key", "__other")
    slim = keyed.select(F.col("__key").alias("text_key"), "text")
    spans = repeats(slim, length).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    copies = keyed.where(F.octet_length("text") >= length).groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__key").alias("text_key"), F.lit(True).alias("copied"))
    known = spans.join(copies, "text_key", "full").withColumnsRenamed({"text_key": "__text", "spans": "__spans", "copied": "__copied"})
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(text: pd.Series, spans: pd.Series, copied: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, c in zip(text, spans, copied, strict=True):
            raw = (t or "").encode()
            kept, at, n = [], 0, 0
            for r in [{"start": 0, "end": len(raw)}] if c is True else s if s is not None else []:
                if r["start"] > at or not n:
                    kept.append(raw[at : r["start"]])
                    n += 1
                at = max(at, r["end"])
            left = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(left), n, left))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(known, F.col("__key") == F.col("__text"), "left")
    return joined.withColumn("__cut", cut("text", "__spans", "__copied")).select(*names, "__cut.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
m AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m),
g AS (SELECT doc_id, i, sum((p IS NULL OR i - p > 200)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o),
c AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS r FROM g GROUP BY doc_id, g),
v AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM c GROUP BY 1),
k AS (SELECT c.doc_id, a, coalesce(lag(b) OVER (PARTITION BY c.doc_id ORDER BY a), 0) AS from_, a AS to_ FROM c UNION ALL SELECT doc_id, 1000000000000, max(b), NULL FROM c GROUP BY 1),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (coalesce(to_, n) - from_)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(v.removed, 0)::BIGINT AS n_removed, coalesce(v.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN t USING (doc_id)
"""
