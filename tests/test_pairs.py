"""Pairs that are counted or verified without gathering what isn't asked for."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import topk
from quillgraph.operators import analysis


def test_mismatch_counts_are_those_of_the_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["", None, "A", "B", "C"]), rng.choice(["x-1", "X1", "none", "", None, "y", "z"])) for _ in range(300)]
    v = spark.createDataFrame([*rows, (900, "A", "alone")], "id long, parent string, literal string")
    want = analysis.enum_mismatches(v).groupBy("norm").agg(F.count("*").alias("pairs"))
    got = analysis.enum_mismatch_counts(v)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_mismatches_of_a_frequent_literal_are_counted(spark):
    n = 200_000  # 16 billion pairs
    v = spark.range(n).select("id", F.concat(F.lit("p"), F.col("id") % 5).alias("parent"), F.lit("common").alias("literal"))
    assert [tuple(r) for r in analysis.enum_mismatch_counts(v).collect()] == [("common", n * (n - 1) // 2 - 5 * (n // 5) * (n // 5 - 1) // 2)]


def test_near_paths_with_runs_and_shifts_by_brute_force(spark):
    rng = random.Random(7)
    rows = sorted({"/" + "".join(rng.choices("aab/", k=rng.randint(5, 14))) for _ in range(260)} | {"/a" + "a" * n + "/b" for n in range(6, 14)} | {"/v1/é/abcdef", "/v1/e/abcdef", "/v1/abcdef"})
    rows = [p for p in rows if len([s for s in p.split("/") if s]) >= 2]

    def distance(a, b):
        p, q = a.encode(), b.encode()
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(q, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    df = spark.createDataFrame([(p, f"f{i}") for i, p in enumerate(rows)], "path string, file string")
    far = {(a, b): distance(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if abs(len(a.encode()) - len(b.encode())) * 5 <= max(len(a.encode()), len(b.encode()))}
    for most in (1, 2, 3):
        want = {(a, b, d) for (a, b), d in far.items() if 1 <= d <= most}
        got = [tuple(r) for r in analysis.near_paths(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_forms_of_near_paths_are_not_broadcast(spark):
    rows = [(f"/en/{n}", f"f{n}") for n in range(1000, 1200)]
    near = analysis.near_paths(spark.createDataFrame(rows, "path string, file string"))
    assert near.count() > 200
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key#" not in plan and "SortMergeJoin [key#" in plan


def test_a_shard_answers_queries_together_and_leaves_low_blocks_alone():
    rng = np.random.default_rng(5)
    words = [np.concatenate([rng.integers(0, 40, rng.integers(1, 60)), rng.integers(100, 4000, 5)]) for _ in range(1000)]
    words[70] = words[71] = np.arange(40)
    made = topk.build(list(range(1000)), words)
    shard = topk.Shard({c: made[c].astype(topk.KINDS[c]).tobytes() for c in topk.COLUMNS}, 30.0)
    assert len(shard.rows[0]) > 30
    asks = [(np.unique(np.append(w, 9999)), rng.random(len(np.unique(w)) + 1)) for w in (*words[:20], np.arange(40), np.array([5000]))]

    def plain(terms, idf, k, floor):
        score = np.zeros(1000)
        for t, g in zip(terms.tolist(), idf.tolist(), strict=True):
            tf = np.array([(w == t).sum() for w in words])
            score += g * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * made["lengths"] / 30.0))
        score = np.round(score, 9)
        return [(d, score[d]) for d in np.lexsort((np.arange(1000), -score))[:k].tolist() if score[d] > 0 and score[d] >= floor]

    whole = shard.tops(topk.Asks(asks), 10, np.zeros(len(asks)))
    assert [[(d, round(s, 6)) for d, s in x] for x in whole] == [[(d, round(s, 6)) for d, s in plain(t, g, 10, 0)] for t, g in asks]
    floor = np.array([x[2][1] if len(x) > 2 else 0.0 for x in whole])
    assert shard.tops(topk.Asks(asks), 10, floor) == [[y for y in x if y[1] >= f] for x, f in zip(whole, floor.tolist(), strict=True)]
    query = (np.arange(40), np.ones(40))
    best = shard.top(*query, 2)
    shard.rows[15] = np.nan  # a block that the bound leaves out is never read
    shard.row_tops[:, 15] = 0
    assert shard.top(*query, 2, best[-1][1]) == best and {d for d, _ in best} == {70, 71}
