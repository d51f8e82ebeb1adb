"""Quality classifier: hierarchical empirical Bayes over document, host and path evidence.

A logistic regression on shape features gives each document's evidence. Sums of it by host (``source``) and by path
(``source`` and ``lang``) give posteriors of these sites; sparse sites are shrunk toward their host and hosts toward the
corpus, with strengths that the method of moments finds in the data. A document's posterior odds are its own odds times
the odds of its path (without the document itself) over those of the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
N_FEATURES = 10


def shape(text: str | None) -> list[float]:
    """Features of one text (null: empty), whole."""
    raw = (text or "").encode()
    n = len(raw) or 1
    words = raw.split()
    m = len(words) or 1
    unlike = set(words)
    lines = [x for x in raw.split(b"\n") if x]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(raw)),
        (len(raw) - len(raw.translate(None, UPPER))) / n,
        (len(raw) - len(raw.translate(None, SYMBOLS))) / m,
        (len(raw) - len(raw.translate(None, DIGITS))) / n,
        np.log1p(len(unlike)) / np.log1p(m),
        again / m,
        min(len(raw) / m, 40.0),
        raw.count(b" | ") / m,
        len(set(lines)) / max(1, len(lines)),
        raw.count(b"!!") / m,
    ]


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> dict:
    """Newton's method for logistic regression; with less than two classes the model says 0.5 for all."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w = np.zeros(1 + 2 * N_FEATURES)
    if len(set(y.tolist())) == 2:
        z, pull = expand(x, mean, scale), np.r_[1e-3, np.full(2 * N_FEATURES, l2)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
    return {"mean": mean, "scale": scale, "w": w}


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> dict:
    """Fit on at most about ``most`` labelled documents, taken by a hash of doc_id."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    every = max(1, -(-known.count() // most))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).withColumnRenamed("doc_id", "__id")  # about `most` rows
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("quality", "text")

    def features(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["quality"].astype("float64"), "x": [shape(t) for t in pdf["text"]]})

    got = rows.mapInPandas(features, "y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, got["y"].to_numpy()]) if len(got) else slice(None)  # the same sums whatever the partitions
    return fit(x[order], (got["y"].to_numpy(dtype=np.float64)[order] > 0).astype(float))


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``evidence``, the probability that a document is good by its own text."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        z = expand(np.array([shape(t) for t in text], dtype=np.float64).reshape(-1, N_FEATURES), model["mean"], model["scale"])
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ model["w"], -20, 20))))

    return docs.withColumn("evidence", score("text"))


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, most_labelled: int = 20_000, most_sites: int = 100_000) -> DataFrame:
    """Adds ``evidence``, ``host_posterior``, ``path_posterior``, ``quality`` (posterior) and ``keep`` to documents.

    Null sources and langs are sites of their own; null or empty texts are scored as empty. Repeated rows get equal
    scores. An empty table gives an empty result; without labels of both classes every document is kept. Texts are
    scored twice instead of being shuffled. Site posteriors are broadcast up to ``most_sites`` sites, joined by shuffle
    beyond.
    """
    model = train(docs, labels, most_labelled)
    scored = evidence(docs.select("source", "lang", "text"), model)
    sites = common.stored(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q")), "sites")
    hosts = sites.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    moments = lambda t, n, s: t.agg(F.count("*"), F.sum(n), F.sum(s), F.sum(F.col(s) * F.col(s) / F.col(n))).first()
    (k0, n0, s0, ss0), (k1, _, _, ss1), q = moments(hosts, "hn", "hs"), moments(sites, "n", "s"), sites.agg(F.sum("q")).first()[0]
    prior, host_rows, path_rows = 0.5, 1.0, 1.0
    if n0:
        prior = min(max(s0 / n0, 1e-4), 1 - 1e-4)
        within = max(q / n0 - prior * prior, 1e-9)
        rows = lambda groups, between: float(np.clip(prior * (1 - prior) / max(between - within * groups / n0, 1e-9) - 1, 1.0, 1e6))
        host_rows = rows(k0, ss0 / n0 - prior * prior)
        path_rows = rows(k1 - k0, (ss1 - ss0) / n0)
    sites = sites.withColumnsRenamed({"source": "__source", "lang": "__lang"}).join(
        hosts.withColumnRenamed("source", "__host"), F.col("__source").eqNullSafe(F.col("__host"))).drop("__host", "q")
    sites = sites.withColumnsRenamed({c: f"__{c}" for c in ("n", "s", "hn", "hs")})
    near = F.broadcast(sites) if k1 <= most_sites else sites
    out = evidence(docs, model).join(near, F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")))
    own = F.col("evidence")
    host = (F.col("__hs") - own + host_rows * prior) / (F.col("__hn") - 1 + host_rows)
    path = (F.col("__s") - own + path_rows * F.col("host_posterior")) / (F.col("__n") - 1 + path_rows)
    odds = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    out = out.withColumn("host_posterior", bound(host)).withColumn("path_posterior", bound(path))
    logit = odds(bound(own)) + odds(F.col("path_posterior")) - odds(F.lit(prior))
    out = out.withColumn("quality", 1 / (1 + F.exp(-logit)))
    keep = F.col("quality") >= keep_at if np.any(model["w"]) else F.lit(True)
    return out.withColumn("keep", keep).drop("__source", "__lang", "__n", "__s", "__hn", "__hs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = classify(docs, common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "quality")], "keep")
