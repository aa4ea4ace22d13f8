"""Mixing sources to target token shares by soft membership."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import encode
from corvane.session import materialize, ship

WORD = re.compile(r"\w+|[^\w\s]")


def _features(text: str, buckets: int) -> np.ndarray:
    """Counts of hashed words, dense over the buckets that occur: (bucket, count) columns."""
    ids = np.fromiter((zlib.crc32(w.encode()) % buckets for w in WORD.findall(text.lower())), np.int64)
    return np.stack(np.unique(ids, return_counts=True)) if len(ids) else np.zeros((2, 0), np.int64)


def mix(docs: DataFrame, targets: DataFrame, buckets: int = 1 << 13, trust: float = 0.95, steps: int = 24, bins: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses: doc_id, source, tokens, uses >= 1 of the drawn documents. shares: source, target_share,
    actual_share, tokens, documents.

    The labelled table trains a naive Bayes model of the sources over hashed words, counted over all documents; a
    document's membership is `trust` in its label and the rest in the model's posterior. Projected gradient steps fit a
    rate for each document between 0 and its source's max_repeats, so that the expected tokens of every source meet
    their targets in least squares: a step is one pass that sums expected tokens, and the rates follow from the list of
    past gradients, so no state is kept per document. A rate is rounded up or down by the hash of doc_id; a last shift
    per source, the weighted quantile that two passes find in histograms of `bins` cells, the second within a cell of
    the first, brings the tokens of its labelled documents as close under the target as one document allows.

    The whole is as large as all listed documents once, or less where a source at its cap can't fill its share. Sources
    without tokens are left out, and the other shares are scaled to a sum of 1. Null and empty texts have no tokens and
    are not drawn; rows with null doc_id or source, and sources that aren't listed, are left out; repeated rows of a
    doc_id count once; a null or negative max_repeats is 1. mix_targets is gathered; it has a row per source."""
    spark = docs.sparkSession
    ship(spark)
    listed = {r.source: (float(r.target_share or 0), max(1, int(r.max_repeats or 1))) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").toLocalIterator()}
    names = sorted(listed)
    place = {s: k for k, s in enumerate(names)}
    own = docs.where(F.col("source").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    counted = encode(own.groupBy("doc_id").agg(F.min(F.struct("source", "text")).alias("d")).select("doc_id", "d.*"), "text", "tokens", counts=True).where("tokens > 0")
    counted = materialize(counted, "mix-documents")

    def count(frames):
        total = np.zeros((len(names), buckets), np.int64)
        for f in frames:
            for s, t in zip(f["source"], f["text"]):
                b, c = _features(t, buckets)
                total[place[s], b] += c
        yield pd.DataFrame({"k": range(len(names)), "counts": list(total)})

    summed = np.zeros((len(names), buckets))
    for r in counted.select("source", "text").mapInPandas(count, "k int, counts array<long>").select("k", F.posexplode("counts").alias("b", "c")).where("c > 0").groupBy("k", "b").agg(F.sum("c").alias("c")).toLocalIterator():
        summed[r.k, r.b] = r.c
    model = np.log((summed + 0.5) / (summed + 0.5).sum(1, keepdims=True)).astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    def member(frames):
        for f in frames:
            rows = []
            for t in f["text"]:
                b, c = _features(t, buckets)
                x = shared.value[:, b] @ c
                x = np.exp((x - x.max()) / max(1.0, math.sqrt(c.sum())))
                rows.append(x / x.sum())
            p = np.array(rows) * (1 - trust)
            k = f["source"].map(place).to_numpy()
            p[np.arange(len(f)), k] += trust
            u = [xxhash.xxh64_intdigest(str(d)) / 2.0**64 for d in f["doc_id"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "k": k, "tokens": f["tokens"], "u": u, "p": list(p)})

    kind = counted.schema["doc_id"].dataType.simpleString()
    soft = materialize(counted.mapInPandas(member, f"doc_id {kind}, source string, k int, tokens int, u double, p array<double>"), "mix-members")
    have = np.zeros(len(names))
    for r in soft.groupBy("k").agg(F.sum("tokens").alias("t")).collect():
        have[r.k] = r.t
    share = np.array([listed[s][0] if h else 0.0 for s, h in zip(names, have)])
    share = share / share.sum() if share.sum() else share
    cap = np.array([listed[s][1] for s in names], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = min(have.sum(), np.nanmin(np.where(share > 0, have * cap / share, np.inf), initial=np.inf)) if share.sum() else 0.0
    goal = share * whole

    def rates(k: np.ndarray, p: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
        r, top = np.minimum(1.0, cap[k]), cap[k]
        for g in gradients:
            r = np.clip(r - p @ g, 0, top)
        return r

    def gather(run, schema, shape):
        """Sums of what `run` makes of every partition, by cell; as many rows as the array has cells, whatever the data."""
        out = np.zeros(shape)
        for r in soft.select("k", "tokens", "u", "p").mapInPandas(run, schema).groupBy(*(x.split()[0] for x in schema.split(", ")[:-1])).agg(F.sum("t").alias("t")).toLocalIterator():
            out[tuple(r)[:-1]] = r.t
        return out

    def expected(gradients):
        """Expected tokens by membership."""

        def run(frames):
            total = np.zeros(len(names))
            for f in frames:
                if len(f):
                    k, p, t = f["k"].to_numpy(), np.stack(f["p"]), f["tokens"].to_numpy(float)
                    total += (rates(k, p, gradients) * t) @ p
            yield pd.DataFrame({"k": range(len(names)), "t": total})

        return gather(run, "k int, t double", len(names))

    def tokens_by_shift(low, width):
        """Tokens of each label that join in each of `bins` steps of a shift. A document's j-th use joins at j - u - r."""

        def run(frames):
            total = np.zeros((len(names), bins + 1))
            for f in frames:
                if not len(f):
                    continue
                k, p, t = f["k"].to_numpy(), np.stack(f["p"]), f["tokens"].to_numpy(float)
                base = -f["u"].to_numpy() - rates(k, p, gradients)
                for j in range(1, int(cap.max()) + 1):
                    use = j <= cap[k]
                    at = np.clip(np.ceil((base[use] + j - low[k[use]]) / width[k[use]]), 0, bins).astype(int)
                    np.add.at(total, (k[use], at), t[use])
            k, b = np.nonzero(total)
            yield pd.DataFrame({"k": k, "b": b, "t": total[k, b]})

        return gather(run, "k int, b int, t double", (len(names), bins + 1))

    gradients: list[np.ndarray] = []
    for _ in range(steps if whole else 0):
        error = expected(gradients) - goal
        if np.all(np.abs(error) <= 1e-3 * np.maximum(goal, 1)):
            break
        gradients.append(np.where(goal > 0, error / np.maximum(have, 1), cap) * 0.8)
    low, width = -cap - 1, (2 * cap + 2) / bins
    for _ in range(2 if whole else 0):
        upto = tokens_by_shift(low, width).cumsum(1)  # at a shift of low + b * width
        last = np.maximum((upto <= goal[:, None]).sum(1) - 1, 0)
        low, width = low + last * width, width / bins

    def draw(frames):
        for f in frames:
            if len(f):
                k, p = f["k"].to_numpy(), np.stack(f["p"])
                r = np.clip(rates(k, p, gradients) + low[k], 0, cap[k])
                n = np.floor(r + f["u"].to_numpy()).clip(0, cap[k]).astype(int) * bool(whole)
                yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": f["tokens"], "uses": n})[n > 0]

    uses = soft.mapInPandas(draw, f"doc_id {kind}, source string, tokens int, uses int")
    got = uses.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"))
    total = got.agg(F.sum("tokens").alias("all"))
    shares = targets.where("source is not null").select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return uses, shares
