"""Near-duplicate units by BagMinHash signatures, banding and exact verification."""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import batches, hash_tokens, mix
from corvane.session import materialize, ship

_U, _MASK = np.uint64, (1 << 64) - 1


def bags(texts: list[bytes], size: int = 3):
    """(document, shingle hash, multiplicity) of the bags of `size` successive tokens, sorted; tokens per document; and
    a 64-bit hash of each document's token sequence."""
    doc, h = hash_tokens(texts)
    n = len(texts)
    tokens = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(len(h)) - first[doc]
    place = mix(at.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(11))
    whole = np.zeros(n, _U)
    if len(h):
        s = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ place))])
        whole = mix(s[first[1:]] - s[first[:-1]] + tokens.astype(_U))
    keep = np.flatnonzero(at + size <= tokens[doc])
    g, d = np.zeros(len(keep), _U), doc[keep]
    for k in range(size):
        g = mix(g * _U(0xD6E8FEB86659FD93) + h[keep + k])
    key = np.sort((d.astype(_U) << _U(44)) | (g >> _U(20)))  # one sort of whole words: 2^20 documents, 44 bits of hash
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, weight = key[starts], np.diff(np.append(starts, len(key)))
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), weight, tokens, whole


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash: n x m registers; two bags agree in a register with the probability of their weighted Jaccard
    similarity.

    Weights are discretised at the powers of two: an element's weight w takes part in the levels (0,1], (1,2], (2,4] ...
    up to w. Every (element, level) has a Poisson process, seeded by both, whose points carry a time, a register and a
    height within the level; points over w are thinned out. A register keeps the least time. Points come in order of
    time, so a document stops at a horizon after which, but for a few documents that get a later one, no register is
    empty. An empty bag has registers of infinity."""
    out = np.full((n, m), np.inf)
    flat = out.reshape(-1)
    total = np.bincount(doc, weight, n)
    todo, c = np.flatnonzero(total > 0), log(m) + 2.5
    while len(todo):
        live = np.zeros(n, bool)
        live[todo] = True
        pick = np.flatnonzero(live[doc])
        horizon = np.zeros(n)
        horizon[todo] = c / total[todo]
        out[todo] = np.inf
        top = np.ceil(np.log2(np.maximum(weight[pick], 1))).astype(np.int64)
        at = np.repeat(pick, top + 1)  # an entry for every level of every element
        level = np.arange(len(at)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
        width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
        low = np.where(level > 0, width, 0)
        seed = mix(element[at] + level.astype(_U) * _U(0xA0761D6478BD642F))
        d, room, k = doc[at], (weight[at] - low) / width, 0
        t, h, rate = np.zeros(len(at)), horizon[d], m * width.astype(np.float64)
        while len(d):
            k += 1
            x = mix(seed + _U(k * 0x9E3779B97F4A7C15 & _MASK))
            t = t - np.log(((x >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
            on = np.flatnonzero(t <= h)
            if len(on) < len(d):
                d, seed, t, h, x, rate, room = d[on], seed[on], t[on], h[on], x[on], rate[on], room[on]
            y = mix(x ^ _U(0xE7037ED1A0B428DB))
            register = ((y >> _U(32)) * _U(m)) >> _U(32)
            ok = np.flatnonzero((y & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 <= room)  # its height is under the weight
            np.minimum.at(flat, d[ok] * m + register[ok].astype(np.int64), t[ok])
        todo = todo[np.isinf(out[todo]).any(1)]
        c *= 2
    return out


def jaccard(left: list[bytes], right: list[bytes], size: int = 3):
    """(set similarity, bag similarity) of each pair of texts; a text that recurs in the lists is tokenised once."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(t, len(ids)) for t in left), np.int64, len(left))
    b = np.fromiter((ids.setdefault(t, len(ids)) for t in right), np.int64, len(right))
    texts, grams = list(ids), []
    for i, j in batches(texts):
        d, g, w, _, _ = bags(texts[i:j], size)
        cut = np.searchsorted(d, np.arange(j - i + 1))
        grams += [(g[x:y], w[x:y]) for x, y in zip(cut, cut[1:])]
    sets, multi = np.zeros(len(a)), np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b)):
        (g, w), (h, v) = grams[x], grams[y]
        at = np.searchsorted(g, h)
        at[at == len(g)] = 0
        hit = g[at] == h if len(g) else np.zeros(len(h), bool)
        both, low = hit.sum(), np.minimum(w[at[hit]], v[hit]).sum()
        sets[k] = both / max(1, len(g) + len(h) - both)
        multi[k] = low / max(1, w.sum() + v.sum() - low)
    return sets, multi


def most_unequal(m: int, threshold: float, loss: float = 2e-5) -> int:
    """The number of bits in which two sets of similarity `threshold` differ at most, of m that agree as registers do or
    else by chance, but for a share `loss` of such pairs."""
    p, share = (1 - threshold) / 2, 1.0
    for k in range(m + 1):
        share -= comb(m, k) * p**k * (1 - p) ** (m - k)
        if share <= loss:
            return k
    return m


def near_duplicates(units: DataFrame, threshold: float = 0.7, least_tokens: int = 40, bands: int = 32, rows: int = 4, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the units with at least `least_tokens` tokens.

    members: evidence_id, file_version_id, unit_type, class_id; a class holds the units of one unit_type and token
    sequence. links: class_a < class_b, similarity, bag_similarity of the classes of one unit_type whose shingle sets
    have a Jaccard similarity of at least `threshold`.

    Each unit is read once: two signatures are banded in that pass, of the set (all weights 1) and of the bag, whose
    values are null where both agree. Classes, not copies, meet in bands, so a text that makes up a third of the rows is
    one row there. Two classes meet if they share two values at least and keep the size ratio that the threshold allows.
    Buckets have no cap; AQE splits hot ones. Met pairs are verified on whole texts. With p = s^rows a pair of set similarity s, whatever its bag similarity, is missed
    with a probability of at most (1-p)^bands + bands p (1-p)^(bands-1): 0.0017 at the threshold, 1e-6 at 0.8.

    Null content counts as empty; units with null evidence_id are left out; repeated rows count once; other columns are
    ignored."""
    spark = units.sparkSession
    ship(spark)
    m = bands * rows
    cols = ["evidence_id", "file_version_id", "unit_type"]
    src = units.where("evidence_id is not null").select(*cols, F.coalesce("content", F.lit("")).alias("content"))
    schema = "evidence_id string, file_version_id string, unit_type string, seq bigint, n int, bands array<int>, bits array<bigint>"
    words = m // 64

    def banded(sig):
        k, sig = len(sig), sig.view(_U).reshape(len(sig), bands, rows)
        band = np.zeros((k, bands), _U) + np.arange(bands, dtype=_U)
        for r in range(rows):
            band = mix(band * _U(0xD6E8FEB86659FD93) + sig[:, :, r])
        return (band >> _U(32)).astype(np.uint32).view(np.int32)

    def sketch(parts):
        for part in parts:
            texts = [x.encode() for x in part.column("content").to_pylist()]
            for i, j in batches(texts):
                doc, g, w, tokens, whole = bags(texts[i:j], size)
                enough = tokens >= max(least_tokens, size)
                use = enough[doc]
                number = np.bincount(doc[use], minlength=j - i)
                place = np.cumsum(enough) - 1
                doc, g, w = place[doc[use]], g[use], w[use]
                k = int(enough.sum())
                sig = signatures(doc, g, np.ones_like(w), k, m)
                band = banded(sig)
                bits = np.packbits((mix(sig.view(_U)) & _U(1)).astype(np.uint8)[:, : 64 * words], axis=1).view(np.int64)
                again = np.bincount(doc, w > 1, k) > 0  # elsewhere bag and set are one
                use = again[doc]
                bag = band.copy()
                bag[again] = banded(signatures((np.cumsum(again) - 1)[doc[use]], g[use], w[use], int(again.sum()), m))
                same = np.concatenate([np.zeros_like(band, bool), bag == band], 1)
                own = np.ones_like(same)
                own[:, bands:] = (bag != band).any(1, keepdims=True)
                ends = np.concatenate([[0], np.cumsum(own.sum(1))])
                p = part.slice(i, j - i).filter(pa.array(enough))
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), p.column(1), p.column(2), pa.array(whole[enough].view(np.int64)), pa.array(number[enough].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([band, bag], 1)[own], mask=same[own])),
                     pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * words, pa.int32()), pa.array(bits.ravel()))],
                    names=["evidence_id", "file_version_id", "unit_type", "seq", "n", "bands", "bits"],
                )

    sketched = materialize(src.mapInArrow(sketch, schema), "sketches")
    sketched = sketched.withColumn("class_id", F.xxhash64("unit_type", "seq", "n"))
    members = sketched.select(*cols, "class_id").distinct()
    classes = sketched.groupBy("class_id").agg(F.min_by(F.struct("evidence_id", "unit_type", "n", "bands", "bits"), "evidence_id").alias("c")).select("class_id", "c.*")
    classes = materialize(classes, "classes")
    met = classes.select("class_id", "n", "unit_type", *(F.col("bits")[i].alias(f"s{i}") for i in range(words)), F.posexplode("bands").alias("band", "value")).where("value is not null")
    met = met.select(F.xxhash64("unit_type", F.col("band") % bands, "value").alias("bucket"), "class_id", "n", *(f"s{i}" for i in range(words)))
    a, b = (met.toDF("bucket", f"class_{x}", f"n{x}", *(f"{x}{i}" for i in range(words))) for x in "ab")
    unlike = " + ".join(["0", *(f"bit_count(a{i} ^ b{i})" for i in range(words))])
    pairs = (
        a.join(b, "bucket").where("class_a < class_b and least(na, nb) >= %r * greatest(na, nb) and %s <= %d" % (threshold - 1e-9, unlike, most_unequal(64 * words, threshold)))
        .groupBy("class_a", "class_b").agg(F.count("*").alias("bands")).where("bands >= 2").select("class_a", "class_b")
    )
    pairs = materialize(pairs, "met")
    wanted = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct().join(classes.select("class_id", "evidence_id"), "class_id")
    texts = src.join(wanted, "evidence_id").groupBy("class_id").agg(F.first("content").alias("content"))
    texts = materialize(texts, "class-texts")

    @F.arrow_udf("struct<similarity:double,bag_similarity:double>")
    def verify(x, y):
        parts = [jaccard(*([t.encode() for t in c.slice(i, 256).to_pylist()] for c in (x, y)), size) for i in range(0, len(x), 256)]
        s, g = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
        return pa.StructArray.from_arrays([pa.array(s), pa.array(g)], ["similarity", "bag_similarity"])

    t = lambda k, v: texts.select(F.col("class_id").alias(k), F.col("content").alias(v))
    links = pairs.join(t("class_a", "x"), "class_a").join(t("class_b", "y"), "class_b").select("class_a", "class_b", verify("x", "y").alias("v"))
    links = materialize(links.where(F.col("v.similarity") >= threshold).select("class_a", "class_b", "v.*"), "links")
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(evidence_id_a < evidence_id_b): pairs of different file versions within a class or over a link."""
    again = members.groupBy("evidence_id").agg(F.count("*").alias("k")).where("k > 1").select("evidence_id", F.lit(True).alias("again"))
    m = members.join(again, "evidence_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    cols = [f"{c}_{s}" for s in "ab" for c in ("id", "fv", "again")]
    side = lambda s: m.select(F.col("class_id").alias(f"class_{s}"), F.col("evidence_id").alias(f"id_{s}"), F.col("file_version_id").alias(f"fv_{s}"), F.col("again").alias(f"again_{s}"))
    within = side("a").join(side("b").withColumnRenamed("class_b", "class_a"), "class_a").where("id_a < id_b")
    over = links.select("class_a", "class_b").join(side("a"), "class_a").join(side("b"), "class_b")
    both = within.select(*cols).unionByName(over.select(*cols)).where("fv_a <> fv_b")
    named = lambda df: df.select(F.least("id_a", "id_b").alias("evidence_id_a"), F.greatest("id_a", "id_b").alias("evidence_id_b"))
    return named(both.where("not (again_a or again_b)")).unionByName(named(both.where("again_a or again_b")).distinct())


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(evidence_id, file_version_id, unit_type, class_id, group_id, links): group_id is the least class_id of the
    connected classes; links counts the class's links. Units without a link form a group with their copies.

    Components by alternating large-star and small-star steps, each a shuffle of the links; they end when no link
    changes, after a number of rounds that grows with the logarithm of a component's length."""
    e = materialize(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")), "cc")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u")
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = materialize(nxt, "cc")
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            break
        e = nxt
    root = nxt.select(F.col("u").alias("class_id"), F.col("v").alias("root"))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(root, "class_id", "left").join(degree, "class_id", "left").select(
        "evidence_id", "file_version_id", "unit_type", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
