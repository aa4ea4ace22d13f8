"""Ranking operators: BM25, path and symbol scores, rank fusion, dense search, top-k. Every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import query_terms, retrieval_terms
from corvane.session import materialize


def ranked(df: DataFrame, by: list[str], order: list[Column], limit: int | None = None, out: str = "rank") -> DataFrame:
    """Adds 1-based ranks within `by`. Spark prunes each partition to `limit` before the shuffle."""
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return df if limit is None else df.where(F.col(out) <= limit)


def unit_vectors(units: DataFrame, vocabulary: DataFrame, key: str = "evidence", text: str = "content", most: int = 1_000_000) -> DataFrame:
    """(key, length, terms, tfs): the number of a unit's terms, and the counts of those in the vocabulary, by the 64-bit
    hashes of the terms, in order. Texts are read once and no term leaves its row, so nothing is shuffled. A vocabulary
    over `most` terms is not gathered; then all terms of the units are kept. Written once, as several steps read it."""
    import numpy as np
    import pyarrow as pa

    from corvane.session import ship

    spark = units.sparkSession
    ship(spark)
    words = [r.h for r in vocabulary.select(F.xxhash64("term").alias("h")).distinct().limit(most + 1).collect()]
    shared = spark.sparkContext.broadcast(np.sort(np.array(words, np.int64)) if len(words) <= most else None)
    rows = units.select(key, F.transform(retrieval_terms(F.col(text)), lambda w: F.xxhash64(w)).alias("t"))

    def count(batches):
        known = shared.value
        for batch in batches:
            t = batch.column(1)
            length = np.diff(t.offsets.to_numpy())
            flat, row = t.flatten().to_numpy(), np.repeat(np.arange(len(length)), length)
            if known is not None:
                at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
                keep = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                flat, row = flat[keep], row[keep]
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))) if len(flat) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(flat)))
            ends = pa.array(np.searchsorted(row[first], np.arange(len(length) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat[first], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], [key, "length", "terms", "tfs"])

    kind = units.schema[key].dataType.simpleString()
    return materialize(rows.mapInArrow(count, f"{key} {kind}, length int, terms array<bigint>, tfs array<int>"), "vectors")


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, terms: int = 12, block: int = 65_536, chunk: int = 500_000) -> DataFrame:
    """(query, key, score, rank): the `limit` best documents of each query.

    Queries are their `terms` longest distinct terms, as in the reference's index search. Texts are read and tokenised
    once. Score ties go by key.

    A common term pairs most queries with most documents, so these pairs are never rows: a task holds a block of
    queries, streams its share of the documents' term counts past them, and keeps each query's `limit` best."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.select(query, F.explode(query_terms(F.col(query_text), terms)).alias("term"))
    vectors = unit_vectors(docs, asked, key, text)
    spark = docs.sparkSession
    stats = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("mean")).head()
    vectors = _once(vectors, key)
    df = vectors.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = asked.select(query, F.xxhash64("term").alias("h")).join(df, "h").groupBy(query).agg(F.collect_list("h").alias("terms"), F.collect_list(idf).alias("idf"))
    own = materialize(own, "queries")
    blocks, groups = max(1, -(-own.count() // block)), max(spark.sparkContext.defaultParallelism, -(-stats["docs"] // chunk))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q_kind, r_kind = queries.schema[query].dataType, docs.schema[key].dataType
    none = lambda kind: F.lit(None).cast(kind)
    a = own.select(part(query, blocks).alias("b"), many(groups).alias("c"), F.lit(False).alias("is_row"), F.col(query).alias("q"), none(r_kind).alias("r"), none("int").alias("length"), "terms", "idf", none("array<int>").alias("tfs"))
    z = vectors.select(many(blocks).alias("b"), part(key, groups).alias("c"), F.lit(True).alias("is_row"), none(q_kind).alias("q"), F.col(key).alias("r"), "length", "terms", none("array<double>").alias("idf"), "tfs")
    both = a.unionByName(z).repartitionById(blocks * groups, F.col("b") * groups + F.col("c")).sortWithinPartitions("is_row", "r")
    types, mean = (to_arrow_type(q_kind), to_arrow_type(r_kind), pa.float64()), stats["mean"]

    def stream(batches):
        ids, wanted, weights, docs, held, keys, fresh = [], [], [], [], 0, [], []
        best = None

        def add():
            nonlocal best, docs, held
            if best is None:
                best = _Best(wanted, weights, limit, k1, b, mean)
            best.add(*(np.concatenate(x) for x in zip(*docs)))
            docs, held = [], 0

        for batch in batches:
            x = {n: batch.column(n) for n in ("is_row", "q", "r", "length", "terms", "idf", "tfs")}
            new = x["is_row"].false_count if len(batch) else 0
            if new:
                ids += x["q"].slice(0, new).to_pylist()
                wanted += [v.values.to_numpy() for v in x["terms"].slice(0, new)]
                weights += [v.values.to_numpy() for v in x["idf"].slice(0, new)]
            if new < len(batch) and ids:
                r, t, tf = (x[n].slice(new) for n in ("r", "terms", "tfs"))
                names = r.to_pylist()
                other = np.array([True, *(p != n for p, n in zip(names, names[1:]))])  # a repeated key is one document
                other[0] = not keys or keys[-1][-1].as_py() != names[0]
                if held > 4_000_000 and other[0]:
                    add()
                keys.append(r)
                fresh.append(other)
                docs.append((other, x["length"].slice(new).to_numpy(), np.diff(t.offsets.to_numpy()), t.flatten().to_numpy(), tf.flatten().to_numpy()))
                held += len(docs[-1][3]) + 64 * len(r)
        if docs:
            add()
        if best is None:
            return
        names = pa.chunked_array(keys).combine_chunks().filter(pa.array(np.concatenate(fresh)))
        for i in range(0, len(ids), 1000):
            at, rows, scores = best.top(i, min(i + 1000, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1000], types[0]).take(pa.array(at)), names.take(pa.array(rows)).cast(types[1]), pa.array(scores, types[2])], [query, key, "score"])

    hits = both.select("is_row", "q", "r", "length", "terms", "idf", "tfs").mapInArrow(stream, f"{query} {q_kind.simpleString()}, {key} {r_kind.simpleString()}, score double")
    return ranked(hits, [query], [F.col("score").desc(), F.col(key)], limit)


def _once(vectors: DataFrame, key: str) -> DataFrame:
    """The vectors with one row for a key and length: the counts of rows that repeat them are added up."""
    again = vectors.groupBy(key, "length").agg(F.count("*").alias("k")).where("k > 1").select(key, "length")
    if again.isEmpty():
        return vectors
    on = F.col(f"v.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col("v.length") == F.col("o.length"))
    own = lambda how: vectors.alias("v").join(again.alias("o"), on, how)
    flat = own("left_semi").select(key, "length", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(key, "length", F.col("x.terms").alias("h")).agg(F.sum("x.tfs").cast("int").alias("tf"))
    summed = flat.groupBy(key, "length").agg(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "tf")))).alias("x"))
    return materialize(own("left_anti").unionByName(summed.select(key, "length", F.col("x.h").alias("terms"), F.col("x.tf").alias("tfs"))), "vectors")


class _Best:
    """The best documents of each query so far, by score, then in the order in which documents come."""

    def __init__(self, wanted: list, weights: list, limit: int, k1: float, b: float, mean: float) -> None:
        import numpy as np

        self.limit, self.k1, self.b, self.mean, self.seen = limit, k1, b, mean, 0
        flat = np.concatenate(wanted)
        self.terms, first = np.unique(flat, return_index=True)
        self.idf = np.concatenate(weights)[first]
        self.wanted = [np.searchsorted(self.terms, w) for w in wanted]
        self.rows = [np.zeros(0, np.int64) for _ in wanted]
        self.scores = [np.zeros(0) for _ in wanted]

    def add(self, other, length, number, terms, tfs) -> None:
        import numpy as np

        place, n = np.cumsum(other) - 1, int(other.sum())
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        keep = np.flatnonzero(self.terms[at] == terms)
        at, row, tf = at[keep], np.repeat(np.arange(len(length)), number)[keep], tfs[keep]
        gain = self.idf[at] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[row] / self.mean))
        order = np.argsort(at, kind="stable")
        row, gain = place[row[order]], gain[order]
        cut = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        for i, w in enumerate(self.wanted):
            spans = [slice(cut[t], cut[t + 1]) for t in w]
            score = np.bincount(np.concatenate([row[s] for s in spans]), np.concatenate([gain[s] for s in spans]), n)
            full = len(self.rows[i]) == self.limit
            least = self.scores[i][-1] - 1e-6 if full else 0.0
            if not full and n > 4 * self.limit:
                least = max(least, np.partition(score, n - self.limit)[n - self.limit] - 1e-6)
            found = np.flatnonzero(score > least)
            if len(found):
                s = np.concatenate([self.scores[i], np.floor(score[found] * 1e6 + 0.5) / 1e6])
                r = np.concatenate([self.rows[i], found + self.seen])
                s, r = s[s > 0], r[s > 0]
                first = np.lexsort((r, -s))[: self.limit]
                self.rows[i], self.scores[i] = r[first], s[first]
        self.seen += n

    def top(self, first: int, last: int):
        import numpy as np

        at = np.repeat(np.arange(last - first), [len(r) for r in self.rows[first:last]])
        return at, np.concatenate(self.rows[first:last]), np.concatenate(self.scores[first:last])


def rrf(rankings: DataFrame, query: str, channel: str, item: str, pos: str, k: int = 60, limit: int = 64) -> DataFrame:
    """(query, item, score, sources, rank): reciprocal-rank fusion; within a channel an item counts at its best
    position, and ranks are taken anew after that."""
    best = rankings.groupBy(query, channel, item).agg(F.min(pos).alias("_pos"))
    re_ranked = ranked(best, [query, channel], [F.col("_pos"), F.col(item)], out="_rank")
    fused = re_ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 9).alias("score"), F.array_sort(F.collect_set(channel)).alias("sources"))
    return ranked(fused, [query], [F.col("score").desc(), F.col(item)], limit)


def rrf_protected(rankings: DataFrame, query: str, channel: str, item: str, pos: str, k: int = 64, depth: int = 64, reserve: int = 8, limit: int = 64) -> DataFrame:
    """(query, item, score, best_rank, sources, rank): fusion that keeps each channel's `reserve` heads; positions over
    `depth` don't count, and a repeated item counts once, at its best position."""
    best = rankings.where(F.col(pos) <= depth).groupBy(query, channel, item).agg(F.min(pos).alias("_pos"))
    fused = best.groupBy(query, item).agg(
        F.round(F.sum(1.0 / (k + F.col("_pos"))), 9).alias("score"), F.min("_pos").alias("best_rank"), F.array_sort(F.collect_set(channel)).alias("sources"))
    head = F.when(F.col("best_rank") <= reserve, 0).otherwise(1)
    kept = ranked(fused.withColumn("_head", head), [query], [F.col("_head"), F.col("score").desc(), F.col("best_rank"), F.col(item)], limit, "_keep")
    return ranked(kept.drop("_head", "_keep"), [query], [F.col("score").desc(), F.col("best_rank"), F.col(item)])


def _unit(vectors):
    import numpy as np

    m = np.array(list(vectors), dtype=float).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _cosines(base: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, keep, block: int, chunk: int) -> DataFrame:
    """(query, key, score): what `keep` makes of the matrix of scores of each batch of rows.

    Up to `block` query vectors are one matrix that is broadcast, and rows are not shuffled. More are hashed into blocks
    of about that size and the rows into chunks of about `chunk`; a task streams a chunk past a block, so neither the
    driver nor a task ever holds more than a block of queries, and a row never meets a query as a pair in the JVM."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from corvane.session import ship

    spark = base.sparkSession
    ship(spark)
    q_kind, r_kind = queries.schema[query].dataType, base.schema[key].dataType
    types = to_arrow_type(q_kind), to_arrow_type(r_kind)
    kinds = f"{query} {q_kind.simpleString()}, {key} {r_kind.simpleString()}, score double"
    rows = base.select(F.col(key).alias("r"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and r is not null")
    asked = queries.select(F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null and q is not null")
    n = asked.count()

    def scores(ids, q, part):
        at, keys, values = keep(np.round(q @ _unit(part["v"]).T, 6), part["r"].to_numpy())
        return pd.DataFrame({query: [ids[i] for i in at], key: keys, "score": values})

    if n <= block:
        held = asked.toPandas()
        shared = spark.sparkContext.broadcast((held["q"].tolist(), _unit(held["v"]) if len(held) else None))

        def run(frames):
            ids, q = shared.value
            for f in frames:
                if len(f) and len(ids):
                    yield scores(ids, q, f)

        return rows.mapInPandas(run, kinds)
    blocks, chunks = -(-n // block), max(1, -(-rows.count() // chunk))
    many = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = asked.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b"), many(chunks).alias("c"), F.lit(False).alias("is_row"), "q", F.lit(None).cast(r_kind).alias("r"), "v")
    z = rows.select(many(blocks).alias("b"), F.pmod(F.xxhash64("r"), F.lit(chunks)).cast("int").alias("c"), F.lit(True).alias("is_row"), F.lit(None).cast(q_kind).alias("q"), "r", "v")
    both = a.unionByName(z).repartition("b", "c").sortWithinPartitions("b", "c", "is_row")

    def stream(batches):
        at, ids, vectors, q = None, [], [], None
        for batch in batches:
            b, c, is_row, qs, rs, vs = (x.to_pylist() for x in batch.columns)
            first = 0
            while first < len(b):
                last = first
                while last < len(b) and (b[last], c[last], is_row[last]) == (b[first], c[first], is_row[first]):
                    last += 1
                if (b[first], c[first]) != at:
                    at, ids, vectors, q = (b[first], c[first]), [], [], None
                if not is_row[first]:
                    ids += qs[first:last]
                    vectors += vs[first:last]
                elif ids:
                    q = _unit(vectors) if q is None else q
                    out = scores(ids, q, pd.DataFrame({"r": rs[first:last], "v": vs[first:last]}))
                    yield pa.RecordBatch.from_arrays([pa.array(out[query].tolist(), types[0]), pa.array(out[key].tolist(), types[1]), pa.array(out["score"], pa.float64())], [query, key, "score"])
                first = last

    return both.select("b", "c", "is_row", "q", "r", "v").mapInArrow(stream, kinds)


def dense_topk(base: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, limit: int = 10, block: int = 4096, chunk: int = 50_000) -> DataFrame:
    """(query, key, score, rank): exact cosine search of the given query set against all rows. A batch of rows keeps its
    `limit` best per query, so the last shuffle carries candidates only. Null vectors have no matches; a zero vector
    scores 0."""
    import numpy as np

    def keep(s, keys):
        place = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
        order = np.lexsort((np.broadcast_to(place, s.shape), -s), axis=1)[:, :limit]
        return np.repeat(np.arange(len(s)), order.shape[1]), keys[order.ravel()], np.take_along_axis(s, order, 1).ravel()

    hits = _cosines(base, key, vector, queries, query, query_vector, keep, block, chunk)
    return ranked(hits, [query], [F.col("score").desc(), F.col(key)], limit)


def dense_groups(base: DataFrame, group: str, vector: str, queries: DataFrame, query: str, query_vector: str, block: int = 4096, chunk: int = 50_000) -> DataFrame:
    """(query, group, score): the best cosine of a group's vectors, as a file scores by its best chunk."""
    import numpy as np

    def keep(s, keys):
        order = np.argsort(keys, kind="stable")
        names, first = np.unique(keys[order], return_index=True)
        best = np.maximum.reduceat(s[:, order], first, axis=1)
        return np.repeat(np.arange(len(s)), len(names)), np.tile(names, len(s)), best.ravel()

    hits = _cosines(base, group, vector, queries, query, query_vector, keep, block, chunk)
    return hits.groupBy(query, group).agg(F.max("score").alias("score"))
