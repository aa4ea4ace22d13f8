"""Records of evaluation splits that occur, exactly or almost, in the training split."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.automaton import scan
from corvane.operators.intervals import islands
from corvane.session import materialize, ship

WORD = r"([a-z0-9]+)"


def _shingles(words, size: int):
    """Distinct runs of `size` words as strings, in an array column of words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " ")))


def _normalised(df: DataFrame, text: str, size: int) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD))
    return df.withColumn("words", words).where(F.size("words") >= size).withColumn("norm", F.array_join("words", " ")).withColumn("doc", F.md5("norm"))


def cross_split_overlap(tasks: DataFrame, train: tuple = ("train",), evaluation: tuple = ("validation", "benchmark"), threshold: float = 0.6, size: int = 3,
                        key: str = "task_id", text: str = "problem_statement", split: str = "split", shared: int = 6, shard_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(pairs, coverage). pairs: eval_id, train_id, similarity, coverage of an evaluation and a training record whose
    sets of `size` successive words have a Jaccard similarity of at least `threshold`. coverage: eval_id, coverage of
    every evaluation record that has a pair.

    Exact copies are one text. A training text that is similar enough lacks at most n - ceil(threshold * n) of the n
    shingles of an evaluation text, so of that many plus `shared` of them, the rarest in training, it holds `shared` at
    least. These are the text's passages; those that occur in training at all go into the automata, which scan every
    training text in one pass. Texts that share so many passages are verified on all shingles. The matches of a pair, as
    intervals of the evaluation text's words, are merged, and their share of the words is the pair's coverage; merged
    once more over all its training texts they are the record's. No pair is lost and no bucket is capped.

    Null, empty and shorter texts have no pair; a record in both roles pairs with others, never with itself; repeated
    rows count once; other columns are ignored."""
    ship(tasks.sparkSession)
    base = _normalised(tasks.select(F.col(key).alias("id"), F.col(split).alias("part"), F.col(text).alias("text")).where("id is not null"), "text", size)
    role = F.when(F.col("part").isin(*train), "t").when(F.col("part").isin(*evaluation), "e")
    base = base.withColumn("role", role).where("role is not null")
    member = materialize(base.select("id", "role", "doc").distinct(), "overlap-members")
    texts = materialize(base.groupBy("role", "doc").agg(F.first("norm").alias("norm"), F.first("words").alias("words")), "overlap-texts")
    grams = texts.select("role", "doc", _shingles(F.col("words"), size).alias("g")).withColumn("n", F.size("g"))
    ours = grams.where("role = 'e'").select("doc", "n", F.explode("g").alias("gram"))
    seen = grams.where("role = 't'").select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("df", F.xxhash64("gram"), "gram"))
    passages = (
        ours.join(seen, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rank)
        .withColumn("common", F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).withColumn("need", F.least("common", F.lit(shared)))
        .where(F.col("rank") <= F.col("n") - F.col("common") + F.col("need")).where("df > 0").select("doc", "need", F.concat(F.lit(" "), "gram", F.lit(" ")).alias("passage"))
    )
    passages = materialize(passages, "overlap-passages")
    padded = texts.where("role = 't'").select("doc", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("norm"))
    hits = scan(padded, "doc", "norm", passages, "passage", shard_bytes).select(F.col("doc").alias("t"), "passage")
    pairs = hits.join(passages.withColumnRenamed("doc", "e"), "passage").groupBy("e", "t", "need").agg(F.count("*").alias("met")).where("met >= need").drop("need", "met")
    sizes = grams.select("role", "doc", "n")
    pairs = (
        pairs.join(sizes.where("role = 'e'").select(F.col("doc").alias("e"), F.col("n").alias("ne")), "e")
        .join(sizes.where("role = 't'").select(F.col("doc").alias("t"), F.col("n").alias("nt")), "t")
        .where((F.least("ne", "nt") >= F.lit(threshold) * F.greatest("ne", "nt") - 1e-9))
        .join(texts.where("role = 'e'").select(F.col("doc").alias("e"), F.col("norm").alias("eval_text")), "e")
        .join(texts.where("role = 't'").select(F.col("doc").alias("t"), F.col("norm").alias("train_text")), "t")
    )

    @F.arrow_udf("struct<similarity:double,words:int,matched:array<struct<first:int,last:int>>>")
    def verify(a, b):
        sim, words, first, last, ends = [], [], [], [], [0]
        grams_of: dict[str, set] = {}

        def of(t):
            g = grams_of.get(t)
            if g is None:
                w = t.split(" ")
                g = grams_of[t] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            return g

        for x, y in zip(a.to_pylist(), b.to_pylist()):
            gx, gy = of(x), of(y)
            both = len(gx & gy)
            sim.append(both / (len(gx) + len(gy) - both))
            w, upto = x.split(" "), -1
            words.append(len(w))
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in gy:
                    if i <= upto + 1 and len(first) > ends[-1]:
                        last[-1] = i + size - 1
                    else:
                        first.append(i)
                        last.append(i + size - 1)
                    upto = i + size - 1
            ends.append(len(first))
        spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])
        return pa.StructArray.from_arrays([pa.array(sim, pa.float64()), pa.array(words, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["similarity", "words", "matched"])

    found = pairs.select("e", "t", verify("eval_text", "train_text").alias("v")).where(F.col("v.similarity") >= threshold).select("e", "t", "v.*")
    covered = F.aggregate("matched", F.lit(0), lambda n, x: n + x["last"] - x["first"] + 1)
    found = materialize(found.withColumn("coverage", covered / F.col("words")), "overlap-pairs")
    spans = found.select("e", "words", F.explode("matched").alias("m")).select("e", "words", "m.first", "m.last").distinct()
    merged = islands(spans, ["e", "words"], "first", "last").groupBy("e").agg((F.sum(F.col("last") - F.col("first") + 1) / F.max("words")).alias("coverage"))
    m = lambda r, d, k: member.where(F.col("role") == r).select(F.col("doc").alias(d), F.col("id").alias(k))
    result = found.join(m("e", "e", "eval_id"), "e").join(m("t", "t", "train_id"), "t").where("eval_id <> train_id").select("eval_id", "train_id", "similarity", "coverage").distinct()
    return result, m("e", "e", "eval_id").join(merged, "e").select("eval_id", "coverage").distinct().join(result.select("eval_id").distinct(), "eval_id", "left_semi")
