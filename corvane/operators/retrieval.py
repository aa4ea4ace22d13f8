"""Retrieval pipelines: file shortlists, adapters of outputs to units, and the acquisition loop over a task batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.intervals import overlap_join
from corvane.operators.ranking import ranked, rrf
from corvane.session import materialize


def shortlist(path_hits: DataFrame, content_hits: DataFrame, query: str, item: str, caps: tuple[int, int] = (32, 64), limit: int = 96) -> DataFrame:
    """(query, item, rank, sources): path hits first, then content hits, each up to its cap, in their order."""
    a = path_hits.where(F.col("rank") <= caps[0]).select(query, item, F.lit(0).alias("_c"), F.lit("path").alias("_s"), "rank")
    b = content_hits.where(F.col("rank") <= caps[1]).select(query, item, F.lit(1).alias("_c"), F.lit("content").alias("_s"), "rank")
    best = a.unionByName(b).groupBy(query, item).agg(F.min(F.struct("_c", "rank")).alias("_k"), F.array_sort(F.collect_set("_s")).alias("sources"))
    return ranked(best.select(query, item, "sources", F.col("_k._c").alias("_c"), F.col("_k.rank").alias("_r")), [query], [F.col("_c"), F.col("_r"), F.col(item)], limit).select(query, item, "rank", "sources")


def adapt_outputs(outputs: DataFrame, units: DataFrame) -> DataFrame:
    """(task_id, evidence_id, source_rank): the units that outputs name, within each task's own units that may be scored.

    An output has task_id, source_rank and some of evidence_id, path, symbol, start_line and end_line; it names the unit
    of its id, else the path's units with its symbol as symbol or qualified name, else those that its span meets, else
    the path's units. A unit counts at its first output. `units` has task_id, evidence_id, path, symbol, qualified_name,
    start_line, end_line, scoreable; null scoreable counts as true."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    o = outputs.select("task_id", "source_rank", F.col("evidence_id").alias("o_id"), F.col("path").alias("o_path"), F.col("symbol").alias("o_symbol"), F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end"))
    u = units.where(F.coalesce("scoreable", F.lit(True))).select("task_id", "evidence_id", "path", "symbol", "qualified_name", "start_line", "end_line")
    by_id = o.where(filled("o_id")).join(u.select("task_id", F.col("evidence_id").alias("o_id")), ["task_id", "o_id"], "left_semi").select("task_id", "source_rank", F.col("o_id").alias("evidence_id"))
    rest = o.where(~filled("o_id")).withColumnRenamed("o_path", "path")
    names = u.select("task_id", "path", "evidence_id", F.explode(F.array_distinct(F.array_compact(F.array("symbol", "qualified_name")))).alias("o_symbol"))
    symbol = rest.where(filled("o_symbol")).join(names, ["task_id", "path", "o_symbol"])
    whole = rest.where(~filled("o_symbol"))
    spanned = F.col("o_start").isNotNull() & F.col("o_end").isNotNull()
    span = overlap_join(whole.where(spanned), u.drop("symbol", "qualified_name"), ["task_id", "path"], "o_start", "o_end", "start_line", "end_line")
    path = whole.where(~spanned).join(u.select("task_id", "path", "evidence_id"), ["task_id", "path"])
    every = by_id
    for part in (symbol, span, path):
        every = every.unionByName(part.select("task_id", "source_rank", "evidence_id"))
    return every.groupBy("task_id", "evidence_id").agg(F.min("source_rank").alias("source_rank"))


def acquire(candidates: DataFrame, rounds: int, max_units: int, max_tokens: int, per_round: int = 1) -> DataFrame:
    """(task_id, evidence_id, step, used): a batch of tasks acquires evidence round by round.

    `candidates` has task_id, channel, evidence_id, rank and tokens. A round fuses the channels over what is left, takes
    the best that still fits, and goes on until the rounds or budgets end; every round is one Spark job for all tasks,
    and its state is a written table, so a lost executor costs no round."""
    pool = materialize(candidates.select("task_id", "channel", "evidence_id", "rank", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "pool")
    spark = candidates.sparkSession
    kind = pool.schema
    state = spark.createDataFrame([], f"task_id {kind['task_id'].dataType.simpleString()}, evidence_id {kind['evidence_id'].dataType.simpleString()}, step int, used bigint")
    for step in range(1, rounds + 1):
        held = state.groupBy("task_id").agg(F.count("*").alias("held"), F.max("used").alias("spent"))
        left = pool.join(state.select("task_id", "evidence_id"), ["task_id", "evidence_id"], "left_anti").join(held, "task_id", "left")
        spent = F.coalesce("spent", F.lit(0))
        left = left.where((F.coalesce("held", F.lit(0)) + per_round <= max_units) & (spent + F.col("tokens") <= max_tokens))
        best = rrf(left, "task_id", "channel", "evidence_id", "rank", limit=per_round).select("task_id", "evidence_id", "rank")
        cost = left.groupBy("task_id", "evidence_id").agg(F.max("tokens").alias("tokens"), F.max(spent).alias("spent"))
        taken = best.join(cost, ["task_id", "evidence_id"]).withColumn("used", F.col("spent") + F.sum("tokens").over(Window.partitionBy("task_id").orderBy("rank"))).where(F.col("used") <= max_tokens)
        nxt = materialize(state.unionByName(taken.select("task_id", "evidence_id", F.lit(step).alias("step"), "used")), "acquired")
        if nxt.where(F.col("step") == step).isEmpty():
            break
        state = nxt
    return state


def structural_pairs(edges: DataFrame, candidates: DataFrame, task: str, item: str, rank: str, cap: int = 8) -> DataFrame:
    """(task, first, second, rank): edges between candidates of a task, the earlier candidate first, the `cap` best."""
    c = candidates.select(task, item, rank)
    a, b = c.toDF(task, "first", "_a"), c.toDF(task, "second", "_b")
    pairs = edges.toDF("first", "second").join(a, "first").join(b, [task, "second"]).where("_a < _b")
    return ranked(pairs, [task], [F.col("_a"), F.col("_b"), F.col("first"), F.col("second")], cap).select(task, "first", "second", "rank")
