"""Selection under quotas and budgets, gains of additions, interactions. Walks run per task on one collected array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialize, ship


def gains(witness: DataFrame, selected: DataFrame, task: str, obligation: str, group: str, evidence: str, mandatory: str | None = None) -> DataFrame:
    """(task, evidence, gain, progress): what each unselected witness would add to completion, the met share of the
    mandatory obligations (all, where no column tells; null where there is none), and to mean progress over all.

    A group that lacks one piece completes with it; progress is the rise of the obligation's best share. All relational:
    one aggregate of the groups, one join back to their missing pieces."""
    keys = [task, evidence] if task in selected.columns else [evidence]
    must = F.coalesce(F.col(mandatory), F.lit(False)) if mandatory else F.lit(True)
    w = witness.select(task, obligation, must.alias("_must"), group, evidence).distinct().join(selected.select(*keys).distinct().withColumn("_h", F.lit(1)), keys, "left")
    g = w.groupBy(task, obligation, group).agg(F.count("*").alias("_n"), F.count("_h").alias("_k"), F.max("_must").alias("_must"))
    o = g.groupBy(task, obligation).agg(F.max(F.col("_k") / F.col("_n")).alias("_best"), F.max("_must").alias("_must"))
    total = o.groupBy(task).agg(F.count("*").alias("_all"), F.count_if("_must").alias("_due"))
    miss = w.where("_h is null").drop("_must").join(g.drop("_must"), [task, obligation, group]).join(o, [task, obligation])
    after = miss.groupBy(task, evidence, obligation, "_best", "_must").agg(F.max((F.col("_k") + 1) / F.col("_n")).alias("_after"))
    rise = F.greatest(F.col("_after") - F.col("_best"), F.lit(0.0))
    done = (F.col("_must") & (F.col("_after") >= 1 - 1e-9) & (F.col("_best") < 1 - 1e-9)).cast("int")
    return after.join(total, task).groupBy(task, evidence, "_all", "_due").agg(F.sum(done).alias("_c"), F.sum(rise).alias("_p")).select(
        task, evidence, F.round(F.col("_c") / F.nullif("_due", F.lit(0)), 6).alias("gain"), F.round(F.col("_p") / F.col("_all"), 6).alias("progress"))


def interactions(ordered: DataFrame, witness: DataFrame, task: str, obligation: str, group: str, evidence: str, pos: str) -> DataFrame:
    """(task, redundant_rate, substitute_rate, complementary_rate) of evidence taken in order: pieces that raise no
    obligation's progress; repeats of a witness where an obligation with several groups was complete before; and the
    obligations with a group of several pieces that has them all."""
    ship(ordered.sparkSession)
    text = lambda c: F.col(c).cast("string")
    taken = ordered.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), text(evidence).alias("e")))).alias("taken"))
    asked = witness.groupBy(task).agg(F.array_sort(F.collect_set(F.struct(text(obligation).alias("o"), text(group).alias("g"), text(evidence).alias("e")))).alias("asked"))

    @F.udf("struct<redundant_rate:double,substitute_rate:double,complementary_rate:double>", useArrow=True)
    def run(taken, asked):
        needs: dict = {}
        for r in asked or []:
            needs.setdefault(r["o"], {}).setdefault(r["g"], set()).add(r["e"])
        groups = {o: list(gs.values()) for o, gs in needs.items()}
        held: set = set()
        share = lambda: {o: max(len(g & held) / len(g) for g in gs) for o, gs in groups.items()}
        redundant = repeated = chances = 0
        before = share()
        for r in taken or []:
            for o, gs in groups.items():
                if len(gs) > 1 and before[o] >= 1:
                    chances += 1
                    repeated += any(r["e"] in g for g in gs)
            held.add(r["e"])
            after = share()
            redundant += all(after[o] <= before[o] for o in groups)
            before = after
        many = [gs for gs in groups.values() if any(len(g) > 1 for g in gs)]
        full = sum(any(len(g) > 1 and g <= held for g in gs) for gs in many)
        n = len(taken or [])
        return round(redundant / n, 6) if n else 0.0, round(repeated / chances, 6) if chances else 0.0, round(full / len(many), 6) if many else 0.0

    return taken.join(asked, task, "left").select(task, run("taken", "asked").alias("x")).select(task, "x.*")


def quota_select(candidates: DataFrame, task: str, item: str, file: str, category: str, start: str, end: str, priority: list[Column], limit: int = 24, per_file: int = 4, quotas: dict[str, int] | None = None, overlap: float = 0.65, page: int = 512) -> DataFrame:
    """(task, item, place): candidates in the ascending order of `priority` and item, each taken unless its file or
    category is full, or it overlaps a taken one of its file by `overlap` of the shorter.

    The walk goes by pages: a round ranks, for every task that isn't full, the next `page` candidates beyond the last
    key seen, which Spark prunes before the shuffle, and goes on from the task's state. So no task's candidates are ever
    in one row, and tasks that fill early cost one round. The rounds end when no task has a page left."""
    ship(candidates.sparkSession)
    quotas = quotas or {}
    kind = candidates.schema[item].dataType.simpleString()
    keys = [p.alias(f"k{i}") for i, p in enumerate(priority)] + [F.col(item).alias("i")]
    pool = candidates.where(F.col(item).isNotNull()).select(
        task, F.struct(*keys).alias("k"), F.col(item).alias("i"), F.col(file).cast("string").alias("f"), F.col(category).cast("string").alias("c"), F.col(start).cast("int").alias("a"), F.col(end).cast("int").alias("b"))
    pool = materialize(pool, "pool")
    taken_kind = f"array<struct<i:{kind},f:string,c:string,a:int,b:int>>"

    @F.udf(taken_kind, useArrow=True)
    def run(before, rows):
        out = [tuple(x[k] for k in "ifcab") for x in before or []]
        files: dict = {}
        used: dict = {}
        for _, f, c, a, b in out:
            files.setdefault(f, []).append((a, b))
            used[c] = used.get(c, 0) + 1
        for r in rows:
            if len(out) >= limit:
                break
            own = files.setdefault(r["f"], [])
            if len(own) >= per_file or used.get(r["c"], 0) >= quotas.get(r["c"], limit):
                continue
            size = r["b"] - r["a"] + 1
            if any(min(r["b"], b) - max(r["a"], a) + 1 >= overlap * min(size, b - a + 1) for a, b in own):
                continue
            own.append((r["a"], r["b"]))
            used[r["c"]] = used.get(r["c"], 0) + 1
            out.append((r["i"], r["f"], r["c"], r["a"], r["b"]))
        return out

    def step(rows: DataFrame, state: DataFrame | None) -> DataFrame:
        if state is not None:
            rows = rows.join(state.where("open").select(task, "taken", "last"), task).where(F.col("k") > F.col("last"))
        else:
            rows = rows.withColumn("taken", F.lit(None).cast(taken_kind))
        top = rows.withColumn("r", F.row_number().over(Window.partitionBy(task).orderBy("k"))).where(F.col("r") <= page)
        got = top.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("r", "i", "f", "c", "a", "b"))).alias("rows"), F.first("taken").alias("taken"), F.max("k").alias("last"))
        got = got.select(task, run("taken", "rows").alias("taken"), "last", (F.size("rows") == page).alias("more"))
        return materialize(got.select(task, "taken", "last", (F.col("more") & (F.size("taken") < limit)).alias("open")), "taken")

    state = step(pool, None)
    done = [state.where("not open").select(task, "taken")]
    while not state.where("open").isEmpty():
        ahead = step(pool, state)
        # A task with no page left ends with what it has.
        done.append(state.where("open").join(ahead.select(task), task, "left_anti").select(task, "taken"))
        done.append(ahead.where("not open").select(task, "taken"))
        state = ahead
    every = reduce(DataFrame.unionByName, done)
    return every.select(task, F.posexplode("taken").alias("p", "x")).select(task, F.col("x.i").alias(item), (F.col("p") + 1).alias("place"))


def fitting_bodies(items: Column, room: int) -> Column:
    """Of an array<struct<id, tokens>> in the order of arrival, the ids whose bodies fit when the most recent go first,
    in the order of arrival. A higher-order expression."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, x):
        t = F.coalesce(x["tokens"], F.lit(0)).cast("bigint")
        return F.when(acc["used"] + t <= room, F.struct(F.concat(F.array(x["id"].cast("string")), acc["ids"]).alias("ids"), (acc["used"] + t).alias("used"))).otherwise(acc)

    return F.aggregate(F.reverse(items), start, step)["ids"]


def nearest_units(anchors: DataFrame, units: DataFrame, file: str, item: str, start: str, end: str, most: int = 2) -> DataFrame:
    """(anchor, item, distance, rank): of an anchor's file the `most` nearest other units by lines between them."""
    a = anchors.select(F.col(file), F.col(item).alias("anchor"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    pairs = a.join(units.select(file, item, start, end), file).where(F.col("anchor") != F.col(item))
    far = F.greatest(F.col(start) - F.col("_e"), F.col("_s") - F.col(end), F.lit(0))
    r = F.row_number().over(Window.partitionBy("anchor").orderBy("distance", item))
    return pairs.withColumn("distance", far).withColumn("rank", r).where(F.col("rank") <= most).select("anchor", item, "distance", "rank")
