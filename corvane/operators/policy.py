"""States of acquired evidence and the actions open to them: gains, relations, labels, seeds, boundaries.

Tables are long. witness: task, obligation, mandatory, grp, evidence; an obligation is met by any of its groups, a group
by all of its evidence. selected: task, state, evidence. states: task, state. Rows of obligations that don't apply are
left out by `applicable`. All keys are matched within a task, so nothing meets as a product over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import stable_id, stage_name
from corvane.session import materialize

EPS = 1e-6
OBLIGATION = ["task", "obligation"]


def applicable(witness: DataFrame) -> DataFrame:
    """The witness rows of obligations that apply (`applicable` is true; null counts as not). A task with a mandatory
    one that has no group, a row whose grp or evidence is null, has no rows: its completion is not defined."""
    own = witness.where(F.coalesce("applicable", F.lit(False)))
    whole = own.groupBy(*OBLIGATION).agg(F.max("mandatory").alias("m"), F.count_if(F.col("grp").isNotNull() & F.col("evidence").isNotNull()).alias("n"))
    return own.join(whole.where("m and n = 0").select("task").distinct(), "task", "left_anti").select("task", "obligation", "mandatory", "grp", "evidence").distinct()


def _groups(states: DataFrame, selected: DataFrame, witness: DataFrame) -> DataFrame:
    """(task, state, obligation, mandatory, grp, size, held) of every state and group of its task. A group without
    evidence has size 0."""
    members = witness.where("evidence is not null").select("task", "obligation", "grp", "evidence").distinct()
    sizes = witness.groupBy(*OBLIGATION, "grp").agg(F.max("mandatory").alias("mandatory"), F.countDistinct("evidence").alias("size"))
    held = selected.distinct().join(members, ["task", "evidence"]).groupBy("task", "state", "obligation", "grp").agg(F.count("*").alias("held"))
    out = states.select("task", "state").distinct().join(sizes, "task")
    return out.join(held, ["task", "state", "obligation", "grp"], "left").withColumn("held", F.coalesce("held", F.lit(0)))


def _best(groups: DataFrame) -> DataFrame:
    """(task, state, obligation, mandatory, best): the largest share of a non-empty group that is held, else 0."""
    share = F.when(F.col("size") > 0, F.col("held") / F.col("size")).otherwise(0.0)
    return groups.groupBy("task", "state", "obligation").agg(F.max("mandatory").alias("mandatory"), F.max(share).alias("best"))


def state_metrics(states: DataFrame, selected: DataFrame, witness: DataFrame) -> DataFrame:
    """(task, state, completion, progress, sufficient, completed): the met share of the mandatory obligations, null
    where there is none; the mean share over all; the ids of those met."""
    must = F.coalesce("mandatory", F.lit(False)).cast("int")
    met = (F.col("best") >= 1).cast("int")
    x = _best(_groups(states, selected, witness)).groupBy("task", "state").agg(
        F.round(F.sum(must * met) / F.nullif(F.sum(must), F.lit(0)), 6).alias("completion"), F.round(F.avg("best"), 6).alias("progress"),
        F.array_sort(F.collect_list(F.when(met == 1, F.col("obligation")))).alias("completed"))
    return x.select("task", "state", "completion", "progress", F.coalesce(F.col("completion") >= 1 - EPS, F.lit(False)).alias("sufficient"), "completed")


def action_gains(actions: DataFrame, states: DataFrame, selected: DataFrame, witness: DataFrame) -> DataFrame:
    """(task, state, action, completion_gain, progress_gain, covered, complement, substitute): what an action, whose
    evidence its state hasn't, would add. `actions` has task, state, action, evidence, a row per piece of evidence.

    Only groups that hold some of the action's evidence change, so the join is sparse and no state is built anew. A pair
    is a complement where one group holds both, and a substitute where each alone completes a group."""
    groups = materialize(_groups(states, selected, witness), "groups")
    best = _best(groups)
    key = ["task", "state"]
    must = F.coalesce("mandatory", F.lit(False)).cast("int")
    total = best.groupBy(*key).agg(F.count("*").alias("_all"), F.sum(must).alias("_must"))
    acts = actions.select(*key, "action", "evidence").distinct()
    hits = acts.join(witness.where("evidence is not null").select("task", "obligation", "grp", "evidence").distinct(), ["task", "evidence"])
    hits = hits.join(groups.select(*key, "obligation", "grp", "size", "held"), [*key, "obligation", "grp"])
    by_group = hits.groupBy(*key, "action", "obligation", "grp", "size", "held").agg(F.count("*").alias("add"), F.min("evidence").alias("one"))
    alone = (F.col("add") == 1) & (F.col("held") + 1 == F.col("size"))
    after = by_group.groupBy(*key, "action", "obligation").agg(
        F.max((F.col("held") + F.col("add")) / F.col("size")).alias("after"), F.max(F.col("add") == 2).alias("both"), F.countDistinct(F.when(alone, F.col("one"))).alias("completers"))
    x = after.join(best, [*key, "obligation"])
    rise = F.greatest(F.col("after") - F.col("best"), F.lit(0.0))
    done = ((F.col("after") >= 1) & (F.col("best") < 1)).cast("int")
    x = x.groupBy(*key, "action").agg(
        F.sum(done * must).alias("_c"), F.sum(rise).alias("_p"), F.array_sort(F.collect_list(F.when(done == 1, F.col("obligation")))).alias("covered"), F.max("both").alias("complement"),
        F.max(~F.col("both") & (F.col("completers") == 2)).alias("substitute"))
    out = acts.select(*key, "action").distinct().join(total, key, "left").join(x, [*key, "action"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *key, "action", F.round(zero("_c") / F.nullif("_must", F.lit(0)), 6).alias("completion_gain"), F.round(zero("_p") / F.col("_all"), 6).alias("progress_gain"),
        F.coalesce("covered", F.array().cast("array<string>")).alias("covered"), F.coalesce("complement", F.lit(False)).alias("complement"), F.coalesce("substitute", F.lit(False)).alias("substitute"))


def _dominated(own: Column, all_of: Column) -> Column:
    """Whether one of the state's gains and costs is as good in all and better in one."""

    def better(o):
        weak = (o["c"] >= own["c"] - EPS) & (o["p"] >= own["p"] - EPS) & (o["t"] <= own["t"])
        return weak & ((o["c"] > own["c"] + EPS) | (o["p"] > own["p"] + EPS) | (o["t"] < own["t"]))

    return F.exists(all_of, better)


def label_actions(actions: DataFrame, states: DataFrame, selected: DataFrame, witness: DataFrame, costs: DataFrame, negatives: DataFrame) -> DataFrame:
    """(task, state, action, kind, size, token_cost, completion_gain, progress_gain, completion_interaction,
    progress_interaction, complement, substitute, covered, semantic_useful, pareto_dominated, acceptable, label,
    loss_mask): the labelled actions of every state, with its STOP.

    `costs` has task, evidence, cost; unknown costs are 0. `negatives` has task, evidence. An action is useful if it
    completes more, or as much and progresses more; not useful if all its evidence is negative or witness; else unknown.
    Known ones that no other beats in gains and cost are positive, other known ones negative, and all of them in a
    complete state. STOP is positive in a complete state, negative else, unknown without a mandatory obligation.
    Dominance looks at a state's distinct gains and costs, which are few; no pairs of actions are made."""
    key = ["task", "state"]
    acts = actions.select(*key, "action", "evidence").distinct().join(selected.select(*key, "evidence"), [*key, "evidence"], "left_anti")
    gains = action_gains(acts, states, selected, witness)
    known = negatives.select("task", "evidence").distinct().withColumn("_neg", F.lit(True))
    seen = witness.where("evidence is not null").select("task", "evidence").distinct().withColumn("_wit", F.lit(True))
    price = costs.groupBy("task", "evidence").agg(F.min("cost").alias("cost"))
    parts = acts.join(known, ["task", "evidence"], "left").join(seen, ["task", "evidence"], "left").join(price, ["task", "evidence"], "left")
    parts = parts.groupBy(*key, "action").agg(
        F.count("*").alias("size"), F.sum(F.coalesce("cost", F.lit(0))).alias("token_cost"), F.min(F.coalesce("_neg", F.lit(False))).alias("all_negative"), F.min(F.coalesce("_wit", F.lit(False))).alias("all_witness"),
        F.min("evidence").alias("left"), F.max("evidence").alias("right"))
    x = materialize(gains.join(parts, [*key, "action"]), "actions").withColumn("kind", F.when(F.col("size") == 1, "single").otherwise("pair"))
    single = lambda side: x.where("size = 1").select(*key, F.col("left").alias(side), F.col("completion_gain").alias(f"_c_{side}"), F.col("progress_gain").alias(f"_p_{side}"))
    pair = F.col("size") == 2
    x = x.join(single("left"), [*key, "left"], "left").join(single("right"), [*key, "right"], "left")
    more = lambda n: F.when(pair, F.round(F.col(f"{n}_gain") - F.col(f"_{n[0]}_left") - F.col(f"_{n[0]}_right"), 6)).alias(f"{n}_interaction")
    positive = (F.col("completion_gain") > EPS) | ((F.abs("completion_gain") <= EPS) & (F.col("progress_gain") > EPS))
    useful = F.when(F.coalesce(positive, F.lit(False)), True).when(F.col("all_negative") | F.col("all_witness"), False)
    x = x.select(*key, "action", "kind", "size", "token_cost", "completion_gain", "progress_gain", more("completion"), more("progress"), (pair & F.col("complement")).alias("complement"), (pair & F.col("substitute")).alias("substitute"), "covered", useful.alias("semantic_useful"))
    x = materialize(x, "labelled")
    own = F.struct(F.col("completion_gain").alias("c"), F.col("progress_gain").alias("p"), F.col("token_cost").alias("t"))
    rivals = x.where("semantic_useful is not null").groupBy(*key).agg(F.collect_set(own).alias("_all"))
    metrics = state_metrics(states, selected, witness).select(*key, F.col("completion").alias("_done"))
    x = x.join(rivals, key, "left").join(metrics, key, "left").withColumn("pareto_dominated", F.coalesce(F.when(F.col("semantic_useful").isNotNull(), _dominated(own, F.col("_all"))), F.lit(False)))
    complete = F.coalesce(F.col("_done") == 1, F.lit(False))
    good = F.when(complete, False).when(F.col("semantic_useful"), ~F.col("pareto_dominated")).when(~F.col("semantic_useful"), False)
    x = x.withColumn("acceptable", good)
    label = F.when(F.col("acceptable"), "positive").when(~F.col("acceptable"), "negative").otherwise("unknown")
    x = x.withColumn("label", label).withColumn("loss_mask", F.col("acceptable").isNotNull()).drop("_all", "_done")
    stop = states.select(*key).distinct().join(metrics, key, "left").select(
        *key, F.lit("STOP").alias("action"), F.lit("stop").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast(x.schema["token_cost"].dataType).alias("token_cost"),
        F.when(F.col("_done").isNotNull(), F.lit(0.0)).alias("completion_gain"), F.lit(0.0).alias("progress_gain"), F.lit(None).cast("double").alias("completion_interaction"),
        F.lit(None).cast("double").alias("progress_interaction"), F.lit(False).alias("complement"), F.lit(False).alias("substitute"), F.array().cast("array<string>").alias("covered"),
        F.when(F.col("_done").isNotNull(), False).alias("semantic_useful"), F.lit(None).cast("boolean").alias("pareto_dominated"), (F.col("_done") == 1).alias("acceptable"),
        F.when(F.col("_done").isNull(), "unknown").when(F.col("_done") == 1, "positive").otherwise("negative").alias("label"), F.col("_done").isNotNull().alias("loss_mask"))
    return x.withColumn("action", F.col("action").cast("string")).withColumn("covered", F.col("covered").cast("array<string>")).unionByName(stop)


def state_seeds(tasks: DataFrame, certificate: DataFrame, witness: DataFrame, costs: DataFrame, negatives: DataFrame) -> DataFrame:
    """(task, step, state_type, label_source, evidence_ids, completion, progress): a task's states to learn from.

    `tasks` has task; `certificate` task, evidence; `negatives` task, evidence, rank. The initial state is empty, the
    complete one holds the certificate. The boundary is the certificate without the one piece whose loss leaves most
    completion, then most progress, then costs least, then the first ids; for a certificate of one piece it is the best
    hard negative, and without one there is none."""
    cert = certificate.select("task", F.col("evidence").cast("string").alias("evidence")).distinct()
    w = witness.withColumn("evidence", F.col("evidence").cast("string"))
    n = cert.groupBy("task").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("evidence")).alias("ids"))
    without = n.where("n > 1").select("task", "ids", F.explode("ids").alias("state"))
    held = without.select("task", "state", F.explode(F.array_remove("ids", F.col("state"))).alias("evidence"))
    scored = state_metrics(without, held, w).where("completion < 1")
    price = costs.select("task", F.col("evidence").cast("string").alias("evidence"), "cost").groupBy("task", "evidence").agg(F.min("cost").alias("cost"))
    spent = held.join(price, ["task", "evidence"], "left").groupBy("task", "state").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("spent"), F.array_sort(F.collect_list("evidence")).alias("evidence_ids"))
    first = Window.partitionBy("task").orderBy(F.col("completion").desc(), F.col("progress").desc(), "spent", "evidence_ids")
    prefix = scored.join(spent, ["task", "state"]).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("task", F.lit("gold_prefix").alias("label_source"), "evidence_ids")
    wrong = n.where("n = 1").join(negatives.groupBy("task").agg(F.min_by("evidence", F.struct("rank", "evidence")).cast("string").alias("bad")), "task")
    wrong = wrong.select("task", F.lit("controlled_corruption").alias("label_source"), F.array("bad").alias("evidence_ids"))
    empty = F.array().cast("array<string>")
    every = (
        tasks.select("task").distinct().select("task", F.lit(0).alias("_k"), F.lit("initial").alias("state_type"), F.lit("deterministic_initial").alias("label_source"), empty.alias("evidence_ids"))
        .unionByName(prefix.unionByName(wrong).select("task", F.lit(1).alias("_k"), F.lit("decision_boundary").alias("state_type"), "label_source", "evidence_ids"))
        .unionByName(tasks.select("task").distinct().join(n, "task", "left").select("task", F.lit(2).alias("_k"), F.lit("complete").alias("state_type"), F.lit("reference_certificate").alias("label_source"), F.coalesce("ids", empty).alias("evidence_ids")))
    )
    keyed = every.withColumn("state", F.col("state_type"))
    metrics = state_metrics(keyed, keyed.select("task", "state", F.explode("evidence_ids").alias("evidence")), w).select("task", "state", "completion", "progress")
    step = F.row_number().over(Window.partitionBy("task").orderBy("_k")) - 1
    return keyed.withColumn("step", step).join(metrics, ["task", "state"], "left").select("task", "step", "state_type", "label_source", "evidence_ids", "completion", "progress")


def prefix_lengths(total: Column, most: int) -> Column:
    """The lengths of at most `most` non-empty, incomplete prefixes of `total` items: evenly spread over 1..total-1 with
    both ends, rounded half to even, and filled from the smallest where rounding makes two equal."""
    possible = F.when(total > 1, F.sequence(F.lit(1), total - 1)).otherwise(F.array().cast("array<int>"))
    if most <= 0:
        return possible
    raw = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (1 + F.bround(i * (total - 2) / max(1, most - 1))).cast("int"))
    spread = F.array_distinct(F.transform(raw, lambda x: F.least(total - 1, F.greatest(F.lit(1), x))))
    filled = F.slice(F.concat(spread, F.array_except(possible, spread)), 1, most)
    return F.when(F.size(possible) <= most, possible).otherwise(F.array_sort(filled))


def boundary_states(order: DataFrame, witness: DataFrame, most: int = 4) -> DataFrame:
    """(task, length, state_id, stage, evidence_ids, completion, progress): the prefixes of a task's acquisition order
    that stand for its way to the certificate. `order` has task, step (1-based), evidence."""
    runs = order.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("step", F.col("evidence").cast("string").alias("e")))).alias("o"))
    p = runs.select("task", F.col("o.e").alias("ids"), F.explode(prefix_lengths(F.size("o"), most)).alias("length")).select("task", F.col("length").alias("state"), F.slice("ids", F.lit(1), F.col("length")).alias("evidence_ids"))
    metrics = state_metrics(p, p.select("task", "state", F.explode("evidence_ids").alias("evidence")), witness.withColumn("evidence", F.col("evidence").cast("string")))
    ids = stable_id("state", F.col("task"), F.lit("decision_boundary"), F.array_join(F.array_sort("evidence_ids"), "\0"))
    return p.join(metrics, ["task", "state"]).select("task", F.col("state").alias("length"), ids.alias("state_id"), stage_name(F.col("progress")).alias("stage"), "evidence_ids", "completion", "progress")


def action_set(candidates: DataFrame, edges: DataFrame, remaining: DataFrame, pair_limit: int = 8) -> DataFrame:
    """(task, kind, first, second, token_cost): the actions that fit a task's budget: each candidate alone, pairs of
    candidates joined by an edge, the best by their candidates' ranks up to `pair_limit`, and stop.

    `candidates` has task, evidence, rank, tokens and is already without what is held; `edges` source, target in both
    directions; `remaining` task, tokens_left, units_left."""
    left = candidates.select("task", "evidence", "rank", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(remaining, "task")
    fit = left.where((F.col("tokens") <= F.col("tokens_left")) & (F.col("units_left") >= 1))
    single = fit.select("task", F.lit("single").alias("kind"), F.col("evidence").alias("first"), F.lit(None).cast(fit.schema["evidence"].dataType).alias("second"), F.col("tokens").alias("token_cost"))
    a = fit.where("units_left >= 2").select("task", F.col("evidence").alias("source"), F.col("rank").alias("ra"), F.col("tokens").alias("ta"), "tokens_left")
    b = fit.select("task", F.col("evidence").alias("target"), F.col("tokens").alias("tb"))
    met = edges.select("source", "target").distinct().join(a, "source").join(b, ["task", "target"]).where("source <> target")
    # An undirected pair stands at the better ranked of its two ends, then by the other's id.
    once = met.groupBy("task", F.least("source", "target").alias("first"), F.greatest("source", "target").alias("second"), (F.col("ta") + F.col("tb")).alias("token_cost"), "tokens_left").agg(F.min(F.struct("ra", "target")).alias("_at"))
    top = once.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy("_at", "first", "second"))).where(F.col("_r") <= pair_limit)
    pairs = top.where("token_cost <= tokens_left").select("task", F.lit("pair").alias("kind"), "first", "second", "token_cost")
    none = F.lit(None).cast(fit.schema["evidence"].dataType)
    stop = remaining.select("task", F.lit("stop").alias("kind"), none.alias("first"), none.alias("second"), F.lit(0).cast(fit.schema["tokens"].dataType).alias("token_cost"))
    return single.unionByName(pairs).unionByName(stop)
