"""The few algorithms that go step by step within a group. Groups are tasks of bounded size."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import ship


def greedy_budget(items: Column, max_tokens: int, max_units: int) -> Column:
    """Of an array<struct<id, tokens>> in rank order, the ids that a walk keeps: it ends at `max_units` and skips an
    item that would exceed `max_tokens`. A higher-order expression; nothing leaves the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, x):
        t = F.coalesce(x["tokens"], F.lit(0)).cast("bigint")
        fits = (F.size(acc["ids"]) < max_units) & (acc["used"] + t <= max_tokens)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(x["id"].cast("string"))).alias("ids"), (acc["used"] + t).alias("used"))).otherwise(acc)

    return F.aggregate(items, start, step)["ids"]


def certificate(groups: dict[str, list[tuple[str, frozenset]]], cost: dict[str, int], exact: int = 4096) -> list[str]:
    """The cheapest set of evidence that completes one group of every obligation given, which are the mandatory ones:
    exact while the choices number at most `exact`, ties by size, ids, then group ids; beyond that obligation by
    obligation in the order of names, each time what is cheapest, then smallest beyond what is held, then first by group
    id. Unknown costs are 2^30. Without an obligation, or with one that has no group, it is empty."""
    names = sorted(groups)
    price = lambda ids: sum(cost.get(i, 1 << 30) for i in ids)
    count = 1
    for n in names:
        count *= max(1, len(groups[n]))
    if not names or any(not groups[n] for n in names):
        return []
    if count <= exact:
        best = None
        for choice in product(*(sorted(groups[n]) for n in names)):
            ids = frozenset().union(*(g for _, g in choice))
            key = (price(ids), len(ids), sorted(ids), [n for n, _ in choice])
            if best is None or key < best:
                best = key
        return best[2]
    held: frozenset = frozenset()
    for n in names:
        held |= min(groups[n], key=lambda g: (price(g[1] - held), len(g[1] - held), g[0]))[1]
    return sorted(held)


def _per_task(witness: DataFrame, task: str, obligation: str, group: str, evidence: str, cost: str, mandatory: str | None) -> DataFrame:
    """(task, rows): each task's witness rows as one array, collected by an aggregate."""
    must = F.coalesce(F.col(mandatory), F.lit(False)) if mandatory else F.lit(True)
    row = F.struct(F.col(obligation).cast("string").alias("o"), F.col(group).cast("string").alias("g"), F.col(evidence).cast("string").alias("e"), F.col(cost).cast("long").alias("c"), must.alias("m"))
    return witness.groupBy(task).agg(F.array_sort(F.collect_set(row)).alias("rows"))


def _groups(rows) -> tuple[dict, dict, set]:
    """Groups by obligation, costs, and the mandatory obligations. An obligation may have no group: nulls are none."""
    members: dict = {}
    costs: dict = {}
    must = set()
    for r in rows:
        own = members.setdefault(r["o"], {})
        if r["g"] is not None and r["e"] is not None:
            own.setdefault(r["g"], set()).add(r["e"])
        if r["m"]:
            must.add(r["o"])
        if r["c"] is not None and r["e"] is not None:
            costs[r["e"]] = min(r["c"], costs.get(r["e"], r["c"]))
    return {o: [(g, frozenset(ids)) for g, ids in sorted(gs.items())] for o, gs in members.items()}, costs, must


def _state(groups: dict, must: set, held: frozenset) -> tuple[float, float]:
    """Completion over the mandatory obligations and mean progress over all, 0 where there are none."""
    shares = {o: max((len(g & held) / len(g) for _, g in gs), default=0.0) for o, gs in groups.items()}
    own = [shares[o] >= 1 for o in must]
    return (round(sum(own) / len(own), 9) if own else 0.0), (round(sum(shares.values()) / len(shares), 9) if shares else 0.0)


def order(groups: dict, costs: dict, must: set) -> list[tuple]:
    """(step, evidence, completion, progress): the way from nothing to the certificate, all of it. Each step takes what
    completes most, then adds most progress, then costs least (unknown costs are 0), then has the larger id."""
    left = set(certificate({o: groups[o] for o in must}, costs))
    held: frozenset = frozenset()
    rows: list[tuple] = []
    while left:
        pick = max(left, key=lambda i: (*_state(groups, must, held | {i}), -costs.get(i, 0), i))
        held |= {pick}
        left.discard(pick)
        c, p = _state(groups, must, held)
        rows.append((len(rows) + 1, pick, round(c, 6), round(p, 6)))
    return rows


def minimised(complete: list[str], groups: dict, costs: dict, must: set) -> list[str]:
    """What a complete state can do with, in its order: the dearest evidence goes first as long as the rest completes
    everything; ties by id. A state that isn't complete gives nothing."""
    enough = lambda ids: bool(must) and _state(groups, must, frozenset(ids))[0] >= 1 - 1e-6
    own = list(dict.fromkeys(complete))
    if not enough(own):
        return []
    keep = set(own)
    for i in sorted(own, key=lambda x: (-costs.get(x, 0), x)):
        if len(keep) > 1 and enough(keep - {i}):
            keep.discard(i)
    return [i for i in own if i in keep]


def certificates(witness: DataFrame, task: str, obligation: str, group: str, evidence: str, cost: str, mandatory: str | None = None) -> DataFrame:
    """(task, certificate, cost) of every task, of its mandatory obligations; all are where no column tells."""
    ship(witness.sparkSession)

    @F.udf("struct<certificate:array<string>,cost:bigint>", useArrow=True)
    def run(rows):
        groups, costs, must = _groups(rows)
        chosen = certificate({o: groups[o] for o in must}, costs)
        return chosen, sum(costs.get(i, 1 << 30) for i in chosen)

    return _per_task(witness, task, obligation, group, evidence, cost, mandatory).select(task, run("rows").alias("x")).select(task, "x.*")


def acquisition_order(witness: DataFrame, task: str, obligation: str, group: str, evidence: str, cost: str, mandatory: str | None = None) -> DataFrame:
    """(task, step, evidence, completion, progress): the order in which each task's certificate is acquired."""
    ship(witness.sparkSession)

    @F.udf("array<struct<step:int,evidence:string,completion:double,progress:double>>", useArrow=True)
    def run(rows):
        return order(*_groups(rows))

    return _per_task(witness, task, obligation, group, evidence, cost, mandatory).select(task, F.explode(run("rows")).alias("x")).select(task, "x.*")


def minimal_states(complete: DataFrame, witness: DataFrame, task: str, obligation: str, group: str, evidence: str, cost: str, mandatory: str | None = None) -> DataFrame:
    """(task, kept): of complete states (task, pos, evidence) what they can do with."""
    ship(witness.sparkSession)
    state = complete.groupBy(task).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(evidence).cast("string").alias("e")))), lambda x: x["e"]).alias("ids"))

    @F.udf("array<string>", useArrow=True)
    def run(ids, rows):
        return minimised(list(ids), *_groups(rows))

    return state.join(_per_task(witness, task, obligation, group, evidence, cost, mandatory), task).select(task, run("ids", "rows").alias("kept"))
