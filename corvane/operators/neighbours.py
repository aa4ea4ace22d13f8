"""Labels of single pieces of evidence and of pairs of neighbours, in one pass over each task's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.policy import EPS
from corvane.session import ship

#: Rows that are labelled at once, as far as whole tasks allow, and pairs of gains that are compared at once.
ROWS, PAIRS = 40_000, 2_000_000


def label_neighbours(lines: DataFrame) -> DataFrame:
    """(task, first, second, token_cost, completion_gain, progress_gain, completion_interaction, progress_interaction,
    complement, substitute, semantic_useful, pareto_dominated, completion, label): what label_actions says of one state a
    task, whose actions are each piece of evidence that isn't held and each pair that follows on another in its order.

    `lines` has task, obligation, mandatory, grp, evidence, cost, held. All evidence is witness, so no label of an action
    is unknown; the least cost counts, unknown ones are 0. A row without evidence makes its group larger, and one without
    obligation or group counts as a group of which nothing can be held. STOP has no first; completion is the state's.

    Rows are shuffled by task once. Instead of joins of actions with groups, Arrow batches of whole tasks are labelled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [lines.schema[c].dataType for c in ("task", "evidence")]
    task_type, evidence_type = map(to_arrow_type, kinds)

    def starts(column):
        """Whether a row differs from the one before; nulls are equal."""
        there = column.is_valid().to_numpy(zero_copy_only=False)
        other = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
        return np.append(True, other | (there[1:] != there[:-1])), there

    def codes(column):
        """From 1; 0 is null."""
        x = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return x, int(x.max()) + 1

    def changes(x):
        return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])

    def six(x):
        return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)

    def dominated(task, c, p, t):
        """Whether another action of the task is as good in all and better in one; not where completion isn't defined."""
        out, at = np.zeros(len(c), bool), np.flatnonzero(~np.isnan(c))
        at = at[np.lexsort((t[at], p[at], c[at], task[at]))]
        task, c, p, t = (x[at] for x in (task, c, p, t))
        new = np.append(True, (task[1:] != task[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (t[1:] != t[:-1]))[: len(at)]
        point, task, c, p, t = np.cumsum(new) - 1, task[new], c[new], p[new], t[new]
        begin = np.searchsorted(task, task)
        n = np.searchsorted(task, task, "right") - begin
        total, found, i = np.append(0, np.cumsum(n)), np.zeros(len(task), bool), 0
        while i < len(task):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(i, j), n[i:j])
            y = np.arange(total[i], total[j]) - total[x] + begin[x]
            weak = (c[y] >= c[x] - EPS) & (p[y] >= p[x] - EPS) & (t[y] <= t[x])
            better = weak & ((c[y] > c[x] + EPS) | (p[y] > p[x] + EPS) | (t[y] < t[x]))
            found[i:j] = np.logical_or.reduceat(better, total[i:j] - total[i])
            i = j
        out[at] = found[point]
        return out

    def label(rows):
        task, evidence = rows.column("task"), rows.column("evidence")
        new_task, _ = starts(task)
        new, there = starts(evidence)
        new |= new_task
        tid, eid, head = np.cumsum(new_task) - 1, np.cumsum(new) - 1, np.flatnonzero(new)
        e_task, known, held = tid[head], there[head], rows.column("held").to_numpy(zero_copy_only=False)[head]
        none = np.iinfo(np.int64).max
        cost = np.minimum.reduceat(rows.column("cost").fill_null(none).to_numpy(zero_copy_only=False), head)
        cost[cost == none] = 0
        (o, no), (g, ng) = codes(rows.column("obligation")), codes(rows.column("grp"))
        key, row = np.unique((eid * no + o) * ng + g, return_index=True)
        e, must, counts = key // (no * ng), rows.column("mandatory").fill_null(False).to_numpy(zero_copy_only=False)[row], (o[row] > 0) & (g[row] > 0)
        counts &= known[e]

        groups, gid = np.unique((e_task[e] * no + o[row]) * ng + g[row], return_inverse=True)
        size, has = np.bincount(gid), np.bincount(gid[counts & held[e]], minlength=len(groups))
        first = changes(groups // ng)
        oid = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(groups))))
        o_task, best = groups[first] // (no * ng), np.maximum.reduceat(has / size, first)
        must = np.bincount(oid[gid], must) > 0
        tasks = int(tid[-1]) + 1
        each, needed, met, total = (np.bincount(o_task[k], w, tasks) for k, w in ((slice(None), None), (must, None), (must & (best >= 1), None), (slice(None), best)))
        done, progress = six(met / needed), six(total / each)

        free = np.flatnonzero(known & ~held)
        n, at = len(free), np.flatnonzero(e_task[free][1:] == e_task[free][:-1])
        left, right = np.append(np.arange(n), at), np.append(np.arange(n), at + 1)
        a, many = e_task[free][left], len(left)
        t = cost[free][left]
        t[n:] += cost[free][right[n:]]
        as_left, as_right = np.full(n, -1), np.full(n, -1)
        as_left[at] = as_right[at + 1] = n + np.arange(len(at))
        place = np.full(len(head), -1)
        place[free] = np.arange(n)
        hit = counts & (place[e] >= 0)
        f, act = place[e[hit]], np.concatenate([place[e[hit]], as_left[place[e[hit]]], as_right[place[e[hit]]]])
        side, key = np.repeat([0, 1, 2], len(f))[act >= 0], (act * len(groups) + np.tile(gid[hit], 3))[act >= 0]
        order = np.argsort(key, kind="stable")
        key, side = key[order], side[order]
        by = changes(key)
        add, side = np.diff(np.append(by, len(key))), np.bitwise_or.reduceat(side, by)
        act, k = np.divmod(key[by], len(groups))
        whole = np.where((add == 1) & (has[k] + 1 == size[k]), side, 0)
        by = changes(act * len(first) + oid[k])
        after, both, whole = np.maximum.reduceat((has[k] + add) / size[k], by), np.logical_or.reduceat(add == 2, by), np.bitwise_or.reduceat(whole, by)
        act, k = act[by], oid[k[by]]
        more = np.bincount(act[must[k] & (after >= 1) & (best[k] < 1)], minlength=many)
        rise = np.bincount(act, np.maximum(after - best[k], 0), many)
        c = six(six((met[a] + more) / needed[a]) - done[a])
        p = six(six((total[a] + rise) / each[a]) - progress[a])
        ci, pi = (np.append(np.full(n, np.nan), x[n:] - x[left[n:]] - x[right[n:]]) for x in (c, p))
        complement, substitute = np.bincount(act[both], minlength=many) > 0, np.bincount(act[(whole == 3) & ~both], minlength=many) > 0
        useful = (c > EPS) | ((np.abs(c) <= EPS) & (p > EPS))
        beaten = dominated(a, c, p, t)
        good = useful & ~beaten & ~(done[a] == 1)

        flag = lambda x, stop, unknown=None: pa.array(np.append(x, stop), mask=unknown)
        number = lambda x: pa.array(x, mask=np.isnan(x))
        gap, last, no_goal = np.full(tasks, np.nan), np.zeros(tasks, bool), np.isnan(done)
        of = lambda places, absent: evidence.take(pa.array(np.append(head[free][places], np.zeros(tasks, np.int64)), mask=np.append(absent, ~last)))
        kind = np.append(good.astype(np.int32), np.where(no_goal, 2, done == 1))
        return pa.RecordBatch.from_arrays(
            [task.take(pa.array(np.append(head[free][left], np.flatnonzero(new_task)))), of(left, np.zeros(many, bool)), of(right, np.arange(many) < n), pa.array(np.append(t, np.zeros(tasks, np.int64))),
             number(np.append(c, np.where(no_goal, np.nan, 0.0))), pa.array(np.append(p, np.zeros(tasks))), number(np.append(ci, gap)), number(np.append(pi, gap)), flag(complement, last), flag(substitute, last),
             flag(useful, last, np.append(np.zeros(many, bool), no_goal)), flag(beaten, last, np.append(np.zeros(many, bool), ~last)), number(np.append(done[a], done)), pa.array(["negative", "positive", "unknown"]).take(pa.array(kind))],
            names=names,
        )

    def stream(batches):
        parts, count, enough = [], 0, ROWS
        with np.errstate(invalid="ignore", divide="ignore"):
            for batch in batches:
                parts.append(batch)
                count += batch.num_rows
                if count < enough:
                    continue
                rows = pa.Table.from_batches(parts).combine_chunks()
                whole = pc.sum(pc.not_equal(rows.column("task"), rows.column("task")[-1])).as_py() or 0
                if whole:
                    yield label(pa.Table.to_batches(rows.slice(0, whole).combine_chunks())[0])
                parts = rows.slice(whole).to_batches()
                count -= whole
                enough = max(ROWS, 2 * count)
            if count:
                yield label(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    schema = {"task": kinds[0].simpleString(), "first": kinds[1].simpleString(), "second": kinds[1].simpleString(), "token_cost": "bigint"}
    schema |= dict.fromkeys(("completion_gain", "progress_gain", "completion_interaction", "progress_interaction"), "double") | dict.fromkeys(("complement", "substitute", "semantic_useful", "pareto_dominated"), "boolean")
    schema |= {"completion": "double", "label": "string"}
    names = list(schema)
    rows = lines.where("task is not null").select("task", "obligation", "mandatory", "grp", "evidence", F.col("cost").cast("bigint").alias("cost"), F.coalesce("held", F.lit(False)).alias("held"))
    ship(lines.sparkSession)
    return rows.repartition("task").sortWithinPartitions("task", "evidence").mapInArrow(stream, ", ".join(f"{c} {k}" for c, k in schema.items()))
