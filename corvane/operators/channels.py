"""Retrieval over channels: terms of contents, paths and symbols, and structure, within each task's own candidates.

universe: task, evidence, the units that a task may see. units: evidence, path, symbol, content. asked: task, term, with
a dimension where queries come in groups. A unit's terms are counted once, however many tasks see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import distinct_terms
from corvane.operators.ranking import ranked, rrf, unit_vectors
from corvane.session import materialize, ship

DEPTH = 64


def asked_terms(tasks: DataFrame, text: str = "question") -> DataFrame:
    """(task, term): all distinct terms of a question."""
    return tasks.select("task", F.explode(distinct_terms(F.col(text))).alias("term"))


def _rank_within(universe: DataFrame, vectors: DataFrame, asked: DataFrame, by: tuple, depth: int | None, score, scopes: DataFrame | None, held: DataFrame | None) -> DataFrame:
    """(by, evidence, score, rank): `score` of the units of a scope for each group of terms that a task of it asks for.

    Without `scopes` each task is a scope of its own. With them (task, scope), universe has scope, evidence: a unit's
    counts go once to each scope, not to each task, and no pair of task and unit is a row before the cut. `held` (task,
    evidence) is no candidate of its task. A task of Spark holds the counts of one scope at a time."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if scopes is None:
        universe = universe.select(F.col("task").alias("scope"), "evidence")
        scopes = universe.select(F.col("scope").alias("task"), "scope")
    kinds = {c: asked.schema[c].dataType for c in by} | {"evidence": vectors.schema["evidence"].dataType}
    own = asked.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.collect_set(F.xxhash64("term")).alias("terms")).join(scopes.distinct(), "task")
    if held is not None:
        own = own.join(held.where("evidence is not null").groupBy("task").agg(F.collect_set("evidence").alias("held")), "task", "left")
    else:
        own = own.withColumn("held", F.lit(None).cast(f"array<{kinds['evidence'].simpleString()}>"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    wide = ["scope", "is_row", *by, "held", "evidence", "length", "terms", "tfs"]
    rows = universe.where("scope is not null").select("scope", "evidence").distinct().join(vectors, "evidence")
    rows = rows.select("scope", F.lit(True).alias("is_row"), *(none(c, kinds[c]) for c in by), none("held", own.schema["held"].dataType), "evidence", "length", "terms", "tfs")
    own = own.select("scope", F.lit(False).alias("is_row"), *by, "held", none("evidence", kinds["evidence"]), none("length", "int"), "terms", none("tfs", "array<int>"))
    both = own.unionByName(rows).select(*wide).repartition("scope").sortWithinPartitions("scope", "is_row", "evidence")
    types = [to_arrow_type(k) for k in kinds.values()]

    def ranks(tasks, parts):
        names = [n for p in parts for n in p[0]]
        length, number, terms, tf = (np.concatenate(x) for x in list(zip(*parts))[1:])
        order = np.argsort(terms, kind="stable")
        row, tf = np.repeat(np.arange(len(names)), number)[order], tf[order]
        known, first = np.unique(terms[order], return_index=True)
        cut = np.append(first, len(order))
        place = {}
        for *group, gone, wanted in tasks:
            free = np.ones(len(names), bool)
            if gone:
                place = place or {n: i for i, n in enumerate(names)}
                free[[place[n] for n in gone if n in place]] = False
            at = np.searchsorted(known, wanted)
            at = at[at < len(known)][known[at[at < len(known)]] == wanted[at < len(known)]]
            spans = [np.arange(cut[k], cut[k + 1]) for k in np.sort(at)]
            spans = [x for x in (s[free[row[s]]] for s in spans) if len(x)]
            if not spans:
                continue
            hit, df = np.concatenate(spans), np.repeat([len(s) for s in spans], [len(s) for s in spans])
            r = row[hit]
            s = np.bincount(r, score(tf[hit], df, length[r], free.sum(), length[free].mean() or 1.0), len(names))
            s = np.floor(s * 1e6 + 0.5) / 1e6
            found = np.flatnonzero(s > 0)
            found = found[np.lexsort((found, -s[found]))][:depth]
            yield group, [names[i] for i in found], s[found]

    def stream(batches):
        scope, tasks, parts, out = None, [], [], []

        def batch_of(out):
            group = [[g[k] for g, n, _ in out for _ in n] for k in range(len(by))]
            return pa.RecordBatch.from_arrays([*(pa.array(g, t) for g, t in zip(group, types)), pa.array([x for _, n, _ in out for x in n], types[-1]), pa.array(np.concatenate([s for *_, s in out])), pa.array(np.concatenate([np.arange(len(n)) + 1 for _, n, _ in out]), pa.int32())], [*by, "evidence", "score", "rank"])

        for batch in batches:
            x = dict(zip(wide, batch.columns))
            names, is_row = x["scope"].to_pylist(), x["is_row"].to_pylist()
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i] and is_row[j] == is_row[i]:
                    j += 1
                if names[i] != scope:
                    out += ranks(tasks, parts) if tasks and parts else []
                    scope, tasks, parts = names[i], [], []
                part = {c: v.slice(i, j - i) for c, v in x.items()}
                if is_row[i]:
                    parts.append((part["evidence"].to_pylist(), part["length"].to_numpy(), np.diff(part["terms"].offsets.to_numpy()), part["terms"].flatten().to_numpy(), part["tfs"].flatten().to_numpy()))
                else:
                    tasks += zip(*(part[c].to_pylist() for c in (*by, "held")), [v.values.to_numpy() for v in part["terms"]])
                i = j
            if sum(len(n) for _, n, _ in out) > 10_000:
                yield batch_of(out)
                out = []
        out += ranks(tasks, parts) if tasks and parts else []
        if out:
            yield batch_of(out)

    ship(asked.sparkSession)
    return both.mapInArrow(stream, ", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()) + ", score double, rank int")


def candidate_bm25(universe: DataFrame, vectors: DataFrame, asked: DataFrame, by: tuple = ("task",), depth: int | None = DEPTH, k1: float = 1.2, b: float = 0.75, scopes: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """(by, evidence, score, rank): BM25 with the number of documents, the mean length and the document frequencies of
    the task's own candidates. `by` is task, or task and dimension for one ranking per group of terms."""
    import numpy as np

    def score(tf, df, length, n, mean):
        return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    return _rank_within(universe, vectors, asked, by, depth, score, scopes, held)


def candidate_overlap(universe: DataFrame, vectors: DataFrame, asked: DataFrame, depth: int | None = DEPTH, scopes: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """(task, evidence, score, rank): the number of distinct terms that a unit shares with the question."""
    return _rank_within(universe, vectors, asked, ("task",), depth, lambda tf, *_: (tf > 0).astype(float), scopes, held)


def overlap(universe: DataFrame, units: DataFrame, text: Column, asked: DataFrame, explicit: DataFrame | None = None, depth: int | None = DEPTH) -> DataFrame:
    """(task, evidence, score, rank): the distinct terms that a unit's path or symbol shares with the question, 4 more
    for one that equals a name given in `explicit` (task, name) whatever its case, and 2 more if it ends with one."""
    own = universe.select("task", "evidence").distinct()
    terms = units.select("evidence", F.explode(distinct_terms(text)).alias("term"))
    vocabulary = asked.select("term").distinct()
    hits = own.join(terms.join(vocabulary, "term", "left_semi"), "evidence").join(asked.select("task", "term").distinct(), ["task", "term"])
    score = hits.groupBy("task", "evidence").agg(F.count("*").cast("int").alias("score"))
    if explicit is not None:
        # Ends are matched by equality: of a name, its length is that of the end to compare.
        names = explicit.select("task", F.lower("name").alias("name")).where("name <> ''").distinct()
        full = F.lower(text)
        named = own.join(units.select("evidence", full.alias("full")), "evidence").join(names.groupBy("task").agg(F.collect_set("name").alias("names")), "task")
        bonus = F.when(F.exists("names", lambda n: F.col("full") == n), 4).otherwise(0) + F.when(F.exists("names", lambda n: F.endswith(F.col("full"), n)), 2).otherwise(0)
        named = named.select("task", "evidence", bonus.alias("score")).where("score > 0")
        score = score.unionByName(named).groupBy("task", "evidence").agg(F.sum("score").cast("int").alias("score"))
    return ranked(score, ["task"], [F.col("score").desc(), F.col("evidence")], depth)


def structure(universe: DataFrame, selected: DataFrame, edges: DataFrame, depth: int | None = DEPTH, scopes: DataFrame | None = None) -> DataFrame:
    """(task, evidence, score, rank): how many held units have an edge (source, target) to a candidate that isn't held.
    With `scopes` (task, scope), universe has scope, evidence."""
    held = selected.select("task", F.col("evidence").alias("source")).distinct()
    x = held.join(edges.select("source", F.col("target").alias("evidence")).distinct(), "source").groupBy("task", "evidence").agg(F.count("*").cast("int").alias("score"))
    x = x.join(selected.select("task", "evidence"), ["task", "evidence"], "left_anti")
    x = x.join(scopes.distinct(), "task").join(universe.select("scope", "evidence"), ["scope", "evidence"], "left_semi") if scopes is not None else x.join(universe.select("task", "evidence"), ["task", "evidence"], "left_semi")
    return ranked(x.select("task", "evidence", "score"), ["task"], [F.col("score").desc(), F.col("evidence")], depth)


def query_channels(universe: DataFrame, units: DataFrame, asked: DataFrame, depth: int | None = None, scopes: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """(task, channel, evidence, score, rank) of the channels that depend on the question alone, ranked once per task."""
    seen = units.join(universe.select("evidence").distinct(), "evidence", "left_semi")
    vectors = lambda c: unit_vectors(seen.select("evidence", c), asked, "evidence", c)
    named = lambda name, df: df.select("task", F.lit(name).alias("channel"), "evidence", "score", "rank")
    return (
        named("bm25_content", candidate_bm25(universe, vectors("content"), asked, depth=depth, scopes=scopes, held=held))
        .unionByName(named("path_name", candidate_overlap(universe, vectors("path"), asked, depth, scopes, held)))
        .unionByName(named("symbol", candidate_overlap(universe, vectors("symbol"), asked, depth, scopes, held)))
    )


def channels_for_state(precomputed: DataFrame, universe: DataFrame, selected: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(task, channel, evidence, rank): the precomputed rankings without what a state holds, ranked anew and cut at
    `depth`, with the structure channel of what it holds."""
    free = precomputed.join(universe.select("task", "evidence").distinct(), ["task", "evidence"], "left_semi").join(selected.select("task", "evidence"), ["task", "evidence"], "left_anti")
    again = ranked(free.select("task", "channel", "evidence", F.col("rank").alias("_old")), ["task", "channel"], [F.col("_old")], depth).drop("_old")
    return again.unionByName(structure(universe, selected, edges, depth).select("task", F.lit("structure").alias("channel"), "evidence", "rank"))


def four_channels(universe: DataFrame, units: DataFrame, asked: DataFrame, selected: DataFrame, edges: DataFrame, depth: int = DEPTH, scopes: DataFrame | None = None) -> DataFrame:
    """(task, channel, evidence, rank) of bm25_content, path_name, symbol and structure. What a state holds is no
    candidate, so that counts and lengths are those of the rest. With `scopes` (task, scope), universe has scope,
    evidence."""
    own = query_channels(universe, units, asked, depth, scopes, selected).select("task", "channel", "evidence", "rank")
    return own.unionByName(structure(universe, selected, edges, depth, scopes).select("task", F.lit("structure").alias("channel"), "evidence", "rank"))


def retrieve(universe: DataFrame, files: DataFrame, units: DataFrame, asked: DataFrame, paths: DataFrame, symbols: DataFrame, selected: DataFrame, edges: DataFrame, limit: int = 64, file_limit: int = 32, per_query: int = 16) -> DataFrame:
    """(task, evidence, score, sources, rank): the whole pipeline. Files are ranked by each dimension's terms and by the
    paths that are named, and fused; the best files' units are ranked by content, each dimension fused, by path and by
    symbol, joined by the structure around what is held, and fused.

    universe: task, file. files: file, path, content. units: evidence, file, path, symbol, content, those that may be
    scored. asked: task, dimension, term. paths and symbols: task, name. selected: task, evidence."""
    as_unit = universe.select("task", F.col("file").alias("evidence"))
    post = unit_vectors(files.select(F.col("file").alias("evidence"), "content"), asked)
    by_dimension = candidate_bm25(as_unit, post, asked, ("task", "dimension"), per_query).select("task", F.concat(F.lit("fts:"), "dimension").alias("channel"), "evidence", "rank")
    ends = F.exists("names", lambda n: F.endswith(F.lower("path"), n))
    wanted = paths.where("name <> ''").groupBy("task").agg(F.collect_set(F.lower(F.translate("name", "\\", "/"))).alias("names"))
    explicit = as_unit.join(files.select(F.col("file").alias("evidence"), "path"), "evidence").join(wanted, "task").where(ends)
    explicit = ranked(explicit.select("task", "evidence", "path"), ["task"], [F.col("path"), F.col("evidence")]).select("task", F.lit("explicit_path").alias("channel"), "evidence", "rank")
    best = materialize(rrf(by_dimension.unionByName(explicit), "task", "channel", "evidence", "rank", limit=file_limit).select("task", F.col("evidence").alias("file")), "files")
    held = selected.select("task", "evidence").distinct()
    own = materialize(best.join(units.select("file", "evidence"), "file").select("task", "evidence").distinct().join(held, ["task", "evidence"], "left_anti"), "candidates")
    near = units.join(own.select("evidence").distinct(), "evidence", "left_semi")
    post = unit_vectors(near, asked)
    content = candidate_bm25(own, post, asked, ("task", "dimension"), limit).select("task", F.col("dimension").alias("channel"), "evidence", "rank")
    content = rrf(content, "task", "channel", "evidence", "rank", limit=limit).select("task", F.lit("content").alias("channel"), "evidence", "rank")
    path = overlap(own, near, F.translate(F.coalesce("path", F.lit("")), "\\", "/"), asked, paths, limit).select("task", F.lit("path").alias("channel"), "evidence", "rank")
    symbol = overlap(own, near, F.coalesce("symbol", F.lit("")), asked, symbols, limit).select("task", F.lit("symbol").alias("channel"), "evidence", "rank")
    around = held.join(edges.select(F.col("source").alias("evidence"), "target"), "evidence").select("task", F.col("target").alias("evidence")).join(units.select("evidence"), "evidence", "left_semi")
    around = structure(around, held, edges, limit).select("task", F.lit("structure").alias("channel"), "evidence", "rank")
    # Each is written, so that what one shuffles is gone before the next begins, and the driver plans them one by one.
    content, path, symbol, around = (materialize(x, "channel") for x in (content, path, symbol, around))
    return rrf(content.unionByName(path).unionByName(symbol).unionByName(around), "task", "channel", "evidence", "rank", limit=limit)


def best_chunk(scores: DataFrame, by: str, item: str, score: str = "score", limit: int | None = None) -> DataFrame:
    """(by, item, score, rank): an item counts by its best chunk, as a reranker or a dense index scores chunks."""
    x = scores.where(F.col(score).isNotNull()).groupBy(by, item).agg(F.max(score).alias("score"))
    return ranked(x, [by], [F.col("score").desc(), F.col(item)], limit)
