"""Releases: digests, parts of bounded size, and the audit of what was staged. Files are read as streams by executors."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship

OFFLINE = ("obligations", "evidence_labels", "modified_files", "gold_patch", "test_patch")


def offline_view(tasks: DataFrame, split: str | None = None) -> DataFrame:
    """The columns for evaluation only, by task: null lists are empty, null texts are empty texts; a missing column is
    empty. With `split`, only its tasks."""
    own = tasks if split is None else tasks.where(F.col("split") == split)
    kinds = dict(own.dtypes)

    def filled(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        empty = F.lit("") if kinds[c] == "string" else F.array().cast(kinds[c])
        return F.coalesce(F.col(c), empty).alias(c)

    return own.select("task_id", *(filled(c) for c in OFFLINE))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table if it has all columns, else an error that names what it lacks."""
    lack = [c for c in columns if c not in df.columns]
    if lack:
        raise ValueError(f"missing columns: {', '.join(lack)}")
    return df


def split_scan(spark: SparkSession, path: str, split: str, columns: list[str], seed: int | None = None) -> DataFrame:
    """The rows of one split; row groups whose statistics exclude it are skipped by the pushed filter. With a seed the
    rows come in an order by hash, the same in every run."""
    df = required(spark.read.parquet(path), [*columns, "split"]).where(F.col("split") == split).select(*columns)
    return df if seed is None else df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns)


def file_evidence(units: DataFrame, scoreable_only: bool = True) -> DataFrame:
    """A file's units in the order of their place: (file_version_id, evidence_id, start_line, end_line, place)."""
    from corvane.operators.ranking import ranked

    own = units.where("scoreable") if scoreable_only else units
    x = own.select("file_version_id", "evidence_id", "start_line", "end_line")
    return ranked(x, ["file_version_id"], [F.col("start_line"), F.col("end_line"), F.col("evidence_id")], out="place")


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """The table; the job fails on the first key that occurs twice."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    return df.join(n, key).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))).drop("_n")


def insert_new(held: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """What is held, and of the incoming rows the first of each key that isn't held."""
    fresh = incoming.join(held.select(*key), key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*fresh.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return held.unionByName(first)


def orphans(actions: DataFrame, states: DataFrame, state: str = "state_id", kind: str = "action_type") -> DataFrame:
    """(code, state): actions without a state, and states whose number of STOP actions isn't one."""
    lost = actions.join(states.select(state), state, "left_anti").select(F.lit("ORPHAN_ACTION").alias("code"), state).distinct()
    stops = actions.groupBy(state).agg(F.count_if(F.col(kind) == "stop").alias("_n"))
    bad = states.join(stops, state, "left").where(F.coalesce("_n", F.lit(0)) != 1).select(F.lit("STOP_COUNT").alias("code"), state)
    return lost.unionByName(bad)


def sha256_file(path: str, block: int = 1 << 20) -> str:
    """The digest of a local file, read block by block."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def sha256_folder(folder: str) -> str:
    """One digest of a folder: of the relative paths and digests of its files, in the order of paths."""
    h = hashlib.sha256()
    for root, _, names in sorted(os.walk(folder)):
        for n in sorted(names):
            full = os.path.join(root, n)
            h.update(os.path.relpath(full, folder).replace(os.sep, "/").encode() + b"\0" + sha256_file(full).encode())
    return h.hexdigest()


def split_parts(path: str, folder: str, size: int = 100 << 20) -> dict:
    """Cuts a file into parts of at most `size` bytes in `folder`; the manifest has their digests and the file's own."""
    os.makedirs(folder, exist_ok=True)
    parts, whole = [], hashlib.sha256()
    with open(path, "rb") as f:
        while True:
            name = f"{os.path.basename(path)}.part{len(parts):05d}"
            left, h, n = size, hashlib.sha256(), 0
            with open(os.path.join(folder, name), "wb") as out:
                while left and (b := f.read(min(left, 1 << 20))):
                    out.write(b)
                    h.update(b)
                    whole.update(b)
                    left -= len(b)
                    n += len(b)
            if not n and parts:
                os.remove(os.path.join(folder, name))
                break
            parts.append({"name": name, "bytes": n, "sha256": h.hexdigest()})
            if n < size:
                break
    return {"file": os.path.basename(path), "bytes": sum(p["bytes"] for p in parts), "sha256": whole.hexdigest(), "parts": parts}


def merge_parts(manifest: dict, folder: str, target: str) -> str:
    """Puts a file together from its parts. A part or a whole with another digest is an error and leaves no target."""
    staged, whole = target + ".staged", hashlib.sha256()
    with open(staged, "wb") as out:
        for p in manifest["parts"]:
            h = hashlib.sha256()
            with open(os.path.join(folder, p["name"]), "rb") as f:
                while b := f.read(1 << 20):
                    h.update(b)
                    whole.update(b)
                    out.write(b)
            if h.hexdigest() != p["sha256"]:
                os.remove(staged)
                raise ValueError(f"digest of part {p['name']}")
    if whole.hexdigest() != manifest["sha256"]:
        os.remove(staged)
        raise ValueError("digest of the whole file")
    os.replace(staged, target)
    return target


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a folder that executors can read, each read by one task."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def staged_audit(spark: SparkSession, reports: list[dict], schemas: dict[str, str]) -> list[dict]:
    """Findings (code, path, detail) on staged parquet tables: missing, of another schema, with other numbers of rows or
    bytes than their reports say. Rows are counted from the footers."""
    from corvane.sources.sinks import _fs

    found = []
    for r in reports:
        p, fs = _fs(spark, r["path"])
        if not fs.exists(p):
            found.append({"code": "MISSING", "path": r["path"], "detail": ""})
            continue
        df = spark.read.parquet(r["path"])
        want = schemas.get(os.path.basename(r["path"]))
        if want and df.schema.simpleString() != want:
            found.append({"code": "SCHEMA", "path": r["path"], "detail": df.schema.simpleString()})
        n, size = df.count(), fs.getContentSummary(p).getLength()
        if n != r["rows"]:
            found.append({"code": "ROWS", "path": r["path"], "detail": f"{n} instead of {r['rows']}"})
        if size != r["bytes"]:
            found.append({"code": "BYTES", "path": r["path"], "detail": f"{size} instead of {r['bytes']}"})
    return found
