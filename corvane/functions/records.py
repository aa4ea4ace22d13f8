"""Normalisers of raw task records and small codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import normal_path, stable_id

# Names of the upstream splits and parts of paths that tell a file's kind.
SPLITS = {"train": "train", "dev": "validation", "test": "benchmark"}
VENDOR_PARTS = ("/vendor/", "/vendors/", "/third_party/", "/third-party/", "/node_modules/", "/site-packages/", "/.venv/", "/venv/")
GENERATED_PARTS = ("/dist/", "/build/", "/generated/", "/gen/", "/coverage/")
GENERATED_ENDS = (".min.js", ".min.css", ".generated.py", ".generated.ts")
TEST_DIRS = ("test", "tests", "testing", "spec", "specs")
TEST_ENDS = ("_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
ASSET_EXTENSIONS = ("arrow", "avro", "csv", "feather", "h5", "hdf5", "joblib", "json", "jsonl", "ndjson", "npy", "npz", "onnx", "orc", "parquet", "pb", "pickle", "pkl", "pt", "pth", "snmprec", "tflite", "train", "tsv")
ASSET_PARTS = ("/compose/", "/data/", "/dataset/", "/datasets/", "/fixture/", "/fixtures/", "/model/", "/models/", "/resources/")
ASSET_BYTES = 1_048_576


def strip(text: Column) -> Column:
    """Without white space around; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def repo_name(repo: Column) -> Column:
    """owner/name of a repository given by name or address; null where it isn't one."""
    text = F.translate(strip(repo), "\\", "/")
    text = F.regexp_replace(text, r"(?i)^(?:https?://github\.com/|git@github\.com:)", "")
    text = F.trim(F.regexp_replace(text, r"\.git$", ""), F.lit("/"))
    return F.when(F.size(F.split(text, "/")) == 2, text)


def hint_list(hints: Column) -> Column:
    """Hints given as text: a JSON list of values, a JSON value, or plain text, as the list of its non-blank items."""
    text = strip(hints)
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    items = F.when(text.startswith("["), F.coalesce(F.transform(F.from_json(text, "array<string>"), lambda x: F.coalesce(x, F.lit(""))), F.array(text))).when(text == "null", F.array().cast("array<string>")).otherwise(F.array(F.coalesce(scalar, text)))
    return F.filter(F.transform(items, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def split_of(upstream: Column) -> Column:
    """The split of an upstream split's name; an unknown name is null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SPLITS.items() for x in kv)), upstream)


def tasks_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected) of raw records with instance_id, repo, base_commit, problem_statement, hints_text, language,
    created_at, upstream_split. A record without an id, a commit, a statement, a repository or a known split is rejected
    with the name of what it lacks first. Other columns are ignored."""
    trim = lambda c: strip(c.cast("string"))
    x = records.select(
        trim(F.col("instance_id")).alias("issue_id"), repo_name(F.col("repo")).alias("repo"), F.lower(trim(F.col("base_commit"))).alias("base_commit"), trim(F.col("problem_statement")).alias("problem_statement"),
        hint_list(F.col("hints_text")).alias("hints"), F.lower(F.coalesce(F.nullif(trim(F.col("language")), F.lit("")), F.lit("unknown"))).alias("language"), "created_at", "upstream_split",
        split_of(F.col("upstream_split")).alias("split"))
    lack = F.when(F.col("issue_id") == "", "instance_id").when(F.col("repo").isNull(), "repo").when(F.col("base_commit") == "", "base_commit").when(F.col("problem_statement") == "", "problem_statement").when(F.col("split").isNull(), "split")
    x = x.withColumn("lacks", lack)
    good = x.where("lacks is null").select(
        stable_id("task", F.lit("swebench"), F.col("issue_id")).alias("task_id"), stable_id("group", F.lit("swebench"), F.col("issue_id")).alias("task_group_id"), stable_id("snapshot", F.col("repo"), F.col("base_commit")).alias("snapshot_id"),
        "repo", "base_commit", "language", "issue_id", "problem_statement", "hints", "split", "created_at")
    return good, x.where("lacks is not null").select("issue_id", "upstream_split", "lacks")


def known_only(overlay: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Overlay records whose id the base has, each once per row."""
    return overlay.join(base.select(key).distinct(), key, "left_semi")


def file_kinds(path: Column, text: Column, size: Column, binary: Column | None = None) -> dict[str, Column]:
    """is_test, is_generated, is_vendor, is_binary, searchable of a file with its path, text (null for bytes that are not
    UTF-8) and size in bytes. A file with a NUL in its first 8,192 code points is binary; large data assets, vendored and
    generated files are not searchable."""
    p = F.concat(F.lit("/"), F.trim(F.lower(F.translate(path, "\\", "/")), F.lit("/")), F.lit("/"))
    parts = F.split(F.trim(p, F.lit("/")), "/")
    name = F.element_at(parts, -1)
    among = lambda xs: F.exists(F.array(*(F.lit(x) for x in xs)), lambda x: F.contains(p, x))
    ends = lambda xs: F.exists(F.array(*(F.lit(x) for x in xs)), lambda x: F.endswith(name, x))
    is_binary = text.isNull() | F.contains(F.substring(text, 1, 8192), F.lit("\0"))
    is_binary = is_binary if binary is None else is_binary | binary
    vendor = among(VENDOR_PARTS)
    index = F.endswith(p, F.lit("/docs/api/index.js/")) & F.startswith(F.ltrim(F.coalesce(text, F.lit(""))), F.lit("Index.PACKAGES ="))
    generated = among(GENERATED_PARTS) | ends(GENERATED_ENDS) | index
    asset = (size >= ASSET_BYTES) & (F.regexp_extract(name, r".\.([^.]+)$", 1).isin(*ASSET_EXTENSIONS) | among(ASSET_PARTS))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    test = F.arrays_overlap(folders, F.array(*(F.lit(x) for x in TEST_DIRS))) | F.startswith(name, F.lit("test_")) | ends(TEST_ENDS)
    return {"is_test": test, "is_generated": generated, "is_vendor": vendor, "is_binary": is_binary, "searchable": ~(is_binary | vendor | generated | F.coalesce(asset, F.lit(False)))}


def repo_token(repo: Column) -> Column:
    """repo and 20 hex digits of the SHA-1 of the lower-case name: one word for a full-text index."""
    return F.concat(F.lit("repo"), F.substring(F.sha1(F.lower(repo)), 1, 20))


def file_label(text: Column) -> Column:
    """A name for files: runs of other characters than letters, digits, dots, underscores and hyphens are one hyphen."""
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def review_label(text: Column) -> Column:
    """Upper case with single spaces; null counts as empty."""
    return F.regexp_replace(F.upper(strip(text)), r"\s+", " ")


def token_cost(rendered: Column, raw: Column) -> Column:
    """The rendered count, else the raw one, else 0; zeros and negative counts are no counts."""
    count = lambda c: F.when(c > 0, c)
    return F.coalesce(count(rendered), count(raw), F.lit(0))


def unfenced(text: Column) -> Column:
    """What a Markdown fence around a whole text holds; other texts without space around."""
    t = strip(text)
    inner = F.regexp_extract(t, r"(?s)^```(?:json|JSON)?[^\S\n]*\n?(.*?)\n?[^\S\n]*```$", 1)
    return F.when(t.rlike(r"(?s)^```.*```$"), strip(inner)).otherwise(t)


def salvaged_json(text: Column) -> Column:
    """The first JSON object of a text as a variant: the whole text, else from its first { to its last }; else null."""
    t = unfenced(text)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(inner, F.lit(""))))


def utc_time(text: Column) -> Column:
    """ISO times as UTC time stamps without a zone; a time without a zone is UTC already; others are null."""
    t = strip(text)
    zoned = t.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & F.contains(t, F.lit(":"))
    shown = F.when(zoned, F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()))
    return F.coalesce(shown.cast("timestamp_ntz"), F.when(~zoned, t.try_cast("timestamp_ntz")))


def stable_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with the keys in order; null values are kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def region_list(regions: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, start_line, end_line) of regions given as JSON: a list, or a map of lists. Regions without a path, or
    whose end lies before their start, are left out."""
    kind = "array<struct<path:string,start_line:int,end_line:int>>"
    listed = F.ltrim(F.col(payload)).startswith("[")
    flat = F.when(listed, F.from_json(payload, kind)).otherwise(F.flatten(F.map_values(F.from_json(payload, f"map<string,{kind}>"))))
    x = regions.select(key, F.explode(flat).alias("r")).select(key, normal_path(F.col("r.path")).alias("path"), "r.start_line", "r.end_line")
    return x.where("path <> '' and start_line >= 1 and end_line >= start_line")
