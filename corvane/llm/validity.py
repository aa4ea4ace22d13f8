"""Source files that are not valid in the language of their extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.parsing import EXTENSIONS, first_error
from corvane.session import ship


def judge(evidence: DataFrame) -> DataFrame:
    """(file_version_id, repo, path, language, declared, error_line) of every `file` unit with a judged extension.

    Each text is parsed whole by the table-driven automaton of its extension's language; error_line is the line of the
    first error after which no parse survives, null if the file parses. `declared` is the language that the metadata
    names, which plays no part.

    One narrow stage, then a grouping of its small rows that drops re-delivered ones. Null content counts as empty:
    valid Python, JavaScript and Java, but no Go or JSON. A null path has no extension; other columns are ignored."""
    ship(evidence.sparkSession)
    language = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), F.regexp_extract("path", r"\.(py|js|java|go|json)$", 1))
    src = (
        evidence.where("unit_type = 'file' and file_version_id is not null")
        .select("file_version_id", "repo", "path", language.alias("language"), F.get_json_object("metadata", "$.language").alias("declared"), F.coalesce("content", F.lit("")).alias("content"))
        .where("language is not null")
    )

    def run(frames):
        for f in frames:
            lines = [first_error(k, t) for k, t in zip(f["language"], f["content"])]
            yield f[["file_version_id", "repo", "path", "language", "declared"]].assign(error_line=pd.array([x or None for x in lines], "Int32"))

    out = src.mapInPandas(run, "file_version_id string, repo string, path string, language string, declared string, error_line int")
    return out.groupBy("file_version_id").agg(F.max("repo").alias("repo"), F.max("path").alias("path"), F.max("language").alias("language"), F.max("declared").alias("declared"), F.max("error_line").alias("error_line"))


def rates(judged: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate)."""
    return judged.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("error_line").alias("invalid"), F.round(F.count("error_line") / F.count("*"), 6).alias("rate"))
