"""Cutting files into units: Python definitions by the interpreter's parser, other texts by line windows."""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship

WORD = re.compile(r"\w+|[^\w\s]")
SCHEMA = "unit_no int, unit_type string, symbol string, qualified_name string, start_line int, end_line int, parent_no int, tokens int, scoreable boolean"
DEFINITIONS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def windows(lines: list[str], first: int, last: int, limit: int) -> list[tuple[int, int]]:
    """Line ranges of at most `limit` tokens that cover first..last; a longer line is a range of its own."""
    out, start, used = [], first, 0
    for k in range(first, last + 1):
        n = len(WORD.findall(lines[k - 1]))
        if k > start and used + n > limit:
            out.append((start, k - 1))
            start, used = k, 0
        used += n
    if start <= last:
        out.append((start, last))
    return out


def _parse(text: str):
    """The syntax tree of Python text, or None."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def _definitions(tree) -> list[tuple]:
    """(kind, name, qualified name, first line, last line, place of the definition around it or -1) by lines. A class is
    a class, a function anywhere within one a method; the qualified name holds the definition around."""
    out: list[tuple] = []
    todo = [(tree, "", -1, False)]
    while todo:
        node, around, parent, in_class = todo.pop()
        for n in ast.iter_child_nodes(node):
            if not isinstance(n, DEFINITIONS):
                todo.append((n, around, parent, in_class))
                continue
            is_class = isinstance(n, ast.ClassDef)
            out.append(("class" if is_class else "method" if in_class else "function", n.name, f"{around}.{n.name}" if around else n.name, n.lineno, n.end_lineno, parent))
            todo.append((n, n.name, len(out) - 1, in_class or is_class))
    return out


def file_units(path: str, text: str, limit: int) -> tuple[list[tuple], str]:
    """(units, status): the file itself as unit 0, its definitions from their def or class line on, windows over the
    lines that none covers unless all of these are blank, and windows over a definition of more than `limit` tokens.

    A unit is (unit_type, symbol, qualified_name, start, end, number of its parent). Lines are those of splitlines."""
    lines = text.splitlines() or [""]
    tree = _parse(text) if str(path).endswith((".py", ".pyi")) else None
    units: list[tuple] = [("file", None, None, 1, len(lines), None)]
    found = _definitions(tree) if tree is not None else []
    place = {-1: 0}
    for k, (kind, name, qualified, a, b, parent) in enumerate(found):
        place[k] = len(units)
        units.append((kind, name, qualified, a, b, parent))
    units = [u if k == 0 else (*u[:5], place[u[5]]) for k, u in enumerate(units)]
    for k, u in list(enumerate(units))[1:]:
        if sum(len(WORD.findall(x)) for x in lines[u[3] - 1 : u[4]]) > limit:
            units += [("code_block", None, None, a, b, k) for a, b in windows(lines, u[3], u[4], limit)]
    upto = 0
    for a, b in [*sorted((u[3], u[4]) for u in units[1:] if u[0] != "code_block"), (len(lines) + 1, len(lines) + 1)]:
        if a > upto + 1 and (not found or any(x.strip() for x in lines[upto : a - 1])):
            units += [("code_block", None, None, c, d, 0) for c, d in windows(lines, upto + 1, a - 1, limit)]
        upto = max(upto, b)
    return units, "success" if tree is not None else "fallback"


def extract_units(files: DataFrame, key: str = "file_version_id", path: str = "path", content: str = "content", limit: int = 512) -> DataFrame:
    """(key, unit_no, unit_type, symbol, qualified_name, start_line, end_line, parent_no, tokens, scoreable, status) of
    every file. A file that isn't Python or doesn't parse is cut into line windows, its status is fallback. Units of more
    than `limit` tokens and the file itself can't be scored. Null content has no units, an empty one one empty line."""
    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for k, p, t in f[[key, path, content]].itertuples(index=False):
                lines = t.splitlines() or [""]
                found, status = file_units(p, t, limit)
                for n, (unit, symbol, qualified, a, b, parent) in enumerate(found):
                    tokens = sum(len(WORD.findall(x)) for x in lines[a - 1 : b])
                    rows.append((k, n, unit, symbol, qualified, a, b, parent, tokens, unit != "file" and tokens <= limit, status))
            out = pd.DataFrame(rows, columns=[key, *(x.split()[0] for x in SCHEMA.split(", ")), "status"])
            yield out.astype({"parent_no": "Int32"})

    return files.select(key, path, content).where(F.col(content).isNotNull()).mapInPandas(run, f"{key} {kind}, {SCHEMA}, status string")


def extract_imports(files: DataFrame, key: str = "file_version_id", path: str = "path", content: str = "content") -> DataFrame:
    """(key, module, line) of the modules that Python files import, as written, with a dot for each level up."""
    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for k, t in f[[key, content]].itertuples(index=False):
                for n in ast.walk(_parse(t) or ast.Module([], [])):
                    if isinstance(n, ast.Import):
                        rows += [(k, x.name, n.lineno) for x in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        rows.append((k, "." * n.level + (n.module or ""), n.lineno))
            yield pd.DataFrame(rows, columns=[key, "module", "line"])

    python = files.select(key, path, content).where(F.col(content).isNotNull() & F.col(path).rlike(r"\.pyi?$"))
    return python.mapInPandas(run, f"{key} {kind}, module string, line int").distinct()


def chunks(df: DataFrame, key: str, text: str, size: int = 64, step: int = 48, most: int | None = None) -> DataFrame:
    """(key, chunk, tokens, text): overlapping windows of white-space tokens, the last one as long as the rest; as many
    as the text takes, or at most `most`."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    x = df.select(key, words.alias("w")).where("size(w) > 0")
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - size) / step).cast("int") + 1)
    count = count if most is None else F.least(F.lit(most), count)
    x = x.select(key, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * step + 1, F.lit(size))
    return x.select(key, "chunk", F.size(part).alias("tokens"), F.array_join(part, " ").alias("text"))
