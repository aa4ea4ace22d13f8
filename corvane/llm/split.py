"""Cutting oversized units at valleys of lexical cohesion."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import TOKEN_RE, rendered, token_count
from corvane.session import ship

WORD_RE = re.compile(r"[A-Za-z_]\w+|[^\W\d_]{2,}")
SCHEMA = "evidence_id string, file_version_id string, piece_no int, path string, unit_type string, symbol string, start_line int, end_line int, content string, rendered_token_count int"


def cohesion(lines: list[str], block: int, window: int = 256) -> list[float]:
    """For each gap g (before line g), the cosine of the word counts of the `block` lines on either side.

    Counts are summed along the lines of a window with its own vocabulary, so memory is bounded for any length."""
    n = len(lines)
    out = np.zeros(n)
    words = [WORD_RE.findall(x) for x in lines]
    for first in range(1, n, window):
        last = min(n, first + window)
        low, high = max(0, first - block), min(n, last + block)
        ids: dict[str, int] = {}
        row, col = [], []
        for i in range(low, high):
            for w in words[i]:
                row.append(i - low + 1)
                col.append(ids.setdefault(w, len(ids)))
        counts = np.zeros((high - low + 1, len(ids)), np.float32)
        np.add.at(counts, (row, col), 1)
        total = counts.cumsum(0)
        g = np.arange(first, last)
        left = total[g - low] - total[np.maximum(g - block, low) - low]
        right = total[np.minimum(g + block, high) - low] - total[g - low]
        norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
        out[first:last] = np.einsum("ij,ij->i", left, right) / np.where(norm == 0, 1, norm)
    return np.round(out, 6).tolist()


def depths(sims: list[float]) -> list[float]:
    """Depth of each gap's valley: how far cohesion climbs on its left and on its right before it falls again."""
    n = len(sims)
    left, right = sims[:], sims[:]
    for i in range(2, n):
        if left[i - 1] >= sims[i]:
            left[i] = max(sims[i], left[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 2, 0, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = max(sims[i], right[i + 1])
    return [(a - s) + (b - s) for a, b, s in zip(left, right, sims)]


def _cut_line(line: str, budget: int) -> list[str]:
    """Pieces of one line, each of at most `budget` tokens, cut after white space or punctuation where possible."""
    out, start, at, count, good = [], 0, 0, 0, 0
    for m in TOKEN_RE.finditer(line):
        if count == budget:
            at = good if good > start else m.start()
            out.append(line[start:at])
            start, count = at, len(TOKEN_RE.findall(line, at, m.start()))
            good = at
        count += 1
        if m.group() in ",;)]}." or line[m.end() : m.end() + 1].isspace():
            good = m.end()
    out.append(line[start:])
    return out


def pieces(content: str, first_line: int, budget: int, overlap: int = 3, block: int = 8) -> list[tuple[int, int, str]]:
    """(start line, end line, text) of pieces of at most `budget` tokens that cover the content.

    Each piece ends at the deepest cohesion valley in the window from half the budget to the whole; of equal valleys,
    before a blank or less indented line, then the last. The last `overlap` lines of the piece before are repeated, or
    as many of them as leave room for the next line. A line over the budget is cut within."""
    lines = content.split("\n")
    n = len(lines)
    tokens = [len(TOKEN_RE.findall(x)) for x in lines]
    total = [0]
    for t in tokens:
        total.append(total[-1] + t)
    depth: list[float] = []
    indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    out, pos, whole = [], 0, False
    while pos < n:
        if tokens[pos] > budget:
            out += [(first_line + pos, first_line + pos, x) for x in _cut_line(lines[pos], budget)]
            pos, whole = pos + 1, False
            continue
        start = pos
        if whole:
            start = max(0, pos - overlap, last_start)
            while start < pos and total[pos + 1] - total[start] > budget:
                start += 1
        end = pos + 1
        while end < n and total[end + 1] - total[start] <= budget:
            end += 1
        if end < n:
            depth = depth or depths(cohesion(lines, block))
            low = pos + 1
            while low < end and total[low] - total[start] < budget // 2:
                low += 1
            end = max(range(low, end + 1), key=lambda g: (round(depth[g], 9), -(indent[g]), g))
        out.append((first_line + start, first_line + end - 1, "\n".join(lines[start:end])))
        last_start, pos, whole = start, end, True
    return out


def _shorten(text: str | None, most: int) -> str | None:
    """The last `most` tokens of a text, which is left whole if it has no more."""
    found = list(TOKEN_RE.finditer(text or ""))
    return text if len(found) <= most else text[found[-most].start() :]


def header(path, unit_type, symbol, limit: int) -> tuple:
    """(path, unit_type, symbol, tokens) of a header that leaves a sixteenth of the limit at least to the content: a
    longer one keeps the last tokens of each field, a third of the room at most."""

    def tokens(p, u, s):
        return sum(len(TOKEN_RE.findall(x)) for x in ("[PATH] [TYPE] [LINES] 1-1 [CONTENT]", p or "", u or "", "" if s is None else "[SYMBOL] " + s))

    whole = tokens(path, unit_type, symbol)
    room = limit - max(1, limit // 16)
    if whole <= room:
        return path, unit_type, symbol, whole
    most = max(1, (room - tokens("", "", None if symbol is None else "")) // 3)
    path, unit_type, symbol = (_shorten(x, most) for x in (path, unit_type, symbol))
    return path, unit_type, symbol, tokens(path, unit_type, symbol)


def split_oversized(units: DataFrame, limit: int = 1024, overlap: int = 3, block: int = 8) -> DataFrame:
    """Pieces of the units (all but `file` units) whose rendered form has over `limit` tokens.

    Columns: those of SCHEMA; rendered_token_count is the piece's own, at most `limit`, which must be 64 or more.
    Counting runs in the JVM and leaves a few percent of the rows to the segmenter; there is no shuffle but the one that
    drops re-delivered rows. Null content counts as empty, a null line number as 1, other nulls render as nothing; the
    given rendered_token_count is not read. Repeated rows of an evidence_id give one set of pieces. path, unit_type and
    symbol are the unit's, but a header of over 15/16 of the limit is shortened. Other columns are ignored."""
    if limit < 64:
        raise ValueError("a limit under 64 leaves no room for the header")
    ship(units.sparkSession)
    c = F.col
    text = rendered(c("path"), c("unit_type"), c("start_line"), c("end_line"), c("symbol"), c("content"))
    large = (
        units.select("evidence_id", "file_version_id", "path", "unit_type", "start_line", "end_line", "symbol", "content")
        .where(F.coalesce(c("unit_type"), F.lit("")) != "file")
        .where((F.length(text) > limit) & (token_count(text) > limit))
        .select("evidence_id", "file_version_id", "path", "unit_type", "symbol", F.coalesce(c("start_line"), F.lit(1)).alias("start_line"), "content")
        .groupBy("evidence_id").agg(F.min(F.struct("content", "file_version_id", "start_line", "path", "unit_type", "symbol")).alias("u")).select("evidence_id", "u.*")
    )
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for eid, fid, first, content, *fields in f[["evidence_id", "file_version_id", "start_line", "content", "path", "unit_type", "symbol"]].itertuples(index=False):
                path, kind, symbol, cost = header(*fields, limit)
                for k, (a, b, t) in enumerate(pieces(content or "", int(first), limit - cost, overlap, block)):
                    rows.append((eid, fid, k, path, kind, symbol, a, b, t, cost + len(TOKEN_RE.findall(t))))
            yield pd.DataFrame(rows, columns=names)

    return large.mapInPandas(run, SCHEMA)
