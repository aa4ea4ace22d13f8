"""Lexical tokens of evidence units: a longest run of ASCII letters, digits and underscores, or any other single code
point except space, tab, LF, CR, FF and VT. As a JVM expression for counting, and as arrays of hashes for sketches."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^ \t\n\r\f\x0b]"
TOKEN_RE = re.compile(TOKEN)

_CLASS = np.full(256, 2, np.uint8)  # 0 blank, 1 word, 2 first byte of another code point, 3 continuation byte
for _c in b" \t\n\r\f\v":
    _CLASS[_c] = 0
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_":
    _CLASS[_c] = 1
_CLASS[0x80:0xC0] = 3

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def token_count(text: Column) -> Column:
    """Number of tokens, counted in the JVM."""
    return F.regexp_count(text, F.lit(TOKEN))


def rendered(path: Column, unit_type: Column, start: Column, end: Column, symbol: Column, content: Column) -> Column:
    """The rendered form of a unit; a null field renders as nothing, a null symbol drops its line."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("[PATH] "), text(path), F.lit("\n[TYPE] "), text(unit_type), F.lit("\n[LINES] "), text(start), F.lit("-"), text(end), F.lit("\n"),
        F.coalesce(F.concat(F.lit("[SYMBOL] "), symbol, F.lit("\n")), F.lit("")), F.lit("[CONTENT]\n"), text(content),
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    return _POWERS


def hash_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of every token of UTF-8 texts, in order. Hashes depend on the token's bytes only."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    kind = _CLASS[data]
    nxt = np.append(kind[1:], np.uint8(0))
    prev = np.append(np.uint8(0), kind[:-1])
    start = np.flatnonzero((kind == 2) | ((kind == 1) & (prev != 1)))
    end = np.flatnonzero(((kind == 1) & (nxt != 1)) | ((kind >= 2) & (nxt != 3)))
    up, down = _powers(len(data) + 1)
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    value = (total[end] - total[start - 1]) * down[start]
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    return np.searchsorted(bounds, start, side="right") - 1, mix(value)


def batches(texts: list[bytes], size: int = 1 << 20):
    """Cuts a list of texts into (first, last) ranges of about `size` bytes; a longer text is a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)
