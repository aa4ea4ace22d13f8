"""Byte-level BPE as a lazily determinised finite-state transducer.

A merge list defines one encoding per byte string, and in that encoding any two neighbours encode to themselves when
joined; conversely a cut into vocabulary entries whose neighbours all have that property is the encoding. So the merges
compile into a transducer: a configuration is (last whole token, trie node of the token being read, tokens not yet
agreed on), and an edge ends a token only before a compatible neighbour. Subsets of configurations are determinised
when a text first reaches them. A token is emitted as soon as every live configuration agrees on it, which is after at
most the longest token's bytes. The tables are shared by all texts of a worker; when they reach `max_states` they are
dropped and built anew, which changes speed only.

Decoding streams through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import hashlib
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship

TOKENIZER_DIR = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that splits text before the merges. \s is spelled out, because the tokenizer's
# white space is Unicode White_Space, without the four separators that Python counts in.
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+"
)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeTransducer:
    """Encoder of one vocabulary. `encode_bytes` runs the transducer on one pre-token, `encode` on a text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_cached: int = 200_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.max_states, self.max_cached = max_states, max_cached
        self.find = regex.compile(SPLIT_PATTERN).findall
        child: list[dict[int, int]] = [{}]
        token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = child[node].get(byte)
                if nxt is None:
                    nxt = child[node][byte] = len(child)
                    child.append({})
                    token_at.append(-1)
                node = nxt
            token_at[node] = rank
        self.child, self.token_at = child, token_at
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.ids = {start: 0}
        self.states = [start]
        self.edges: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [None]

    def merge(self, data: bytes) -> list[int]:
        """The encoding by the merges themselves; used for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinises one edge: extends every configuration by the byte, or ends its token before it."""
        nxt = []
        for last, node, pending in self.states[state]:
            c = self.child[node].get(byte)
            if c is not None:
                nxt.append((last, c, pending))
            t = self.token_at[node]
            if node and t >= 0 and (last < 0 or self.compatible(last, t)):
                c = self.child[0].get(byte)
                if c is not None:
                    nxt.append((t, c, (*pending, t)))
        agreed = os.path.commonprefix([p for _, _, p in nxt])
        k = len(agreed)
        key = tuple(sorted({(last, node, p[k:]) for last, node, p in nxt}))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.edges.append({})
            self.ends.append(None)
        edge = self.edges[state][byte] = (to, tuple(agreed))
        return edge

    def _end(self, state: int) -> tuple[int, ...]:
        for last, node, pending in self.states[state]:
            t = self.token_at[node]
            if t >= 0 and (last < 0 or self.compatible(last, t)):
                self.ends[state] = out = (*pending, t)
                return out
        raise ValueError("the vocabulary lacks a byte")

    def encode_bytes(self, data: bytes) -> list[int]:
        if not data:
            return []
        if len(self.states) >= self.max_states:
            self._reset()
        out: list[int] = []
        state, edges, step = 0, self.edges, self._step
        for byte in data:
            e = edges[state].get(byte) or step(state, byte)
            state = e[0]
            if e[1]:
                out.extend(e[1])
        out.extend(self.ends[state] or self._end(state))
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        whole = self.whole
        for piece in self.find(text or ""):
            ids = whole.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode())
                if len(piece) <= 64:
                    if len(whole) >= self.max_cached:
                        whole.clear()
                    whole[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return "".join(decode_stream(self.tokens[i] for i in ids))


def decode_stream(chunks):
    """Yields the text of byte chunks as soon as it is whole; malformed bytes come out as U+FFFD.

    The machine's state is (bytes of the open character so far, bytes still due, bounds of the next byte).
    """
    held, due, low, high = bytearray(), 0, 0x80, 0xBF
    for chunk in chunks:
        out = []
        for b in chunk:
            if due:
                if low <= b <= high:
                    held.append(b)
                    due -= 1
                    low, high = 0x80, 0xBF
                    if not due:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("\ufffd")
                held.clear()
                due = 0
            low, high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                held.append(b)
                due = 1
            elif 0xE0 <= b <= 0xEF:
                held.append(b)
                due = 2
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                held.append(b)
                due = 3
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("\ufffd")
        if out:
            yield "".join(out)
    if due:
        yield "\ufffd"


_LOADED: dict[str, MergeTransducer] = {}


def transducer(vocabulary: tuple) -> MergeTransducer:
    """The worker's transducer of a broadcast vocabulary, compiled once per worker process."""
    key, ranks = vocabulary
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeTransducer(ranks.value)
    return _LOADED[key]


def vocabulary(spark, path: str | None = None) -> tuple:
    """(digest, broadcast) of a vocabulary file, which is under 1 MB whatever the corpus."""
    ship(spark)
    path = path or os.path.join(TOKENIZER_DIR, DEFAULT_VOCABULARY)
    with open(path, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    return key, spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, text: str = "text", out: str = "ids", *, counts: bool = False, path: str | None = None) -> DataFrame:
    """Adds `out` = token ids of `text` (array<int>), or with counts=True their number (int).

    Null and empty texts give an empty list (0). Other columns pass through; a column named `out` is replaced. Strings
    that look like special tokens are ordinary text. One narrow stage: no shuffle, order and rows kept.
    """
    ranks = vocabulary(df.sparkSession, path)
    if counts:

        @F.pandas_udf("int")
        def run(s):
            t = transducer(ranks)
            return s.map(lambda x: len(t.encode(x)))

    else:

        @F.arrow_udf("array<int>")
        def run(s):
            t = transducer(ranks)
            flat, at = [], [0]
            for x in s.to_pylist():
                flat += t.encode(x)
                at.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))

    return df.withColumn(out, run(F.coalesce(F.col(text).cast("string"), F.lit(""))))
