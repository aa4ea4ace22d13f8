"""Aho-Corasick scans of a whole column of texts in one pass, with the patterns in shards of bounded size."""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import mix
from corvane.session import materialize, ship

_BUILT: dict[str, object] = {}
_BASE = np.uint64(0x100000001B3)
_SPAN = "array<struct<first:int,last:int,line:int>>"


def _build(patterns):
    a = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        a.add_word(p, (k, len(p)))
    a.make_automaton()
    return a


def _automaton(key: str, shard):
    """The worker's automaton of a broadcast shard by its unique key; one is kept per worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _build(shard.value)
    return _BUILT[key]


def _edge(c: str) -> bool:
    return c.isalnum() or c == "_"


def _hits(a, text: str, whole: bool) -> dict[int, list]:
    """Spans (first, last) of each pattern's matches. `whole`: those that neither begin nor end within a word, the
    longest from the left, none overlapping."""
    found = [(at - size + 1, at, i) for at, (i, size) in a.iter(text)]
    out: dict[int, list] = {}
    if whole:
        kept, n = -1, len(text)
        for first, last, i in sorted(found, key=lambda x: (x[0], -x[1])):
            if first <= kept or (first and _edge(text[first - 1]) and _edge(text[first])) or (last + 1 < n and _edge(text[last + 1]) and _edge(text[last])):
                continue
            kept = last
            out.setdefault(i, []).append((first, last))
        return out
    for first, last, i in found:
        out.setdefault(i, []).append((first, last))
    return out


class _Rows:
    """Output rows of a batch: key, pattern and the spans with the lines on which they begin."""

    def __init__(self):
        self.keys, self.found, self.first, self.last, self.line, self.ends = [], [], [], [], [], [0]

    def add(self, key: str, text: str, hits: dict[int, list], names, lines: bool):
        for i, spans in hits.items():
            self.keys.append(key)
            self.found.append(names[i])
            self.first += [x for x, _ in spans]
            self.last += [x for _, x in spans]
            self.line += [text.count("\n", 0, x) + 1 for x, _ in spans] if lines else [0] * len(spans)
            self.ends.append(len(self.first))

    def batch(self, key: str, pattern: str) -> pa.RecordBatch:
        spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (self.first, self.last, self.line)], ["first", "last", "line"])
        return pa.RecordBatch.from_arrays([pa.array(self.keys, pa.string()), pa.array(self.found, pa.string()), pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), spans)], [key, pattern, "spans"])


def _anchors(text: str, size: int) -> np.ndarray:
    """A hash of every run of `size` code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + c[k : k + n]
    return mix(h)


def scan(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, shard_bytes: int = 2 << 20, whole: bool = False, lines: bool = False, salts: int = 16, filter_bits: int = 1 << 24) -> DataFrame:
    """(key, pattern, spans array<struct<first, last, line>>): every occurrence of every pattern in every text, grouped.

    `key` is a string. The patterns are distinct, not null and not empty. `whole` keeps only occurrences that neither
    begin nor end within a word, the longest from the left; `lines` fills `line`, which else is 0.

    Patterns of at most `shard_bytes` in all are one automaton, which is broadcast, and texts are not shuffled. More
    are hashed by their anchor, their first code points, into shards of about that size. One pass over the texts then
    looks up the hashes of all their runs in a filter of `filter_bits` bits, which tells the few shards that a text can
    have a match in; the text is sent there, and to one of `salts` copies of the shard, so that no shard is hot. A task
    reads its sorted rows as a stream: a shard's patterns, from which it builds the automaton, then the texts. So the
    work doesn't grow with patterns times texts, no task holds more than a shard, and nothing but the filter, whose size
    is fixed, goes through the driver. With `whole`, matches of different shards may overlap. A null or empty text has
    no row."""
    spark = texts.sparkSession
    ship(spark)
    schema = f"`{key}` string, `{pattern}` string, spans {_SPAN}"
    patterns = materialize(patterns.select(F.col(pattern).alias("p")).where("length(p) > 0").distinct(), "patterns")
    stats = patterns.agg(F.sum(F.length("p") + 16).alias("bytes"), F.min(F.length("p")).alias("shortest")).head()
    texts = texts.select(F.col(key).cast("string").alias(key), F.col(text).alias("t")).where("length(t) > 0")
    if not stats.bytes:
        return spark.createDataFrame([], schema)
    if stats.bytes <= shard_bytes:
        shard = spark.sparkContext.broadcast(sorted(r.p for r in patterns.toLocalIterator()))

        def run(batches, tag=uuid.uuid4().hex):
            a, names = _automaton(tag, shard), shard.value
            for b in batches:
                rows = _Rows()
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows.add(doc, t, _hits(a, t, whole), names, lines)
                yield rows.batch(key, pattern)

        return texts.mapInArrow(run, schema)

    n, size = -(-int(stats.bytes) // shard_bytes), min(int(stats.shortest), 16)

    def place(frames):
        for f in frames:
            h = np.array([_anchors(p[:size], size)[0] for p in f["p"]], np.uint64)
            yield pd.DataFrame({"p": f["p"], "shard": (h % np.uint64(n)).astype(np.int32), "bit": ((h >> np.uint64(32)) % np.uint64(filter_bits)).astype(np.int32)})

    placed = materialize(patterns.mapInPandas(place, "p string, shard int, bit int"), "placed")
    bits = np.zeros(filter_bits, bool)
    for r in placed.select("bit").distinct().toLocalIterator():  # filter_bits at most
        bits[r.bit] = True
    wanted = spark.sparkContext.broadcast(np.packbits(bits))

    def send(batches):
        known = np.unpackbits(wanted.value).view(bool)
        for b in batches:
            keys, held, shards = [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _anchors(t, size)
                for s in np.unique(h[known[(h >> np.uint64(32)) % np.uint64(filter_bits)]] % np.uint64(n)).tolist():
                    keys.append(doc)
                    held.append(t)
                    shards.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.string()), pa.array(held, pa.string())], ["shard", "key", "t"])

    sent = texts.mapInArrow(send, "shard int, key string, t string").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    copies = placed.select("shard", F.lit(None).cast("string").alias("key"), F.col("p").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = copies.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("key").isNotNull())

    def stream(batches):
        at, names, a = None, [], None
        for b in batches:
            rows = _Rows()
            for s, doc, t, salt in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (s, salt) != at:
                    at, names, a = (s, salt), [], None
                if doc is None:
                    names.append(t)
                    continue
                if a is None and names:
                    a = _build(names)
                if a is not None:
                    rows.add(doc, t, _hits(a, t, whole), names, lines)
            yield rows.batch(key, pattern)

    return both.select("shard", "key", "t", "salt").mapInArrow(stream, schema)
