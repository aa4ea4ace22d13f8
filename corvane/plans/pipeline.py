"""Phases with fingerprinted outputs: a phase is skipped if its inputs and parameters are those of its written output."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.sinks import _fs, publish, write_stream


class Pipeline:
    """Runs phases under a folder. A phase writes to a staging folder, and its ledger entry is written after the
    publication, so a run that dies is taken up where it stood."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, path: str) -> dict | None:
        p, fs = _fs(self.spark, path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def fingerprint(self, name: str) -> str | None:
        """The fingerprint of a phase's finished output."""
        entry = self._read(f"{self.folder}/{name}.json")
        return entry and entry["fingerprint"]

    def run(self, name: str, inputs: list[str], parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The phase's output, made anew only if the inputs' fingerprints or the parameters changed."""
        text = json.dumps([name, [self.fingerprint(i) or i for i in inputs], parameters], sort_keys=True)
        key, target = hashlib.sha256(text.encode()).hexdigest(), f"{self.folder}/{name}"
        if self.fingerprint(name) != key:
            ledger, fs = _fs(self.spark, f"{target}.json")
            fs.delete(ledger, False)
            staged, _ = _fs(self.spark, target + ".staged")
            fs.delete(staged, True)
            report = write_stream(make(), target + ".staged")
            publish(self.spark, target + ".staged", target)
            out = fs.create(ledger, True)
            out.write(bytearray(json.dumps({"fingerprint": key, "rows": report["rows"], "bytes": report["bytes"]}).encode()))
            out.close()
        return self.spark.read.parquet(target)

    def pending(self, work: DataFrame, done: str, key: str) -> DataFrame:
        """Rows of `work` whose key the finished output `done` lacks."""
        if self.fingerprint(done) is None:
            return work
        return work.join(self.spark.read.parquet(f"{self.folder}/{done}").select(key), key, "left_anti")
