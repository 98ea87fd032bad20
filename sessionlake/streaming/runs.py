"""Keep-best upserts by a log-structured merge: what a batch writes is in proportion to the batch.

A dataset is a list of sorted runs in a versioned manifest. A batch becomes one new run and nothing else is rewritten;
readers take the best row of a key among all runs. When a level has ``fan`` runs they are merged into one run of the next
level, so a row is rewritten once a level: a number of times that grows with the logarithm of the data. Each run keeps
its range of keys in the manifest and a Bloom filter of the keys in its Parquet files, so a look-up opens the runs that
may hold a key, and in them the row groups that may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import keep_best
from ..sinks.versions import Versions


class Runs:
    """Rows with columns key, n_messages, n_bytes, end_time, line and any others, by keep-best: most messages, then most
    bytes, then the latest end, then what came in the earliest batch, then the smallest line. A null key is a key like
    any other. ``schema``: of the rows, for a dataset without any run."""

    def __init__(self, spark: SparkSession, root: str, schema: str, fan: int = 4) -> None:
        self.spark, self.versions, self.schema, self.fan = spark, Versions(spark, root), schema, fan

    def _best(self, rows: DataFrame) -> DataFrame:
        return keep_best(rows, "key", "n_messages", "n_bytes", "end_time", ["_batch", "line"])

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        """A run: sorted by key in ranges, with Bloom filters. None where there is no row."""
        folder = self.versions.new_folder("run")
        # Filters as large as the file's keys need.
        rows.sort("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)
        about = self.spark.read.parquet(folder).agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("key").isNull()).alias("null")).first()
        return {"folder": folder, "level": level, **about.asDict()} if about["rows"] else None

    def upsert(self, batch: DataFrame, number: int, writer: str = "") -> None:
        """Add a batch. A batch whose number this ``writer`` (a stream) has committed already changes nothing."""
        if self.versions.latest()[1].get("batches", {}).get(writer, -1) >= number:
            return
        rows = self._best(batch.withColumn("_batch", F.lit(0))).drop("_batch")
        order = len(self.versions.numbers()) + 1
        run = self._write(rows.withColumn("_batch", F.lit(order).cast("long")), 0)

        def make(_: int, now: dict) -> dict | None:
            done = now.get("batches", {})
            if done.get(writer, -1) >= number:
                return None
            return {**now, "runs": [*now.get("runs", []), *([run] if run else [])], "batches": {**done, writer: number}}

        self.versions.change(make)

    def _rows(self, runs: list[dict]) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{self.schema}, _batch long")
        return self.spark.read.schema(empty.schema).parquet(*[r["folder"] for r in runs]) if runs else empty

    def read(self, version: int | None = None) -> DataFrame:
        """The best row of each key, in the latest or an earlier version."""
        now = self.versions.latest()[1] if version is None else self.versions.read(version)
        return self._best(self._rows(now.get("runs", []))).drop("_batch")

    def may_hold(self, keys: list[str]) -> list[dict]:
        """The runs whose range holds one of the keys."""
        return [r for r in self.versions.latest()[1].get("runs", []) if r["low"] is not None and any(r["low"] <= k <= r["high"] for k in keys)]

    def get(self, keys: list[str]) -> DataFrame:
        """The best rows of a few keys. The keys go down to the files' Bloom filters and ranges."""
        return self._best(self._rows(self.may_hold(keys)).where(F.col("key").isin(*keys))).drop("_batch")

    def compact(self) -> int:
        """Merge full levels, lowest first, until none is full. Returns how many runs were merged."""
        merged = 0
        while True:
            now = self.versions.latest()[1].get("runs", [])
            full = next((v for v in sorted({r["level"] for r in now}) if sum(r["level"] == v for r in now) >= self.fan), None)
            if full is None:
                return merged
            old = [r for r in now if r["level"] == full]
            run = self._write(self._best(self._rows(old)), full + 1)
            names = {r["folder"] for r in old}

            def make(_: int, now: dict) -> dict | None:
                here = now.get("runs", [])
                if not names <= {r["folder"] for r in here}:  # noqa: B023
                    return None  # another writer merged them
                return {**now, "runs": [*[r for r in here if r["folder"] not in names], run]}  # noqa: B023

            self.versions.change(make)
            merged += len(old)


def upsert_stream(stream: DataFrame, runs: Runs, checkpoint: str, once: bool = True, compact: bool = True, every: str = "24 hours") -> StreamingQuery:
    """Keep ``runs`` up to date from a stream of sessions, once or ``every`` so often (:func:`sessionlake.config.interval`).
    A batch repeated after a failure counts once."""

    def add(batch: DataFrame, number: int) -> None:
        runs.upsert(batch, number, checkpoint)
        if compact:
            runs.compact()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
