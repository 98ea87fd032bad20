"""What the operators share: reading tables, scratch tables in the shared folder, sizes."""

from __future__ import annotations

import ctypes
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder (tests on one machine).
LOCAL_SCRATCH = "file:///tmp/sessionlake-scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, as a full address, so that Spark
    and pyarrow mean the same store by it."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = spark._jvm.org.apache.hadoop.fs.Path((spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SCRATCH).rstrip("/"))
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sessionlake/{name}-{uuid.uuid4().hex}"


#: What was made since the last step ended: paths of scratch tables, and broadcasts.
_MADE: list[str] = []
_SENT: list[Broadcast] = []


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.append(path)
    if _STEP.now is not None:
        _STEP.made.append((_STEP.now, path))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def send(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that :func:`end_step` or a later stage (:func:`releasing`) takes back."""
    _SENT.append(spark.sparkContext.broadcast(value))
    if _STEP.now is not None:
        _STEP.sent.append((_STEP.now, _STEP.read, spark.sparkContext, _SENT[-1]))
    return _SENT[-1]


class _Step(threading.local):
    """The place of the stage that this thread is in and the files that its input reads; the scratch tables and the
    broadcasts of its stages, with their places."""

    def __init__(self) -> None:
        self.now: int | None = None
        self.read: frozenset[str] = frozenset()
        self.made: list[tuple[int, str]] = []
        self.sent: list[tuple[int, frozenset[str], SparkContext, Broadcast]] = []


_STEP = _Step()


def releasing(place: int, stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, which first deletes what stages of lesser places made in this thread and ``docs`` does not read: scratch
    tables and broadcasts, whose blocks the driver holds in its heap. The result of such a stage is to be written before
    a later one begins; one that was not, or that reads no files, keeps them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files, read = frozenset(docs.inputFiles()), set()
        for made in [m for m in _STEP.made if m[0] < place]:
            name = made[1].rsplit("/", 1)[1]
            if any(f"/{name}/" in f for f in files):
                read.add(made[0])
            else:
                release(spark, made[1])
                _STEP.made.remove(made)
        _STEP.sent[:] = [s for s in _STEP.sent if s[2] is spark.sparkContext]  # those of another died with it
        for at, needs, _, sent in [s for s in _STEP.sent if s[0] < place]:
            if files and at not in read and not files & needs:
                take_back(sent)
        before, _STEP.now, _STEP.read = (_STEP.now, _STEP.read), place, files
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _STEP.now, _STEP.read = before

    return run


def take_back(sent: Broadcast) -> None:
    """Destroy what :func:`send` gave, once."""
    sent.destroy()
    _SENT[:] = [s for s in _SENT if s is not sent]
    _STEP.sent[:] = [s for s in _STEP.sent if s[3] is not sent]


def begin_step() -> None:
    """From here on :func:`end_step` counts. What was made before stays."""
    _MADE.clear()
    _SENT.clear()


def end_step(spark: SparkSession, *keep: str) -> None:
    """Delete the scratch tables made in this step, all but ``keep``, and its broadcasts. Only results that were stored
    may be read after it."""
    for path in _MADE:
        if path not in keep:
            release(spark, path)
    for sent in [*_SENT]:
        take_back(sent)
    begin_step()


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_all(spark: SparkSession) -> None:
    """Delete every scratch table of this library. Results that were not written elsewhere read them: call it last."""
    release(spark, f"{scratch_root(spark)}/sessionlake")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the row of their group (``groups``: key, size, values; each key once, none null).

    Groups of more than a ten-thousandth of ``total`` rows number fewer than ten thousand: they are broadcast, and no
    key of the other join has more rows than that. A table too small for such a group takes one join."""
    large = max(1000, total // 10_000)
    if total <= large:
        return rows.join(groups.drop(size), key)
    values = [c for c in groups.columns if c not in (key, size)]
    hot = groups.where(F.col(size) > large).select(key, *values, F.lit(True).alias("_hot"))
    near = rows.join(F.broadcast(hot), key, "left")
    others = near.where("_hot is null").drop("_hot", *values).join(groups.where(F.col(size) <= large).drop(size), key)
    return near.where("_hot is not null").drop("_hot").unionByName(others)


def plain(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers of the session get at most ``rows`` rows at once from here on, so that a batch of long texts, as
    Arrow and as objects, stays a small part of an executor's memory."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without_old_shuffles(spark: SparkSession) -> None:
    """From here on Spark deletes an action's shuffle files when the action ends. Nothing here reads them again: what is
    needed twice is :func:`stored`. Else they stay until the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Return the memory that this process holds but does not use. Python workers are reused, and an idle one's memory
    counts with its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for a task of ``mapInPandas``, which gives back its memory at its end."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(frames)
        give_back()

    return task


def pieces(frames: Iterator[pd.DataFrame], limit: int = 16_000_000, column: str = "text") -> Iterator[pd.DataFrame]:
    """Cut batches so that the texts (or bytes) of a piece hold about ``limit`` characters; a longer one is a piece alone."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield frame.iloc[start:i]
                start, total = i, 0
            total += int(n)
        yield frame.iloc[start:]


def arrow_pieces(batches: Iterator[pa.RecordBatch], limit: int = 16_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """:func:`pieces` of Arrow batches, by bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if sizes:
            yield batch.slice(start)
