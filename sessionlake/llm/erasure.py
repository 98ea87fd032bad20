"""Operator 11: erasing people from a dataset of sorted files, and from all that depends on them.

A table is laid out once: ranges by the checksum of its owner and then all columns are sorted, their counts summed up to
ranks, and consecutive rows become files of equal size. An erasure begins with a few owners and is passed on from table
to table by shuffled semi-joins. Files in which no victim lies are not touched; the others are written again, without
their victims and in their old order, and replace the old ones. A file is written by one task, streaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import plain, release, scratch_path, stored, table
from .ranks import ranked


@dataclass(frozen=True)
class Layout:
    """A table's files: ``<folder>/<file_no>.parquet``, each of ``size`` rows but the last."""

    folder: str
    schema: StructType
    rows: int
    size: int

    @property
    def files(self) -> int:
        return -(-self.rows // self.size)

    def column(self, name: str) -> str:
        return f"c{self.schema.names.index(name)}"

    def path(self, file_no: int) -> str:
        return f"{self.folder}/{file_no}.parquet"

    def read(self, spark: SparkSession, files: list[int]) -> DataFrame:
        """The rows of some files, with ``_file`` and ``_row``, their place in it. Columns are named by position."""
        if not files:
            empty = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(self.schema)], "_file int", "_row long"])
            return spark.createDataFrame([], empty)
        found = spark.read.schema(self.schema).parquet(*[self.path(f) for f in files])
        meta = found.metadataColumn("_metadata")
        number = F.regexp_extract(meta["file_name"], r"^(\d+)\.parquet$", 1).cast("int")
        return found.select(*[c.alias(f"c{i}") for i, c in enumerate(plain(found))], number.alias("_file"), meta["row_index"].alias("_row"))


def _publish(spark: SparkSession, staged: str, layout: Layout, column: str, files: list[int]) -> list[int]:
    """Move each staged file into its place, over an old one; where none was staged, the old one goes. Returns the
    files that are there. The number of files is bounded by the layout."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(layout.folder))
    there = []
    for f in files:
        made, to = path(f"{staged}/{column}={f}"), path(layout.path(f))
        fs.delete(to, False)
        if fs.exists(made):
            parts = [s.getPath() for s in fs.listStatus(made) if s.getPath().getName().endswith(".parquet")]
            if len(parts) != 1 or not fs.rename(parts[0], to):
                raise OSError(f"{made} holds {len(parts)} files, or could not be moved to {to}")
            there.append(f)
    release(spark, staged)
    return there


def _write(rows: DataFrame, layout: Layout, files: list[int]) -> list[int]:
    """Write rows (columns by position, ``_file``, ``_row``) as the layout's files, in order of ``_row``."""
    spark, names = rows.sparkSession, {c.lower() for c in layout.schema.names}
    column = "file_no"
    while column in names:
        column = f"_{column}"
    one = rows.repartitionById(max(files, default=0) + 1, F.col("_file")).sortWithinPartitions("_file", "_row")
    named = one.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(layout.schema)], F.col("_file").alias(column))
    staged = f"{layout.folder}-staged"
    named.write.option("maxRecordsPerFile", 0).mode("overwrite").partitionBy(column).parquet(staged)
    return _publish(spark, staged, layout, column, files)


def by_place(rows: DataFrame) -> DataFrame:
    """Columns named c0, c1, ..., whatever their names were."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])


def lay_out(rows: DataFrame, schema: StructType, folder: str, files: int = 150) -> Layout:
    """Write ``rows`` (:func:`by_place` of a table of this schema, and _owner) as about ``files`` files of
    1 + floor(n / files) rows, sorted by the CRC-32 of _owner (a text; null is the empty one), then by all columns from
    left to right, ascending, nulls first. A hot owner's rows are cut by the other columns."""
    spark, columns = rows.sparkSession, [f"c{i}" for i in range(len(schema))]
    flat = rows.select(*columns, F.crc32(F.encode(F.coalesce("_owner", F.lit("")), "UTF-8")).alias("_crc"))
    found, path = ranked(flat, None, ["_crc", *columns], "_rank", "_all", f"erasure-{folder.rsplit('/', 1)[-1]}")
    n = spark.read.parquet(path).count()
    layout = Layout(folder, schema, n, 1 + n // files)
    placed = found.select(*columns, F.floor(F.col("_rank") / layout.size).cast("int").alias("_file"), F.col("_rank").alias("_row"))
    _write(placed, layout, list(range(layout.files)))
    release(spark, path)
    return layout


def holding(spark: SparkSession, layout: Layout, rules: list[tuple[str, DataFrame]]) -> list[int]:
    """The files that hold a victim: a row whose column of some rule is one of the rule's values. At most as many as
    the layout has."""
    hit: set[int] = set()
    for key, victims in rules:
        rows = layout.read(spark, list(range(layout.files))).select(F.col(layout.column(key)).alias("_key"), "_file")
        hit |= {r[0] for r in rows.join(victims.toDF("_key"), "_key", "left_semi").select("_file").distinct().collect()}
    return sorted(hit)


def rewrite(spark: SparkSession, layout: Layout, rules: list[tuple[str, DataFrame]], files: list[int]) -> list[int]:
    """Write ``files`` again without the victims, in the old order. Emptied files go. Returns the files of the layout
    that are left. A null is nobody's key."""
    if not files:
        return list(range(layout.files))
    kept = layout.read(spark, files)
    for n, (key, victims) in enumerate(rules):
        kept = kept.join(victims.toDF(f"_v{n}"), F.col(layout.column(key)) == F.col(f"_v{n}"), "left_anti")
    left = set(_write(kept, layout, files))
    return [f for f in range(layout.files) if f not in files or f in left]


def digests(spark: SparkSession, layout: Layout, files: list[int], cents: str) -> DataFrame:
    """_file, n_rows, cents (of column ``cents``) and ids_sha256 (of the first column, in order) of the files, read from
    them. A file's first column passes through one task, in batches."""
    money = F.coalesce(F.floor(F.col(layout.column(cents)) * 100 + 0.5), F.lit(0)).cast("long")
    rows = layout.read(spark, files).select("_file", "_row", F.col("c0").cast("string").alias("id"), money.alias("cents"))
    ordered = rows.repartitionById(max(files, default=0) + 1, F.col("_file")).sortWithinPartitions("_file", "_row").drop("_row")
    return ordered.mapInArrow(_digested, "_file int, n_rows long, cents long, ids_sha256 string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each file; rows come file by file and in order."""
    now, rows, total, sha = None, 0, 0, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_file": pa.array([now], pa.int32()), "n_rows": pa.array([rows], pa.int64()), "cents": pa.array([total], pa.int64()), "ids_sha256": pa.array([sha.hexdigest()], pa.string())})

    for batch in batches:
        start = 0
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        while start < len(numbers):
            end = start + int((numbers[start:] != numbers[start]).argmax() or len(numbers) - start)
            if numbers[start] != now:
                if now is not None:
                    yield row()
                now, rows, total, sha = int(numbers[start]), 0, 0, hashlib.sha256()
            part = batch.slice(start, end - start)
            ids = pc.fill_null(part.column(1), "").to_pylist()
            sha.update(((b"," if rows else b"") + ",".join(ids).encode()))
            rows += len(ids)
            total += pc.sum(part.column(2)).as_py() or 0
            start = end
    if now is not None:
        yield row()


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 100) -> DataFrame:
    """master_id of those to erase: where ``every`` divides the CRC-32 of the decimal id, and the one whose clients
    together have most clicks (the smallest at a tie, also where none has any)."""
    known = clients.select("master_id", "client_id").where("master_id is not null").distinct()
    drawn = known.select("master_id").where(F.pmod(F.crc32(F.encode(F.col("master_id").cast("string"), "UTF-8")), F.lit(every)) == 0)
    # Clicks are counted by client before anything is joined, so a hot client is one row.
    counted = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    most = known.join(counted, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    top = most.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return drawn.unionByName(top).distinct()


#: The shop's tables, in the order of the cascade, and the column of each that is summed up.
CASCADE = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def erased(spark: SparkSession, tables: dict[str, DataFrame], root: str, files: int = 150, every: int = 100) -> DataFrame:
    """Lay out clients, clicks, sales and sale_lines below ``root``, erase the victims (:func:`victim_masters`), their
    clicks, sales and sale lines, and tell of each file that is left: table_name, file_no, n_rows, n_erased, cents,
    ids_sha256, rewritten, columns, path.

    A sale line's owner is its sale's client; without a client, or without a sale, it is the empty text. A sale_id with
    several clients has the smallest. Every row of a victim's client_id goes, also one under another master; rows
    without a key depend on nobody. Tables may have more columns, under any names; empty tables have no files."""
    owners = tables["sales"].where("sale_id is not null").groupBy(F.col("sale_id").alias("_sale")).agg(F.min("client_id").cast("string").alias("_owner"))
    at = {t: (lambda name, names=rows.columns: f"c{names.index(name)}") for t, rows in tables.items()}
    owned = {t: by_place(tables[t]).withColumn("_owner", F.col(at[t]("client_id")).cast("string")) for t in ("clients", "clicks", "sales")}
    # Lines of a hot sale share a key: adaptive execution splits their partition, the sale being one row. It can only do
    # so where the join reads both shuffles as they are, so the owners are aggregated before.
    owners, owners_path = stored(owners, "erasure-owners")
    owned["sale_lines"] = by_place(tables["sale_lines"]).join(owners, F.col(at["sale_lines"]("sale_id")) == F.col("_sale"), "left").drop("_sale")
    layouts = {t: lay_out(owned[t], tables[t].schema, f"{root}/{t}", files) for t in CASCADE}
    clients = tables["clients"]
    masters, masters_path = stored(victim_masters(clients, tables["clicks"], every), "erasure-masters")
    theirs = clients.join(masters, "master_id", "left_semi").select("client_id").where("client_id is not null").distinct()
    people, people_path = stored(theirs, "erasure-clients")
    gone = tables["sales"].select("client_id", "sale_id").join(people, "client_id", "left_semi").select("sale_id").where("sale_id is not null").distinct()
    sales, sales_path = stored(gone, "erasure-sales")
    out = None
    rules = {
        "clients": [("master_id", masters), ("client_id", people)],  # also a victim's rows under another master
        "clicks": [("client_id", people)],
        "sales": [("client_id", people)],
        "sale_lines": [("sale_id", sales)],
    }
    for name, layout in layouts.items():
        hit = holding(spark, layout, rules[name])
        left = rewrite(spark, layout, rules[name], hit)
        found = digests(spark, layout, left, CASCADE[name])
        full = F.when(F.col("_file") == layout.files - 1, layout.rows - layout.size * (layout.files - 1)).otherwise(layout.size)
        one = found.select(
            F.lit(name).alias("table_name"),
            F.col("_file").cast("long").alias("file_no"),
            "n_rows",
            (full - F.col("n_rows")).cast("long").alias("n_erased"),
            "cents",
            "ids_sha256",
            F.col("_file").isin(hit).alias("rewritten") if hit else F.lit(False).alias("rewritten"),
            F.lit(",".join(layout.schema.names)).alias("columns"),
            F.concat(F.lit(f"{layout.folder}/"), F.col("_file").cast("string"), F.lit(".parquet")).alias("path"),
        )
        out = one if out is None else out.unionByName(one)
    done, _ = stored(out, "erasure-files")
    for path in (owners_path, masters_path, people_path, sales_path):
        release(spark, path)
    return done


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The erasure over the shop's whole tables, in a new folder that stays."""
    return erased(spark, {t: table(spark, sf_dir, t) for t in CASCADE}, scratch_path(spark, "erasure"))
