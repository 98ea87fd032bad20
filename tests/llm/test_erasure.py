import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest

from sessionlake.llm import erasure
from sessionlake.llm.common import scratch_path
from sessionlake.llm.queries import QUERIES

MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def expected(tables, files=150, every=100):
    """Rows of (table_name, file_no, rows that stay, n_erased, rewritten), by plain Python."""
    clients = tables["clients"]
    clicks = {}
    for r in tables["clicks"]:
        clicks[r["client_id"]] = clicks.get(r["client_id"], 0) + 1
    people_of = {}
    for r in clients:
        if r["master_id"] is not None:
            people_of.setdefault(r["master_id"], set()).add(r["client_id"])
    most = min(people_of, key=lambda m: (-sum(clicks.get(c, 0) for c in people_of[m] if c is not None), m), default=None)
    masters = {m for m in people_of if crc(m) % every == 0 or m == most}
    people = {c for m in masters for c in people_of[m] if c is not None}
    sales = {r["sale_id"] for r in tables["sales"] if r["client_id"] in people and r["sale_id"] is not None}
    owner = {}
    for r in tables["sales"]:
        if r["client_id"] is not None and (owner.get(r["sale_id"]) is None or r["client_id"] < owner[r["sale_id"]]):
            owner[r["sale_id"]] = r["client_id"]
    out = []
    for name, rows in tables.items():
        of = (lambda r: owner.get(r["sale_id"]) if r["sale_id"] is not None else None) if name == "sale_lines" else (lambda r: r["client_id"])
        gone = (lambda r: r["sale_id"] in sales) if name == "sale_lines" else (lambda r: r["client_id"] in people or r.get("master_id") in masters)
        rows = sorted(rows, key=lambda r: (crc(of(r)), [(v is not None, v if v is not None else 0) for v in r.values()]))
        size = 1 + len(rows) // files
        for f in range(-(-len(rows) // size)):
            part = rows[f * size : (f + 1) * size]
            kept = [r for r in part if not gone(r)]
            if kept:
                out.append((name, f, kept, len(part) - len(kept), len(kept) < len(part)))
    return out


def check(found, tables, files=150, every=100):
    rows = {(r["table_name"], r["file_no"]): r for r in found.collect()}
    wanted = expected(tables, files, every)
    assert sorted(rows) == sorted((n, f) for n, f, *_ in wanted)
    for name, f, kept, n_erased, rewritten in wanted:
        r = rows[name, f]
        ids = ",".join("" if x is None else str(x) for x in (next(iter(k.values())) for k in kept))
        cents = sum(0 if k[MONEY[name]] is None else math.floor(100 * k[MONEY[name]] + 0.5) for k in kept)
        assert (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"]) == (len(kept), n_erased, cents, rewritten), (name, f)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r["columns"] == ",".join(kept[0])
        path = r["path"].removeprefix("file://")
        file = pq.ParquetFile(path)
        assert file.read().to_pylist() == kept
        # The footer knows nothing of those who left.
        for g in range(file.num_row_groups):
            for c in range(file.metadata.num_columns):
                column = file.metadata.row_group(g).column(c)
                values = [k[column.path_in_schema] for k in kept]
                if column.statistics and column.statistics.has_min_max:
                    assert column.statistics.min in values and column.statistics.max in values
    roots = {os.path.dirname(os.path.dirname(r["path"].removeprefix("file://"))) for r in rows.values()}
    there = {os.path.join(d, n) for root in roots for d, _, names in os.walk(root) for n in names if not n.startswith((".", "_"))}
    assert there == {r["path"].removeprefix("file://") for r in rows.values()}


def as_rows(frames):
    return {t: [r.asDict() for r in df.collect()] for t, df in frames.items()}


def test_the_query(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in MONEY}
    found = QUERIES["op11_erasure"](spark, sf_dir)
    check(found, as_rows(tables))
    again = QUERIES["op11_erasure"](spark, sf_dir)
    assert sorted(r["path"] for r in again.collect()) != sorted(r["path"] for r in found.collect())  # a new folder each time


@pytest.fixture(scope="module")
def shop(spark):
    """Null keys, a client under two masters, a sale of two clients, lines without a sale, repeats, clashing names."""
    more = "file_no long, _owner string, `a.b` string, _rank int"
    tail = (1, "o", None, 2)
    rows = {
        "clients": ("client_id long, master_id long, balance double", [(1, 10, 1.005), (1, None, -2.5), (2, 11, None), (None, 10, 3.0), (3, None, 4.0), (4, 12, 0.1), (4, 12, 0.1), (5, 13, 9.0), (6, 10, 7.0)]),
        "clicks": ("click_id long, client_id long, value double", [(n, c, v) for n, (c, v) in enumerate([(1, 1.0), (1, None), (1, 2.0), (None, 5.0), (4, 6.0), (6, 0.5), (7, 7.0), (7, 7.0)])] + [(7, 7, 7.0)]),
        "sales": ("sale_id long, client_id long, total double", [(1, 1, 5.0), (2, 2, 6.0), (2, 1, 6.5), (3, None, 7.0), (None, 1, 8.0), (4, 5, None), (5, 6, 1.0)]),
        "sale_lines": ("sale_id long, line_no int, amount double", [(1, 1, 1.0), (1, 1, 1.0), (2, 1, 2.0), (3, 1, None), (None, 2, 4.0), (99, 1, 5.0), (4, 1, 6.0), (5, 2, 7.0)]),
    }
    return {t: spark.createDataFrame([(*r, *tail) for r in data], f"{schema}, {more}") for t, (schema, data) in rows.items()}


@pytest.mark.parametrize("files", [1, 3, 150])
def test_awkward_rows(spark, shop, files):
    check(erasure.erased(spark, shop, scratch_path(spark, "erasure-test"), files, every=3), as_rows(shop), files, every=3)


def test_no_clicks_and_emptied_tables(spark, shop):
    quiet = {**shop, "clicks": shop["clicks"].where("false")}
    check(erasure.erased(spark, quiet, scratch_path(spark, "erasure-test"), 3, every=1), as_rows(quiet), 3, every=1)
    empty = {t: df.where("false") for t, df in shop.items()}
    assert erasure.erased(spark, empty, scratch_path(spark, "erasure-test")).collect() == []
    nobody = {**shop, "clients": shop["clients"].where("master_id is null")}
    check(erasure.erased(spark, nobody, scratch_path(spark, "erasure-test"), 3), as_rows(nobody), 3)
