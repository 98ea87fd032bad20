import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import positional, simhash
from sessionlake.llm.common import begin_step, end_step, join_groups, releasing, send, stored
from sessionlake.llm.queries import QUERIES, tokenizer_path


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in QUERIES


def test_each_stage_keeps_the_columns_and_the_last_encodes_what_is_left(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    library, start, expected = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc, text in left:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    found = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect())
    assert found == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_awkward_rows(spark, sf_dir, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs, _ = stored(stage(spark, docs, sf_dir), "test-awkward")


def test_rows_without_and_with_repeated_ids(spark):
    """Stages act on rows: of five rows the two that hold a benchmark window go, and copies go whether they have ids or
    not."""
    bad, copy = " ".join(f"word{n}" for n in range(30)), " ".join(f"other{n}" for n in range(40))
    rows = [(None, bad), (1, bad), (1, "a clean row that repeats an id"), (None, copy), (None, copy), (7, copy), (None, "alone without an id, and short"), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([("b", " ".join(f"word{n}" for n in range(5, 17)))], "item_id string, text string")
    clean = positional.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in clean.collect()])) == sorted(map(repr, rows[2:]))
    left = simhash.near_duplicates_removed(docs.where("text is null or text <> '" + bad + "'"), simhash.NEAR)
    assert left.columns == docs.columns
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in left.collect()])) == sorted(map(repr, [rows[2], (7, copy), rows[6], rows[7]]))


def test_a_stage_deletes_the_scratch_tables_of_those_before_it(spark, tmp_path):
    """But not those that its input still reads, nor those of its own place, nor what other queries made."""
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    paths = []

    def stage(spark, docs, sf_dir):
        frame, path = stored(docs, "test-stage")
        paths.append(path)
        return frame

    there = lambda: [spark._jvm.java.io.File(p[7:]).exists() for p in paths]
    other, _ = stored(docs, "test-other")
    lazy = releasing(0, stage)(spark, docs, "")
    releasing(0, stage)(spark, docs, "")
    assert there() == [True, True]
    second = releasing(1, stage)(spark, lazy, "")
    assert there() == [True, False, True] and second.count() == lazy.count() == 10
    written = str(tmp_path / "out")
    second.write.parquet(written)
    assert releasing(2, stage)(spark, spark.read.parquet(written), "").count() == 10
    assert there() == [False, False, False, True] and other.count() == 10


def test_a_stage_takes_back_the_broadcasts_of_those_before_it(spark, sf_dir, documents, tmp_path):
    """Else each run leaves its models in the driver's heap. But not what a result that was not written still needs."""
    sent = []

    def stage(spark, docs, sf_dir):
        sent.append(send(spark, {7: "x"}))
        known = sent[-1]
        return docs.where(F.udf(lambda n: n % 10 in known.value, "boolean")("doc_id"))

    def last(spark, docs, sf_dir):
        return docs

    there = lambda s: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().getStatus(spark.sparkContext._jvm.org.apache.spark.storage.BroadcastBlockId(s._jbroadcast.id(), "")).isDefined()
    lazy = releasing(0, stage)(spark, documents, sf_dir)
    assert releasing(1, last)(spark, lazy, sf_dir).count() == lazy.count() > 0 and there(sent[0])
    lazy.write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert releasing(1, stage)(spark, written, sf_dir).count() == written.count()
    assert [there(s) for s in sent] == [False, True]
    assert releasing(1, stage)(spark, written, sf_dir).count() == written.count()
    assert [there(s) for s in sent] == [False, True, True]
    begin_step()
    releasing(1, stage)(spark, written, sf_dir)
    end_step(spark)
    assert [there(s) for s in sent] == [False, True, True, False]
    releasing(2, last)(spark, documents, sf_dir)
    assert [there(s) for s in sent] == [False] * 4


def test_a_small_table_meets_its_groups_in_one_join(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(1500)] + [(None, 1)], "k int, v int")
    groups = spark.createDataFrame([(k, 100 + 1200 * (k == 3), f"g{k}") for k in range(6)], "k int, size int, name string")
    one, parts = join_groups(rows, groups, "k", "size", 900), join_groups(rows, groups, "k", "size", 1501)
    assert one.columns == parts.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, parts.collect()))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert (joins(one), joins(parts)) == (1, 3)
