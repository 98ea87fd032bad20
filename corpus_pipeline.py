"""From raw documents to token records: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next one's ``docs``. All but the last keep the columns of ``documents``. A stage deletes the scratch
tables of those before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import mixing, positional, records, simhash, toxicity
from sessionlake.llm.common import begin_step, end_step, release, releasing, small_batches, stored, table, without_old_shuffles
from sessionlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples reject go. Null and empty texts stay."""
    small_batches(spark)
    without_old_shuffles(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the one with the
    least doc_id. SimHash and its covering tables find the close ones, an index of prefixes the others, an exact check
    follows. Rows without doc_id are known by their texts."""
    small_batches(spark)
    without_old_shuffles(spark)
    return simhash.near_duplicates_removed(docs, simhash.NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, row by row, whatever their ids; null texts stay."""
    small_batches(spark)
    without_old_shuffles(spark)
    return positional.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn towards target shares of sources, languages and topics."""
    without_old_shuffles(spark)
    return mixing.sampled(docs, mixing.Rule())


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token records; the rows are read back from the files."""
    small_batches(spark)
    without_old_shuffles(spark)
    return records.encoded(docs, tokenizer_path(), end_id=0, most=150_000).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (name, releasing(place, stage))
    for place, (name, stage) in enumerate(
        [
            ("toxicity", drop_toxic),
            ("near_duplicates", drop_near_duplicates),
            ("decontamination", drop_contaminated),
            ("mixing", mix_sources),
            ("token_records", write_tokens),
        ]
    )
]

#: SQL has no tokenizer, nearest examples or SimHash; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's scratch tables and broadcasts go when its result is written, the result
    itself when the next one is; the token records stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    begin_step()
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        end_step(spark, path)
        if before:
            release(spark, before)
        before = path
    return docs
