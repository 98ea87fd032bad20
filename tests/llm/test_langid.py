import zlib

import numpy as np

from sessionlake.llm import langid
from sessionlake.llm.queries import op1_language_id


def test_held_out_accuracy(spark, documents):
    real = {r["doc_id"]: r["lang"] for r in documents.collect()}
    found = op1_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(real)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    out = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == real[r["doc_id"]] for r in out]) >= 0.95


def test_filters_against_sets(spark, documents):
    """With a filter that is hardly filled, the corrected shares are those of plain sets of n-grams."""
    rule = langid.Rule(orders=(3,), slots=1 << 20, kept=200)
    model = langid.fit(documents.where("doc_id % 2 = 0"), rule)
    texts = [(r["lang"], r["text"]) for r in documents.where("doc_id % 2 = 0").collect()]
    counts = {k: {} for k in model.languages}
    for lang, text in texts:
        p = langid.codes(text)
        for g in {tuple(p[i : i + 3].tolist()) for i in range(len(p) - 2)}:
            counts[lang][g] = counts[lang].get(g, 0) + 1
    sets = {k: {g for g, n in sorted(c.items(), key=lambda x: -x[1])[:200]} for k, c in counts.items()}
    for _, text in texts[:20]:
        p = langid.codes(text)
        grams = [tuple(p[i : i + 3].tolist()) for i in range(len(p) - 2)]
        plain = np.array([sum(g in sets[k] for g in grams) / len(grams) for k in model.languages])
        assert np.abs(plain - langid.shares(text, model)).max() < 0.02


def test_awkward_rows(spark, awkward, nothing):
    model = langid.fit(awkward)
    found = {r["doc_id"]: r for r in langid.identify(awkward, model).collect()}
    for doc in (3, 4, 5, 7):
        assert (found[doc]["lang_pred"], found[doc]["score"]) == ("und", 0.0)
    assert found[8]["lang_pred"] in ("en", "fr")
    empty = langid.fit(nothing)
    assert empty.languages == []
    assert {r["lang_pred"] for r in langid.identify(awkward, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_more_languages_than_a_byte_holds(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 12] + letters[i % 12 + 7]) * 3 + " " + letters[i % 12] * 4, f"l{i % 12:02d}") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert len(model.filters) == 2
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 12:02d}" for r in langid.identify(frame, model).collect())


def test_counts_do_not_depend_on_the_partitions(documents):
    sample = documents.where("doc_id % 20 = 0")
    one = langid.fit(sample.coalesce(1))
    assert one.filters.any()
    for n in (32, 300):  # 300: a task has one document at most
        assert (one.filters == langid.fit(sample.repartition(n, "doc_id")).filters).all()
