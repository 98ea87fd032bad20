"""The queries of the operators, one each, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, erasure, langid, merkle, mixing, positional, pseudo_likelihood, quality, records, secrets, sharding, simhash, toxicity
from .common import table


def _remainder(of: int):  # noqa: ANN202
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(of))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    return langid.identify(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 8)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.encoded(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), simhash.Shape())
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    found = toxicity.scores(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20).select("query_id", "rank", "vec_id", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.digests(positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.shop(spark, sf_dir)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    found = quality.scored(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_sharding, op3_token_records, op4_pseudo_likelihood, op5_simhash, op6_mixing, op7_toxicity, op8_secrets, op9_neighbours, op10_decontamination, op11_erasure, op12_quality, op13_merkle, pipeline)
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + "))"
#: CRC-32 of a decimal number, bit by bit: each byte is followed by eight markers to shift.
_CRC = """xor(list_reduce(flatten(list_concat([[4294967295::UBIGINT]], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda x: list_concat([ascii(x)::UBIGINT], [999::UBIGINT, 999, 999, 999, 999, 999, 999, 999])))),
    lambda c, b: CASE WHEN b < 256 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END), 4294967295::UBIGINT)"""
#: A table named {0}_up of every node of the trees over {0} (g, pos, hash): g, level, pos, hash, and what it was made of.
_TREE = """{0}_up AS (
    SELECT g, 0 AS level, pos, hash, hash AS pre, n FROM {0}
    UNION ALL
    SELECT g, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos), (any_value(n) + 1) // 2
    FROM {0}_up WHERE n > 1 GROUP BY g, level, pos // 2
)"""

#: The others can't be said in SQL: models, hash bits over whole texts, tokenizers, entropy windows, draws by a hash
#: that DuckDB lacks. Tests compare each with a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS words FROM starts),
        placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
        following AS (
            SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM placed
        ),
        lengths AS (SELECT DISTINCT n FROM windows),
        phrases AS (SELECT r, p, n, array_to_string(w[1 : n], ' ') AS words FROM following JOIN lengths ON len(w) >= n),
        hits AS (SELECT r, p, n, item_id FROM phrases JOIN windows USING (n, words)),
        hit_words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS p FROM hits) GROUP BY r),
        hit_items AS (
            SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
    """,
    "op13_merkle": f"""
        WITH RECURSIVE raw AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(concat('=', lang), '') AS g, {_LEAF.format(n_chars="n_chars")} AS leaf,
                CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(n_chars="(n_chars + 1)")} END AS changed
            FROM documents
        ),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS hash FROM raw
        ),
        {_TREE.format("leaves")},
        tops AS (SELECT 'all' AS g, g AS lang, hash, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM leaves_up WHERE n = 1),
        {_TREE.format("tops")},
        heights AS (SELECT g, max(level) AS h FROM leaves_up GROUP BY g),
        steps AS (
            SELECT r, u.level AS k, u.pre, (l.pos >> (u.level - 1)) & 1 AS slot
            FROM leaves l JOIN leaves_up u ON u.g = l.g AND u.level > 0 AND u.pos = l.pos >> u.level
            UNION ALL
            SELECT r, h + u.level, u.pre, (t.pos >> (u.level - 1)) & 1
            FROM leaves l JOIN heights ON heights.g = l.g JOIN tops t ON t.lang = l.g JOIN tops_up u ON u.level > 0 AND u.pos = t.pos >> u.level
        ),
        proofs AS (SELECT r, sha256(string_agg(concat(pre[1 : slot * 64], pre[slot * 64 + 65 :]), '' ORDER BY k)) AS proof, max(k) AS most FROM steps GROUP BY r),
        folds AS (
            SELECT r, 0 AS k, coalesce(changed, leaf) AS own FROM leaves
            UNION ALL
            SELECT r, s.k, sha256(concat(pre[1 : slot * 64], own, pre[slot * 64 + 65 :])) FROM folds f JOIN steps s USING (r) WHERE s.k = f.k + 1
        ),
        ends AS (SELECT r, arg_max(own, k) AS folded_root FROM folds GROUP BY r)
        SELECT doc_id, leaf, t.hash AS subroot, root.hash AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root.hash AS verified
        FROM leaves JOIN tops t ON t.lang = leaves.g JOIN ends USING (r) LEFT JOIN proofs USING (r) CROSS JOIN (SELECT hash FROM tops_up WHERE n = 1) root
    """,
}
