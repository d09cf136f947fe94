"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, divergence, html_text, jaccard, mixing, pii, quality_rules, simhash, suffix_dedup, toxicity, variants, warc
from tidemark.llm.common import table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", "_stats.n_words", "_stats.word_chars", "_stats.n_symbols", "_stats.n_dup_lines", "_stats.n_repeat_words", "base_failed", "kept", "rule")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def vocabulary(path: str | None = None) -> str:
    """The JSON text of a public tokenizer's file, read by the driver alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), vocabulary())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


#: DuckDB's sha256 gives lower-case hex of the UTF-8 bytes.
OP10_SQL = """
WITH p AS (
    SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages WHERE page_id IS NOT NULL
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), w AS (SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
    SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
        1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
    FROM a JOIN v USING (lang)
), far AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), rows AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(far.value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far ON far.lang = x.lang AND far.source = x.source AND far.item = y.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict:
    return {
        "op1_html_text": op1_html_text,
        "op2_bpe": op2_bpe,
        "op3_pii": op3_pii,
        "op4_ann": op4_ann,
        "op5_mixing": op5_mixing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_simhash": op9_simhash,
        "op10_warc": op10_warc,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op11_jaccard": op11_jaccard,
        "op12_divergence": op12_divergence,
        "op13_variants": op13_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL, "op12_divergence": OP12_SQL}
