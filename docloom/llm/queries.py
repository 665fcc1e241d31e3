"""The queries of the ten operators with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, embedding, language, licenses, packing, pii, simhash, tokenfile, urls, wordpiece
from docloom.llm.common import new_path

#: Stands in for the secret that an operator of the pipeline would pass.
PSEUDONYM_KEY = "docloom-example-key"

URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, last = wordpiece.vocabulary(tokenizer_path())
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), pieces, last=last)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: text, language declared in the markup, address suffix and host are fused; the text model is fitted on documents."""
    model = language.fit(table(spark, sf_dir, "documents"), "text", "lang")
    found = language.identify(page_evidence(table(spark, sf_dir, "pages")), model, F.col("words"), F.col("declared"), F.col("host"))
    return found.select("page_id", "declared", "language", F.round("posterior", 4).alias("posterior"), "text_language", "accepted")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Rows (page_id, words, declared, host): a page's text without markup, the language its html tag names, its host."""
    host, _ = urls.split_url(F.col("url"))
    words = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]+)", 1)
    return pages.select("page_id", words.alias("words"), declared.alias("declared"), host.alias("host"))


def document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op4 on documents: lang is what they declare, source their host; the pipeline's first stage."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, "text", "lang")
    found = language.identify(docs.select("doc_id", "text", "lang", "source"), model, F.col("text"), F.col("lang"), F.col("source"))
    return found.select("doc_id", "language", F.round("posterior", 4).alias("posterior"), "text_language", "accepted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 4))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfile.read(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup, op2_url_filter, op3_token_counts, op4_language_id, op5_packing, op6_decontamination,
            op7_license_scan, op8_simhash_near_dedup, op9_pii_pseudonyms, op10_token_files, document_language, pipeline,
        )
    }


_CUT_URL = """
    cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut)
"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    return {
        "op2_url_filter": f"""
            WITH {_CUT_URL},
            rules(rule, rhost, rpath, verdict) AS (VALUES {values}),
            fits AS (
              SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
              FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
              GROUP BY page_id)
            SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
            FROM parts p LEFT JOIN fits f USING (page_id)
        """,
        "op1_embedding_near_dedup": """
            WITH RECURSIVE v AS (
              SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links AS (
              SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
            reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
            SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
                   least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
                   e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
            FROM embeddings e
        """,
    }
