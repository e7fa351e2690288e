"""The operators bound to the test tables, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factsheet.llm import byte_bpe, html_text, licenses, mixing, ngram_trie, prefix_trie, quality_classifier, quality_rules, sentence_piece, simhash, top_k, url_filter, whitening
from factsheet.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=("page_id", "url"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id`` and ``bad`` of the pages whose document, the first number in the url's path, has a quality label."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"(\d+)", 1).try_cast("bigint")
    pages = table(spark, sf_dir, "pages").select("page_id", number.alias("doc_id"))
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return pages.join(labels, "doc_id").select("page_id", (F.col("quality") == 0).alias("bad"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, page_outcomes(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.scored(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the licences found, each once by name, the number of matches, and the characters of the first."""
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = F.try_element_at("licences", F.lit(1))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("licences.licence")), " ").alias("licences"),
        F.size("licences").cast("long").alias("n_matches"),
        first["begins"].alias("begins"),
        first["ends"].alias("ends"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.digests(table(spark, sf_dir, "documents"))


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: shipped(f)
    for f in (op1_html_text, op2_byte_bpe, op3_top_k, op4_url_filter, op5_simhash, op6_quality_rules, op7_ngram_trie, op8_mixing, op9_licenses, op10_quality_classifier, op11_whitening, op12_prefix_trie, op13_sentence_piece)
}

ORACLES: dict[str, str] = {
    "op4_url_filter": """
        WITH parts AS (
            SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), rated AS (
            SELECT p.host, l.bad FROM parts p
            JOIN (SELECT doc_id, max(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l
              ON l.doc_id = TRY_CAST(regexp_extract(p.path, '([0-9]+)', 1) AS BIGINT)
        ), hosts AS (
            SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, CASE WHEN regexp_matches(name, 'ADDRESS') THEN '[ip]' ELSE regexp_extract(name, 'IN_SUFFIX', 1) END AS suffix,
                CASE WHEN regexp_matches(name, 'ADDRESS') THEN name ELSE regexp_extract(name, 'IN_DOMAIN', 1) END AS domain
            FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(?::[0-9]*)?$', '') AS name FROM parts) LEFT JOIN (SELECT host, count(*) AS n, sum(CAST(bad AS INT)) AS k FROM rated GROUP BY host) USING (host)
        ), domains AS (
            SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
        ), suffixes AS (
            SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 10) FROM domains) AS m FROM domains GROUP BY suffix
        ), s1 AS (
            SELECT 1 / greatest(0.001, least(0.5, coalesce((sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.1))) - 1 AS s FROM suffixes
        ), domains2 AS (
            SELECT d.domain, d.n, d.k, (s * x.m + x.k) / (s + x.n) AS m FROM domains d JOIN suffixes x USING (suffix), s1
        ), s2 AS (
            SELECT 1 / greatest(0.001, least(0.5, coalesce((sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.1))) - 1 AS s FROM domains2
        ), hosts2 AS (
            SELECT h.host, h.n, h.k, (s * x.m + x.k) / (s + x.n) AS m FROM hosts h JOIN domains2 x USING (domain), s2
        ), s3 AS (
            SELECT 1 / greatest(0.001, least(0.5, coalesce((sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.1))) - 1 AS s FROM hosts2
        ), standing AS (
            SELECT host, rate - 2 * sqrt(rate * (1 - rate) / (s + n + 1)) AS bad_at_least FROM (SELECT host, n, s, (s * m + k) / (s + n) AS rate FROM hosts2, s3)
        ), rules(verdict, rule, on_host, on_path) AS (
            VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
                ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
        ), fits AS (
            SELECT page_id, url, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
            FROM (SELECT DISTINCT page_id, url, host, path FROM parts) JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path)
            GROUP BY page_id, url
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN t.bad_at_least > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts p LEFT JOIN standing t USING (host) LEFT JOIN fits f ON f.page_id = p.page_id AND f.url = p.url
    """,
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
for _name in ("ADDRESS", "IN_SUFFIX", "IN_DOMAIN"):
    ORACLES["op4_url_filter"] = ORACLES["op4_url_filter"].replace(f"'{_name}'", f"'{getattr(url_filter, _name)}'")
