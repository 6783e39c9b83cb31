"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, jaccard, language, main_text, pieces, pii, repeats, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=b"a key for tests; a real one comes from a secret store")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeats, op2_pii, op3_decontaminate, op4_pieces, op5_warc, op6_token_counts, op7_language, op8_exact_dedup, op9_main_text, op10_jaccard)}

#: Words of a text in DuckDB: A-Z lower-cased, then runs of what is no other ASCII than digits and letters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS m FROM documents),
        r AS (SELECT doc_id, sha256(m) AS text_sha256,
              first_value(doc_id) OVER (PARTITION BY m ORDER BY length(t) DESC, doc_id) AS keep_id,
              count(*) OVER (PARTITION BY m) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        c AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM c),
        p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM p) JOIN win USING (n, g)),
        places AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep, sha1(payload) AS h FROM p),
        v AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM r),
        t AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[k // 4 + 1] >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1, 1)), '') AS digest FROM v)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keep THEN keep END AS refers_to, coalesce(url, 'urn:none') AS url FROM t""",
    "op10_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM p),
        k AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM common JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE n >= 0.8 * (a.size + b.size - n) - 1e-9),
        near AS (SELECT x, y FROM links UNION SELECT n.x, l.y FROM near n JOIN links l ON n.y = l.x),
        whole AS (SELECT x, least(x, min(y)) AS class_id, count(DISTINCT y) + CASE WHEN bool_or(x = y) THEN 0 ELSE 1 END AS class_size FROM near GROUP BY x),
        many AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(class_size, 1) AS BIGINT) AS class_size, coalesce(n_links, 0) AS n_links
        FROM d LEFT JOIN whole w ON w.x = doc_id LEFT JOIN many m ON m.x = doc_id""",
}
