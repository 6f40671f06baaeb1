"""The text operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from quakespark.llm.common import table
from quakespark.llm.decontamination import contamination
from quakespark.llm.exact_dedup import exact_copies
from quakespark.llm.hard_negatives import hard_negatives
from quakespark.llm.language import identify
from quakespark.llm.licenses import scan
from quakespark.llm.line_dedup import drop_repeated_lines, drop_repeated_passages
from quakespark.llm.mixing import mix
from quakespark.llm.ngram_join import ngram_jaccard
from quakespark.llm.packing import pack
from quakespark.llm.pii import find_pii
from quakespark.llm.ranked_search import ranked_search
from quakespark.llm.spotsigs import fingerprints
from quakespark.llm.warc import round_trip


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark, sf_dir):
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def op10_line_dedup_passages(spark, sf_dir):
    """All repeated passages; op10_line_dedup has the chunk rule that its SQL states."""
    return drop_repeated_passages(table(spark, sf_dir, "documents"))


def op11_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op12_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_hard_negatives(spark, sf_dir):
    """Anchors are every hundredth row; labels of every seventh move on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0, positives=5, k=10)


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op10_line_dedup_passages": op10_line_dedup_passages,
    "op11_decontamination": op11_decontamination,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op9_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
            SELECT page_id, html, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest
            FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS own FROM d)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = own THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> own THEN own END AS refers_to
        FROM m
    """,
    "op10_line_dedup": r"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
        h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
        r AS (SELECT *, ((h + 31 * coalesce(lag(h) OVER w, 0)) // 1024) % 2 AS bit, lead(i) OVER w IS NULL AS final
              FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        b AS (SELECT *, CASE WHEN bit = 0 AND lag(bit) OVER w = 1 AND NOT final THEN 1 ELSE 0 END AS ends
              FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
        t AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY ALL),
        d AS (SELECT doc_id, chunk, n, body, n > 1 AND row_number() OVER (PARTITION BY n > 1, body ORDER BY doc_id, chunk) > 1 AS gone FROM t)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
               count(*) FILTER (gone) AS removed_chunks, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text
        FROM d GROUP BY doc_id
    """,
    "op11_decontamination": rf"""
        WITH b AS (SELECT DISTINCT item_id, {_WORDS} AS ws FROM benchmark),
        k AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: list_aggregate(ws[i:i+9], 'string_agg', ' '))) AS run,
                     least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS (SELECT DISTINCT size FROM k),
        p AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, s WHERE len(ws) >= size),
        r AS (SELECT doc_id, size, i, list_aggregate(ws[i:i+size-1], 'string_agg', ' ') AS run FROM p),
        m AS (SELECT r.doc_id, r.i, r.size, k.item_id FROM r JOIN k ON r.run = k.run AND r.size = k.size),
        h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS w FROM m) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op12_ranked_search": rf"""
        WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
        c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM l),
        m AS (SELECT doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM l, c),
        q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY term, big_n),
        s AS (SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.id AS a, a.label AS own, b.id AS b, b.label AS label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM v a, v b WHERE a.id % 100 = 0),
        p AS (
            SELECT a, own, b, score FROM s WHERE own = label AND a <> b
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (
            SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
            FROM p JOIN s ON p.a = s.a AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT a AS anchor_id, pos AS positive_id, CAST(rank AS INT) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score
        FROM n WHERE rank <= 10
    """,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
