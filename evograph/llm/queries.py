"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_dedup, packing, pii, pu_quality, quality_rules, toxicity, url_lm, va_topk, warc_fixity
from .common import held_out, shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    v = F.col("verdict")
    return quality_rules.judge(docs, rules, "verdict").select(
        "doc_id", *[v[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")]
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(pu_quality.score(docs, pu_quality.learn(docs, table(spark, sf_dir, "labels"))), 0.7)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label(table(spark, sf_dir, "documents"), n=4)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, x = pii.with_spans(docs, pii.learn(docs), "x"), F.col("x")
    count = lambda kind: F.size(F.filter(x["base"], lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.written(x["base"]), 256).alias("base_sha256"), pii.written(x["spans"]).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))), 0.3)


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files, the first character of every 211th page's body being another, and audits the files."""
    flipped = F.when(F.col("page_id") % 211 == 7, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return warc_fixity.audit_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), flipped, path)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lm.judge(pages, url_lm.learn(pages))



def _nodes(below: str) -> str:
    """SQL of a level of tree nodes, each over up to eight nodes of the level ``below``."""
    own = f"{below}[8 * j + 1:8 * j + 8]"
    digest = f"sha256({own}[1].s || '|' || {own}[-1].e || '|' || array_to_string(list_transform({own}, lambda c: c.h), ''))"
    return f"list_transform(range(0, CAST(ceil(len({below}) / 8.0) AS BIGINT)), lambda j: {{'s': {own}[1].s, 'e': {own}[-1].e, 'h': {digest}}})"


def _warc_sql() -> str:
    http = "'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(coalesce({0}, '')) || nl || nl || coalesce({0}, '')"
    record = (
        "'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <' || name || '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || "
        "'WARC-Target-URI: ' || replace(replace(coalesce(nullif(url, ''), name), chr(13), '%0D'), chr(10), '%0A') || nl || "
        f"'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || strlen({http}) || nl || nl || {http}"
    )
    tree = lambda k: f"list({{'s': o{k}, 'e': o{k} + n{k}, 'h': h{k}}} ORDER BY record_no)"
    offset = lambda k: f"CAST(coalesce(sum(n{k} + 4) OVER (PARTITION BY file_id ORDER BY record_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o{k}"
    return f"""
        WITH p AS (SELECT *, chr(13) || chr(10) AS nl, 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') AS name, CASE WHEN page_id % 211 = 7 THEN '?' || substr(html, 2) ELSE html END AS other FROM pages),
        r AS (SELECT page_id, {record.format("html")} AS t1, {record.format("other")} AS t2 FROM p),
        h AS (SELECT page_id, sha256(t1) AS h1, strlen(t1) AS n1, sha256(t2) AS h2, strlen(t2) AS n2 FROM r),
        i AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS LAST, h1) - 1 AS k FROM h),
        f AS (SELECT *, k // 512 AS file_id, CAST(k % 512 AS INTEGER) AS record_no FROM i),
        o AS (SELECT *, {offset(1)}, {offset(2)} FROM f),
        a0 AS (SELECT file_id, {tree(1)} AS x, {tree(2)} AS y FROM o GROUP BY file_id),
        a1 AS (SELECT file_id, {_nodes("x")} AS x, {_nodes("y")} AS y FROM a0),
        a2 AS (SELECT file_id, {_nodes("x")} AS x, {_nodes("y")} AS y FROM a1),
        a3 AS (SELECT file_id, {_nodes("x")} AS x, {_nodes("y")} AS y FROM a2)
        SELECT page_id, o.file_id, record_no, o1 AS "offset", n1 AS length, h1 AS sha256, sha256(x[1].h) AS root_sha256, sha256(y[1].h) AS replica_root_sha256,
            CASE WHEN h1 = h2 THEN 'ok' ELSE 'corrupt' END AS status, h1 <> h2 AS corrupt
        FROM o JOIN a3 ON o.file_id = a3.file_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_topk": op4_exact_topk,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_url_filter": op10_url_filter,
}

#: DuckDB SQL, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op9_warc_fixity": _warc_sql(),
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY rank <= 10""",
    "op6_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(id, low) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT g.b, r.low FROM reach r JOIN both_ways g ON r.id = g.a),
        c AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
        SELECT w.doc_id, coalesce(len(s.s), 0) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id, coalesce(c.low, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN c ON c.id = w.doc_id""",
}
