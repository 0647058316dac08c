"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evograph.llm import mixing, near_dedup, packing, pii, pu_quality, quality_rules, toxicity, url_lm, va_topk, warc_fixity
from evograph.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, size string, `__verdict` string, stats string"
LABELS = "doc_id long, quality int, toxic int"
LONG = "many words and 12 numbers again " * 30_000


def docs(spark, rows=None):
    base = [(1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two three four five six seven"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, LONG), (6, " \n\t "), (7, "a@b.cc +1 (555) 123-4567 moron"), (8, "é" * 50)]
    base = base if rows is None else rows
    return spark.createDataFrame([(i, t, None, None if n % 3 == 0 else f"s{n % 3}", None if t is None else len(t), "w", "s", "v", None) for n, (i, t) in enumerate(base)], DOCS)


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 0))):
    return spark.createDataFrame(list(rows), LABELS)


@pytest.fixture(params=["full", "empty"])
def input_docs(spark, request):
    return docs(spark) if request.param == "full" else docs(spark, [])


def test_rules(spark, input_docs):
    for lab in (labels(spark), labels(spark, ())):
        out = quality_rules.judge(input_docs, quality_rules.learn(input_docs, lab), "verdict")
        got = {r["doc_id"]: r["verdict"] for r in out.collect()}
        assert out.count() == input_docs.count()
        if got:
            assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
            assert got[5]["n_repeat_words"] == got[5]["n_words"] == 180_000


def test_rules_stage_keeps_columns(spark, input_docs):
    kept = quality_rules.keep(input_docs, quality_rules.DecisionList())
    assert kept.columns == input_docs.columns and kept.count() == 0


def test_mixing(spark, input_docs):
    rows = mixing.mix_report(input_docs).collect()
    assert len(rows) == input_docs.count()
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
    out = mixing.mix(input_docs)
    assert out.columns == input_docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_of_nothing_but_empty_texts(spark):
    assert [r["taken"] for r in mixing.mix_report(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_classifiers(spark, input_docs):
    for lab in (labels(spark), labels(spark, ()), labels(spark, ((1, 1, 1),))):
        for operator in (pu_quality, toxicity):
            out = operator.score(input_docs, operator.learn(input_docs, lab))
            assert out.count() == input_docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0


def test_near_dedup(spark, input_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.label(input_docs, n=4).collect()]
    assert len(got) == input_docs.count()
    if got:
        assert {g for g in got if g[0] in (1, 4)} == {(1, 4, 1, True), (4, 4, 1, False)} and sum(g[0] == 4 for g in got) == 2
        assert (None, 4, None, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    out = near_dedup.keep(input_docs)
    assert out.columns == input_docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == ([0, 1, 2, 3, 5, 6, 7, 8] if got else [])


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    out = near_dedup.keep(docs(spark, [(1, "same text"), (1, "same text"), (2, "other")]))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_personal_data(spark, input_docs):
    model = pii.learn(input_docs)
    out = pii.redact(input_docs, model)
    assert out.columns == input_docs.columns and out.count() == input_docs.count()
    if input_docs.count():
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        assert got[7][0] == "[EMAIL] [PHONE] moron" and got[7][1] == 21 and got[2][0] is None and got[5][0] == LONG


def test_packing(spark, input_docs):
    rows = packing.pack(input_docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in input_docs.collect()}
    assert sum(r["doc_id"] == 4 for r in rows) in (0, 2)
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3, 6))


def test_pipeline_stages(spark, input_docs, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    d = input_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, input_docs, str(tmp_path))
        assert out.columns == d.columns, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, input_docs, str(tmp_path)).count() >= input_docs.count()


def test_pipeline_from_end_to_end(spark, tmp_path):
    """run() is the stages one after another, on rows with every defined case and on no rows."""
    text = [" ".join(f"w{(i * k) % 97}" for k in range(1, 60 + i)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(text)] + [(20, text[3]), (20, text[3]), (21, text[4] + " end"), (22, None), (23, ""), (None, text[5] + " x y z"), (24, f"{LONG} a@b.cc")]
    for name, some in (("full", rows), ("empty", [])):
        at = tmp_path / name
        docs(spark, some).write.parquet(str(at / "documents.parquet"))
        labels(spark, ()).write.parquet(str(at / "labels.parquet"))
        got = sorted(map(tuple, corpus_pipeline.run(spark, str(at)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
        d = spark.read.parquet(str(at / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(at))
        assert got == sorted(map(tuple, d.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
        kept = {r[0] for r in got}
        assert not kept & {20, 21, 22, 23} and (len(kept) >= 5 if some else not kept)


def test_top_k_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (100, [1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, []), (None, [9.0, 9.0]), (7, [float("inf"), 0.0]), (0, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, block string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in va_topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()]
    s, t = 1024 * 1024, 512 * 512
    assert sorted(got) == [(0, 1, 1, s + t), (0, 2, 2, s + t), (0, 3, 100, s), (100, 1, 0, s), (100, 2, 0, s), (100, 3, 1, s)]
    assert va_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_topk_of_large_components(spark):
    big = [3e5, 1e6, -2e7, 123456.789]
    vectors = {0: [big[0], 1.0, -1.0], 1: [2e5, 1.0, 0.0], 2: [1e5, 0.0, 0.0], 3: [big[1], big[2], 0.5], 4: [-big[3], 2.0, 1.0], 5: [-9e12, 0.0, 0.0], 100: [1e6, 3.0, 0.25], 200: [0.0, 0.0, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in va_topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    want = []
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:3], 1)]
    assert sorted(got) == want and max(abs(w[3]) for w in want) > 2**53
    with pytest.raises(Exception, match="too large"):
        va_topk.top_k(df.unionAll(spark.createDataFrame([(7, [1e300, 0.0, 0.0])], df.schema)), F.col("vec_id") % 100 == 0, k=3).collect()


def test_urls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.ORG"), (5, "x://example.org/es/1?u=://b"), (None, "x://w.com/de/#a"), (6, "x://com/fr/?x"), (6, "x://com/fr/?x"), (7, "x://h?y://z/")], "page_id long, url string")
    for pages in (df, df.limit(0)):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_lm.judge(pages, url_lm.learn(pages)).collect()}
        if got:
            assert got[1] == got[2] == got[3] == ("", "", None, "allow")
            assert got[4][:3] == ("a.org", "", None) and got[5] == ("example.org", "/es/1", "example.org/es/", "block")
            assert got[None] == ("w.com", "/de/", "com/de/", "block") and got[6] == ("com", "/fr/", "com/fr/", "allow") and got[7][:2] == ("h", "")


def test_fixity_cases(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, None, None), (2, "u", ""), (3, "x\r\ny", "é" * 10_000)], "page_id long, url string, html string")
    other = F.when(F.col("page_id") == 2, "x").otherwise(F.col("html"))
    rows = warc_fixity.audit_pages(df, other, str(tmp_path / "a"), records=2, fan=2).collect()
    assert [(r["page_id"], r["status"]) for r in sorted(rows, key=lambda r: (r["file_id"], r["record_no"]))] == [(1, "ok"), (1, "ok"), (2, "corrupt"), (3, "ok"), (None, "ok")]
    back = {r["page_id"]: (r["url"], r["body"]) for r in warc_fixity.read_warc(spark, str(tmp_path / "a")).collect()}
    assert back == {"1": ("u", "a"), "2": ("u", "x"), "3": ("x%0D%0Ay", "é" * 10_000), None: (None, "")}
    assert warc_fixity.audit_pages(df.limit(0), other, str(tmp_path / "b")).collect() == []
