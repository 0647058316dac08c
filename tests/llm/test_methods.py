"""Operators against brute force, round trips and held-out accuracy."""

import bisect
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evograph.llm import common, mixing, near_dedup, packing, pii, pu_quality, quality_rules, queries, thin, toxicity, url_lm, va_topk, warc_fixity
from evograph.llm.common import held_out

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def repeat_words(w, k=8):
    at = defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i : i + k])].append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + k)})


def test_op1_base(spark, texts):
    for r in queries.op1_quality_rules(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        rep = repeat_words(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert r["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_cover_finds_planted_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (4000, len(quality_rules.FEATURES)))
    bad = (x[:, 0] >= 7) & (x[:, 4] < 4)
    y = np.stack([rng.integers(0, 3, 4000) == 0, bad, np.ones(4000)], 1).astype(int)
    cuts = {f: [float(c) for c in range(1, 10)] for f in quality_rules.FEATURES}
    rules = quality_rules.cover(cuts, x, y).rules
    assert [sorted((lit.feature, lit.above, lit.cut) for lit in r) for r in rules] == [[("symbol_rate", True, 7.0), ("upper_rate", False, 4.0)]]


def test_op2_targets_and_taken(spark, texts):
    rows = queries.op2_source_mix(spark, SF).collect()
    again = {(r["doc_id"], r["taken"]) for r in queries.op2_source_mix(spark, SF).collect()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == again
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - target[s]) <= 0.05 * target[s]


def brute_targets(size):
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size))}
    total, out, left = sum(size.values()), {}, set(size)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size[s]
            left.remove(s)
    return out


def test_targets_with_caps(spark):
    size = {"a": 5, "b": 1000, "c": 1, "d": 400, "e": 90}
    df = spark.createDataFrame([(s, n, 1) for s, n in size.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(size))


def test_op3_and_op8_held_out(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    for operator, label, least in ((pu_quality, "quality", 0.7), (toxicity, "toxic", 0.3)):
        scores = operator.score(docs, operator.learn(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
        right = scores.select((F.col(label) == (F.col("score") >= least).cast("int")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
        assert right > 0.93, (label, right)


def test_folding_and_exceptions():
    assert toxicity.fold("Ｍ0r0n! мoron, m-o") == " moron moron m o "
    m = toxicity.Model({"trash": 2.0, "lowei*": 1.0}, ["trash can"])
    a = m.automaton()
    assert toxicity.hits(toxicity.fold("a trash can"), a) == (0, 0.0) and toxicity.hits(toxicity.fold("Tr4sh, loweitum x"), a) == (2, 3.0)


def test_op4_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.floor(np.array([r["embedding"] for r in rows], float) * 1024).astype(np.int64)
    got = defaultdict(list)
    for r in queries.op4_exact_topk(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == (ids % 100 == 0).sum()
    for i in np.flatnonzero(ids % 100 == 0):
        score, other = v @ v[i], ids != ids[i]
        best = np.lexsort((ids[other], -score[other]))[:10]
        assert sorted(got[ids[i]]) == [(n + 1, ids[other][b], score[other][b]) for n, b in enumerate(best)]


def test_va_bounds_hold():
    rng = np.random.default_rng(2)
    for size in (500, 1 << 40, 1 << 61):
        v, q = rng.integers(-size, size, (200, 6)), rng.integers(-500, 500, (9, 4))
        low, step, cells = va_topk.quantised(v)
        centres, reach = va_topk.bounds(q, low, step, cells)
        exact = np.array([[float(sum(a * b for a, b in zip(x, y))) for y in v.tolist()] for x in q.tolist()])
        assert (centres - reach[:, None] <= exact).all() and (exact <= centres + reach[:, None]).all()


def test_op4_of_ragged_vectors_in_small_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(va_topk, "BLOCK_BYTES", 1 << 9)
    monkeypatch.setattr(va_topk, "QUERY_BYTES", 1 << 14)
    monkeypatch.setattr(va_topk, "TOGETHER", 3)
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=int(rng.integers(0, 40))).round(2).tolist() for i in range(1000)}
    vectors[500] = rng.normal(size=3000).round(2).tolist()
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in va_topk.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    assert len(got) == 20
    for q in got:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_op5_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        for n, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            part = ids[2048 * n : 2048 * (n + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (n, 2048 * n, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(pieces) == math.ceil(len(ids) / 2048)
    assert fills(rows, 2048) == one_by_one([r["length"] for r in rows], 2048)


def test_word_cache_agrees_with_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, cache = Tokenizer.from_file(queries.tokenizer_path()), packing.WordCache(queries.tokenizer_path())
    hard = ["á b don't can'T\tq\r\nff", "x <|endoftext|> y<|startoftext|>z", " ́a ΣΑΣ ﬁ İß", "\x1cab\x1d c\x85d", "一二 12ab %%% a%% b's! É.", "", "  ", "a​b _x_ (y) zz...\n\n"]
    assert cache.ids(hard) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in hard]


def one_by_one(lengths, cap):
    """Fills of the sequences of best-fit decreasing, piece by piece."""
    gaps, full = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, length)
        gap = gaps.pop(k) if k < len(gaps) else cap
        if gap > length:
            bisect.insort(gaps, gap - length)
        else:
            full += 1
    return sorted([cap - g for g in gaps] + [cap] * full)


def fills(rows, cap):
    """Fills of the sequences of placed rows, which must lie without gaps and overlaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= cap
    return sorted(sum(n for _, n in held) for held in by.values())


def test_packing_equals_best_fit_one_by_one(spark):
    rng = random.Random(5)
    for cap in (10, 50, 2048):
        lengths = [rng.choice((rng.randint(1, cap), rng.randint(1, max(1, cap // 9)))) for _ in range(3000)]
        pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], packing.PIECES)
        want = one_by_one(lengths, cap)
        assert fills(packing.place(pieces, cap, shard=10_000).collect(), cap) == want
        dealt = packing.place(pieces, cap, shard=300).collect()
        assert sorted(r["place"] for r in dealt) == list(range(3000))
        assert len(fills(dealt, cap)) <= len(want) + 2


def exact_components(texts, n):
    sets = {d: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for d, t in texts.items() for w in [(t or "").encode().lower().split()] if w}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        count = defaultdict(int)
        for s in sets[d]:
            for o in holders[s]:
                count[o] += 1
            holders[s].append(d)
        for o, c in count.items():
            if 100 * c >= 80 * (len(sets[d]) + len(sets[o]) - c) and root(o) != root(d):
                a, b = sorted((root(o), root(d)))
                up[b] = a
    return {d: (len(sets.get(d, ())), root(d)) for d in texts}


def test_op6_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_near_dedup(spark, SF).collect()}
    assert got == exact_components(texts, 4)


def test_near_group_around_the_threshold(spark):
    """A group of edits of one text whose pairs lie on both sides of the threshold."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {i: " ".join(w if rng.random() > 0.012 * (i % 5) else f"x{rng.random()}" for w in base) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.label(df, n=4).collect()}
    assert got == exact_components(texts, 4)


def bucket_with_a_pair(n):
    """Texts of one bucket of a band: 0 to 29 have little in common but five shingles; 30 and 31 are similar, and share no other band."""
    rng, pair = random.Random(8), None
    code = lambda words: near_dedup.shingles(" ".join(words).encode(), n)
    while pair is None:
        a = [f"w{rng.random()}" for _ in range(26 + n)]
        keys = near_dedup.band_keys(near_dedup.signature(code(a)))
        for _ in range(300):
            b = [*a[:-3], f"x{rng.random()}", *a[-2:]]  # 24 of 30 shingles in common
            shared = np.flatnonzero(near_dedup.band_keys(near_dedup.signature(code(b))) == keys)
            if len(shared) == 1 and near_dedup.similar(code(a), code(b), 80):
                pair = a, b
                break
    band, key, sig = shared[0], keys[shared[0]], near_dedup.signature(code(a))
    rows = slice(band * near_dedup.ROWS, (band + 1) * near_dedup.ROWS)
    grams = [a[i : i + n] for i in range(27)]
    least = [g for g in grams if (near_dedup.signature(code(g))[rows] == sig[rows]).any()]
    out = []
    while len(out) < 30:
        words = [w for g in least for w in [f"z{rng.random()}" for _ in range(2)] + g]
        if near_dedup.band_keys(near_dedup.signature(code(words)))[band] == key:
            out.append(words)
    out[29] = [*out[28], "end"]  # these two share other bands
    return {i: " ".join(w) for i, w in enumerate([*out, *pair])}


def test_pair_of_a_large_bucket_that_shares_no_other_band(spark, monkeypatch):
    texts = bucket_with_a_pair(4)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 1)  # a bucket of more than 16 is large
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.label(df, n=4).collect()}
    assert got == exact_components(texts, 4) and got[31][1] == 30


def test_pipeline_stage_drops_the_copy_in_a_large_bucket(spark, monkeypatch):
    texts = bucket_with_a_pair(5)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, "").collect()} == {*range(29), 30}


def test_parts_of_repeated_ids_are_all_kept(spark, monkeypatch):
    """Ids with two texts each, in one large bucket: each pair of similar texts meets."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 1)
    words = lambda stem, n: [f"{stem}.{i}" for i in range(n)]
    rows = []
    for p in range(12):
        both = words(f"p{p}", 40)
        for i, text in ((2 * p, both), (2 * p + 1, [*both, "end"])):
            rows += [(i, " ".join(text)), (i, " ".join(words(f"other{i}", 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = near_dedup.digests(docs, 4).select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("id"), "n_shingles", F.col("doc_id").alias("label"))
    a, b = (near_dedup.divided(docs, left, 4, 80).select("key", F.col("id").alias(c)) for c in "ab")
    met = {(r["a"], r["b"]) for r in a.join(b, "key").where("a < b").collect()}
    assert {(2 * p, 2 * p + 1) for p in range(12)} <= met


def test_rarest_shingles_meet_whatever_their_order():
    rng = np.random.default_rng(6)
    for size in (1, 2, 5, 9, 40, 41):
        for _ in range(300):
            both = np.unique(rng.integers(0, 1 << 60, size, np.uint64))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 60, rng.integers(0, 1 + size // 4), np.uint64)])) for _ in range(2))
            rarity = rng.integers(0, 3, 64)
            if near_dedup.similar(a, b, 80):
                assert len(np.intersect1d(near_dedup.rarest(a, rarity, 80), near_dedup.rarest(b, rarity, 80)))


def test_fewest_matches_bounds_the_posterior():
    n, least = near_dedup.fewest_matches(0.8, 160, 1e-6)[-1]
    rng = np.random.default_rng(1)
    assert n == 160 and (rng.binomial(160, 0.8, 200_000) < least).mean() < 1e-4 and (rng.binomial(160, 0.5, 2000) < least).mean() > 0.99


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_op7_base_spans(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["1", "4", "2.", " ", "-", "+", "a", "@", "b.c", "(", "é", "4111111111111111", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["1 2 3 " * 5000, "a@" * 5000 + "b.c", "9" * 30_000 + ".1.1.1", "+1" + "(" * 20_000, "a@b" + ".c" * 10_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_spans(df, pii.Model(), "x").select("doc_id", pii.written(F.col("x")["base"]).alias("base")).collect()
    for r in found:
        assert r["base"] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_label_model_trusts_check_digits():
    patterns = np.array([[1, 0, 1], [0, 1, 0], [0, -1, 0], [1, 1, 0], [0, 0, 0]])
    accuracy, post = pii.aggregate_votes(patterns, np.array([500, 300, 40, 200, 50]))
    assert post[0] > 0.9 and post[1] > 0.7 and post[2] < 0.3 and post[4] == pytest.approx(0.5) and (accuracy > 0.5).all()


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    found = warc_fixity.audit_pages(pages, F.col("html"), str(tmp_path / "w"), records=8, fan=2).cache()
    assert found.count() == pages.count() and not found.where("corrupt or status <> 'ok' or root_sha256 <> replica_root_sha256").count()
    back = warc_fixity.read_warc(spark, str(tmp_path / "w"))
    key = ["file_id", "record_no", "offset", "length", "sha256"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, found.select(*key).collect()))
    assert {(int(r["page_id"]), r["url"], r["body"]) for r in back.collect()} == {tuple(r) for r in pages.collect()}
    assert found.agg(F.max("file_id")).first()[0] > 4  # so that the collection's tree has more than one level


def test_warc_audit_of_lost_added_moved_and_corrupt_records(spark):
    rows = [(f"r{i}", i // 8, i % 8, 10 * (i % 8), 6, f"h{i}") for i in range(40)]
    of = lambda rows: spark.createDataFrame(rows, "record_id string, file_id long, record_no int, offset long, length long, sha256 string")
    other = [r for r in rows if r[0] != "r9" and r[1] != 4]  # a record of file 1 and the whole of file 4 are gone
    other = [(i, f, n - (f == 1 and n > 1), *rest) for i, f, n, *rest in other]  # those behind it move up
    other = [(i, f, n, o, s, "bad" if i == "r3" else h) for i, f, n, o, s, h in other] + [("new", 3, 8, 80, 6, "h"), ("next", 5, 0, 0, 6, "h")]
    got = {r["record_id"]: r["status"] for r in warc_fixity.audit(of(rows), of(other), records=8, fan=2).collect()}
    want = {f"r{i}": "ok" for i in range(40)} | {f"r{i}": "moved" for i in range(10, 16)} | {f"r{i}": "lost" for i in range(32, 40)}
    assert got == want | {"r9": "lost", "r3": "corrupt", "new": "added", "next": "added"}


def witten_bell(urls, order):
    """Probability of a symbol behind a context, by recursion over dictionaries of counts."""
    n, follow = defaultdict(int), defaultdict(set)
    for u in urls:
        s = [url_lm.START] * order + [max(b, 2) for b in (u or "").encode()] + [url_lm.END]
        for at in range(order, len(s)):
            for k in range(order + 1):
                n[tuple(s[at - k : at + 1])] += 1
    return n


def brute_ratio(allowed, blocked, url, order):
    """Log-likelihood ratio for each byte, from kept counts alone."""
    seen = [witten_bell(u, order) for u in (allowed, blocked)]
    kept = {g for g in seen[0].keys() | seen[1].keys() if len(g) <= url_lm.SHORT or seen[0][g] + seen[1][g] >= url_lm.OFTEN}
    after = [defaultdict(dict) for _ in seen]
    for by, n in zip(after, seen):
        for g in kept:
            if n[g]:
                by[g[:-1]][g[-1]] = n[g]

    def p(by, g):
        if not g:
            return 1 / 256
        below, c = p(by, g[1:]), by.get(g[:-1])
        return below if not c else (c.get(g[-1], 0) + len(c) * below) / (sum(c.values()) + len(c))

    s = [url_lm.START] * order + [max(b, 2) for b in url.encode()] + [url_lm.END]
    return sum(math.log(p(after[0], tuple(s[at - order : at + 1])) / p(after[1], tuple(s[at - order : at + 1]))) for at in range(order, len(s))) / (len(s) - order)


def brute_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_lm.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


@pytest.mark.parametrize("part", [url_lm.PART, 700])
def test_op10_brute_force(spark, monkeypatch, part):
    """Host, path and rule by hand, scores from dictionaries of counts; the model whole and in parts."""
    monkeypatch.setattr(url_lm, "PART", part)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    model = url_lm.learn(pages)
    assert (model.parts > 1) == (part == 700)
    aside = {r["url"] for r in pages.where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    train = [[u for u in urls.values() if u not in aside and brute_rule(*brute_parts(u))[1] == v] for v in ("allow", "block")]
    rows = url_lm.judge(pages, model).collect()
    assert len(rows) == len(urls)
    for n, r in enumerate(rows):
        host, path = brute_parts(urls[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("allow" if r["score"] >= model.threshold else "block"))
        if n < 40:
            assert r["score"] == pytest.approx(brute_ratio(*train, urls[r["page_id"]], url_lm.ORDER), abs=1e-9)


def test_language_model_grows_and_prefers_what_it_saw(spark):
    urls = [(i, f"http://a{i % 9}.org/fr/{i}") for i in range(80)] + [(200 + i, f"http://b{i % 7}.com/de/{i * 7}") for i in range(80)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    small, large = url_lm.learn(pages.where("page_id % 4 = 0")), url_lm.learn(pages)
    assert large.weights.count() > small.weights.count()
    new = spark.createDataFrame([(1, "http://c.net/fr/7"), (2, "http://c.net/de/7"), (3, "x" * 200_000), (4, ""), (5, None)], "page_id long, url string")
    score = {r["page_id"]: r["score"] for r in url_lm.judge(new, large).collect()}
    assert score[1] > score[2] and score[4] == score[5] == 0


def test_thinned_side_loses_no_match(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    big = spark.range(20_000).selectExpr("id", "cast(id as string) as text")
    keys = spark.range(0, 20_000, 7).selectExpr("id as k", "id * 2 as more")
    assert thin.thin_join(big, keys, "id", "k").count() == keys.count()
    assert thin.thinned(big, F.col("id"), keys.select("k")).count() < 1.1 * keys.count()


def test_op3_score_by_hand(spark, texts):
    """The written-out expression equals the model's bins and weights, read in Python."""
    import regex

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.learn(docs, labels)
    assert model.cuts

    def features(t):
        w = words(t)
        n, chars = max(len(w), 1), max(len(t), 1)
        count = lambda p: len(regex.findall(p, t))
        return [math.log1p(len(w)), len(set(w)) / n**0.8, sum(map(len, w)) / n, count(r"[#*$%&|<>=_~^]") / n, count(r"\p{Lu}") / chars, count("[!?]") / n, count(r"\n") / n, count("[0-9]") / chars]

    for r in pu_quality.score(docs, model).collect():
        at = [bisect.bisect_right(c, x) for c, x in zip(model.cuts, features(texts[r["doc_id"]] or ""))]
        z = model.bias + sum(w[b] for w, b in zip(model.single, at))
        for (f, g), w in zip(pu_quality.CROSSED, model.crossed):
            i, j = pu_quality.FEATURES.index(f), pu_quality.FEATURES.index(g)
            z += w[at[i] * (len(model.cuts[j]) + 1) + at[j]]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_op8_score_by_hand(spark):
    """Hits word by word, without an automaton."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert model.lexicon
    pairs = {tuple(p.split()) for p in model.exceptions}
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for r in toxicity.score(docs, model).collect():
        w, total, n = toxicity.fold(whole[r["doc_id"]]).split(), 0.0, 0
        for i, x in enumerate(w):
            fit = [v for t, v in model.lexicon.items() if (x.startswith(t[:-1]) if t.endswith("*") else x == t)]
            if fit and not {tuple(w[i : i + 2]), tuple(w[max(i - 1, 0) : i + 1])} & pairs:
                n, total = n + 1, total + max(fit)
        z = sum(a * b for a, b in zip(model.weights, (1, math.log1p(total), min(100 * total / max(len(w), 1), 50), float(n > 0))))
        assert r["n_hits"] == n and r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)
        seen += n > 0
    assert seen
