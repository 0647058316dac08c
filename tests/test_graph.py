"""Operators on tiny graphs, and equalities between different ways to the same result."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evograph import jobs
from evograph.functions import curves, scalars
from evograph.operators import algorithms as alg
from evograph.operators import engine, incremental, mutate, post, tiles
from evograph.operators.sequence import rewrite, with_sequence
from evograph.plans import queries
from evograph.session import cut
from evograph.sources import edge_io, graphs
from evograph.streaming import runner

DIAMOND = [(0, 1, 1.0), (0, 2, 4.0), (1, 3, 5.0), (2, 3, 3.0)]
PATH = [(i, i + 1, 1.0) for i in range(4)]


def edges(spark, rows):
    return spark.createDataFrame([(r[0], r[1], float(r[2]) if len(r) > 2 else 1.0) for r in rows], "src long, tgt long, weight double")


def start(spark, i=0):
    return spark.createDataFrame([(i,)], "id long")


def values(df):
    a, b = df.columns[:2]
    return {r[a]: r[b] for r in df.collect()}


def test_searches_and_paths(spark):
    assert values(alg.bfs(edges(spark, PATH), start(spark))) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    d = edges(spark, DIAMOND)
    assert values(alg.sssp(d, start(spark))) == {0: 0, 1: 1, 2: 4, 3: 6}
    assert values(alg.sswp(d, start(spark))) == {1: 1, 2: 4, 3: 3}
    assert values(alg.bfs(d, start(spark), hops=2)) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert values(alg.bfs(d, start(spark, 99))) == {99: 0}


def test_components(spark):
    assert values(alg.components(edges(spark, [(2, 0), (2, 1)]))) == {0: 0, 1: 1, 2: 2}
    assert values(alg.components(edges(spark, [(2, 0), (2, 1)]), symmetrize=True)) == {0: 0, 1: 0, 2: 0}
    assert values(alg.components(edges(spark, [(0, 1), (2, 3)]))) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert values(alg.components(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]))) == {i: 0 for i in range(4)}
    assert alg.components(edges(spark, [])).collect() == []


def test_ranks(spark):
    assert values(alg.pagerank(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]))) == pytest.approx({i: 1.0 for i in range(4)})
    d = edges(spark, DIAMOND)
    assert values(alg.pagerank(d, 6)) == pytest.approx(values(alg.pagerank_delta(d, 6)))
    star = values(alg.pagerank(edges(spark, [(i, 0) for i in range(1, 5)]), 10))
    assert star[1] == pytest.approx(0.15) and star[0] == pytest.approx(0.15 + 0.85 * 4 * 0.15)
    kept = values(alg.pagerank_delta(d, 12, delta=0.01, drop_small=False))
    assert kept == pytest.approx(values(alg.pagerank(d, 12)), rel=0.05)


def test_critical_neighbours(spark):
    d = edges(spark, DIAMOND)
    state = alg.sssp(d, start(spark)).select("id", F.col("dist").alias("value"))
    assert values(engine.critical(d, state, engine.SSSP)) == {1: 0, 2: 0, 3: 1}
    wide = alg.sswp(d, start(spark)).select("id", F.col("width").alias("value")).unionAll(spark.createDataFrame([(0, float("inf"))], "id long, value double"))
    assert values(engine.critical(d, wide, engine.SSWP)) == {1: 0, 2: 0, 3: 2}


def test_evolving_equals_from_scratch(spark):
    rows = [(i, (i * 7 + 3) % 23, 1.0 + i % 5) for i in range(23)] + [(i, (i * 5 + 1) % 23, 2.0) for i in range(23)]
    logs, live = [], []
    for k in range(4):
        new = rows[k * 12 : (k + 1) * 12]
        gone = live[:2] if k else []
        live = [e for e in live if e not in gone] + new
        logs.append((edges(spark, live), edges(spark, gone), list(live)))
    begin = start(spark, 0).select("id", F.lit(0.0).alias("value"))
    got = incremental.evolve([(a, b) for a, b, _ in logs], lambda e: begin, engine.SSSP)
    for (state, _), (now, _, _) in zip(got, logs):
        assert values(state) == values(alg.sssp(now, start(spark, 0)))
    labels = lambda e: graphs.vertices(e).select("id", F.col("id").alias("value"))
    only = [(edges(spark, rows[: 12 * (k + 1)]), edges(spark, [])) for k in range(3)]
    for (state, restarted), (now, _) in zip(incremental.evolve(only, labels, engine.CC, labels), only):
        assert values(state) == values(alg.components(now))
        assert restarted == (now is only[0][0])


def test_tree_and_other_deletions(spark):
    begin = start(spark).select("id", F.lit(0).alias("value"))
    path, cut_path = edges(spark, PATH), edges(spark, [e for e in PATH if e[0] != 1])
    (_, (after, restarted)) = incremental.evolve([(path, edges(spark, [])), (cut_path, edges(spark, [(1, 2)]))], lambda e: begin, engine.BFS)
    assert restarted and values(after) == {0: 0, 1: 1}
    extra = [(0, 1), (0, 2), (1, 2)]
    (_, (after, restarted)) = incremental.evolve([(edges(spark, extra), edges(spark, [])), (edges(spark, extra[:2]), edges(spark, [(1, 2)]))], lambda e: begin, engine.BFS)
    assert not restarted and values(after) == {0: 0, 1: 1, 2: 1}


def test_components_under_deletions(spark):
    """Vertices that lose their last edge leave, also where no label went along it; one comes back."""
    labels = lambda e: graphs.vertices(e).select("id", F.col("id").alias("value"))
    first, second, third = [(5, 3), (0, 1), (1, 2)], [(0, 1), (1, 2)], [(0, 1), (1, 2), (3, 4), (2, 6)]
    logs = [(first, []), (second, [(5, 3)]), (third, []), (third[:1] + third[2:], [(1, 2)])]
    got = incremental.evolve([(edges(spark, a), edges(spark, b)) for a, b in logs], labels, engine.CC, labels)
    assert [values(s) for s, _ in got] == [values(alg.components(edges(spark, a))) for a, _ in logs]
    assert [r for _, r in got] == [True, False, False, True]


def test_long_paths_are_followed_to_their_end(spark):
    n = 300
    path = edges(spark, [(i, i + 1, 1 + i % 3) for i in range(n)])
    assert values(alg.bfs(path, start(spark), hops=4)) == {i: i for i in range(n + 1)}
    n = 110
    path = edges(spark, [(i, i + 1, 1 + i % 3) for i in range(n)])
    assert values(alg.components(path, hops=4)) == {i: 0 for i in range(n + 1)}
    assert values(alg.sssp(path, start(spark), hops=4))[n] == sum(1 + i % 3 for i in range(n))
    begin = start(spark).select("id", F.lit(0).alias("value"))
    with pytest.raises(RuntimeError):
        engine.run(engine.prepared(edges(spark, PATH)), engine.seeded(begin), engine.BFS, max_rounds=3)
    assert engine.run(engine.prepared(edges(spark, PATH)), engine.seeded(begin), engine.BFS, max_rounds=5).count() == 5


def test_long_evolving_path(spark):
    n = 104
    rows = [(i, i + 1, 5.0) for i in range(n)]
    whole, none = edges(spark, rows), edges(spark, [])
    begin = start(spark).select("id", F.lit(float("inf")).alias("value"))
    first, second = incremental.evolve([(edges(spark, rows[:1]), none), (whole, none, edges(spark, rows[1:]))], lambda live: begin, engine.SSWP)
    assert not second[1] and {k: v for k, v in values(second[0]).items() if k} == {i: 5.0 for i in range(1, n + 1)}


def test_hubs_are_dealt_and_give_the_same(spark, monkeypatch):
    rows = [(0, i, i) for i in range(1, 40)] + [(i, (i * 7) % 40, 2) for i in range(1, 40)] + [(5, i, 3) for i in range(6, 30)]
    e = edges(spark, [r for r in rows if r[0] != r[1]])
    results = lambda: [values(alg.bfs(e, start(spark, 3))), values(alg.sssp(e, start(spark, 3))), values(alg.components(e)), values(alg.pagerank(e)), values(alg.pagerank_delta(e))]
    plain = results()
    prepared = engine.prepared
    monkeypatch.setattr(engine, "prepared", lambda *a, **k: prepared(*a, **k | {"hub": 10}))
    kept = engine.prepared(e)
    assert kept.hubs.count() == 2 and kept.heavy.count() >= 60 and sorted(map(tuple, kept.plain().collect())) == sorted(map(tuple, e.collect()))
    for a, b in zip(plain, results()):
        assert a == pytest.approx(b)


def test_evolving_ranks_equal_from_scratch(spark):
    rows = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, (i * 5 + 1) % 23) for i in range(23)] + [(40, 41), (41, 40)]
    lives = [rows[:25], rows[3:40] + rows[46:], rows[5:46]]
    found = incremental.evolve_ranks([(edges(spark, live), edges(spark, [])) for live in lives], 1e-5)
    for ranks, live in zip(found, lives):
        assert values(ranks) == pytest.approx(values(alg.pagerank(edges(spark, live), 60, together=10)), abs=2e-3)


def test_mutation(spark):
    twice = edges(spark, [(0, 1, 2), (0, 1, 1), (1, 1, 1)])
    assert sorted(map(tuple, mutate.compact(twice).collect())) == [(0, 1, 1.0), (1, 1, 1.0)]
    assert mutate.delete(twice, edges(spark, [(0, 1), (5, 5)])).count() == 1
    log = spark.createDataFrame([(0, 0, "I", 0, 1, 1.0), (1, 0, "I", 1, 2, 1.0), (2, 1, "D", 0, 1, None), (3, 2, "I", 0, 1, 9.0), (4, 2, "D", 7, 7, None)], "seq long, batch_id long, op string, src long, tgt long, weight double")
    assert [mutate.live(log, k).count() for k in range(3)] == [2, 1, 2]
    assert [r["targets"] for r in mutate.csr(twice).orderBy("src").collect()] == [[1], [1]]
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in alg.degrees(twice).collect()} == {0: (0, 2), 1: (3, 1)}


def test_tiles(spark):
    e = edges(spark, [(0, 1), (70, 3), (0, 99)])
    assert tiles.assign(e, 64, 1).count() == 1 and tiles.rejected(e, 64).count() == 2
    n = spark.range(200).select("id", tiles.local_id(F.col("id"), 64).alias("l")).withColumn("g", tiles.global_id(F.floor(F.col("id") / 64), F.col("l"), 64))
    assert n.where("g <> id").count() == 0
    size = spark.createDataFrame([(0, 0, n) for n in (0, 3, 4, 7, 8, 31)], "tile_x long, tile_y long, n_edges long")
    assert [r["compactions"] for r in tiles.compactions(size, 4).collect()] == [0, 0, 1, 1, 2, 3]


def test_tile_ids_of_large_graphs(spark):
    """Ids past 4096 tiles of 64: cells come back, and distant tiles share no id."""
    e = tiles.assign(edges(spark, [(0, 64 * 4096), (64, 0), (64 * 5000, 64 * 9000), (7, 7)]), 64)
    rows = queries.tile_ids(e).collect()
    assert len({r["tile_id"] for r in rows}) == 4 and all((r["back_x"], r["back_y"]) == (r["tile_x"], r["tile_y"]) for r in rows)
    metas = {(r["tile_x"], r["tile_y"]): r["meta"] for r in queries.meta_tiles(tiles.assign(edges(spark, [(64 * 4096, 0), (0, 64), (64, 64)]), 64)).collect()}
    assert metas[4096, 0] != metas[0, 1] == metas[1, 1]
    assert {r["tile_id"] for r in queries.tile_ids(tiles.assign(edges(spark, [(64, 128)]), 64)).collect()} == {4096 + 2}


@pytest.mark.parametrize("n", [1, 2, 4, 16])
def test_hilbert_is_a_bijection(spark, n):
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("x"), (F.col("id") % n).alias("y"))
    back = cells.withColumn("d", curves.hilbert_index(F.col("x"), F.col("y"), n)).withColumn("c", curves.hilbert_cell(F.col("d"), n)).collect()
    assert sorted(r["d"] for r in back) == list(range(n * n)) and all((r["c"]["x"], r["c"]["y"]) == (r["x"], r["y"]) for r in back)
    by = {r["d"]: (r["x"], r["y"]) for r in back}
    assert all(abs(by[d][0] - by[d + 1][0]) + abs(by[d][1] - by[d + 1][1]) == 1 for d in range(n * n - 1))


def test_dense_domain(spark):
    assert graphs.dense_domain(edges(spark, [(0, 4)])).count() == 8
    assert graphs.dense_domain(edges(spark, [])).count() == 0


def test_numbering_and_id_rewrite(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert with_sequence(df, "v").where("seq <> v").count() == 0
    e = spark.createDataFrame([(0, 50, 7), (1, 7, 50), (2, 9, 50)], "seq long, src long, tgt long")
    assert sorted(map(tuple, rewrite(e).collect())) == [(0, 0, 1), (1, 1, 0), (2, 2, 0)]


def test_sources(spark, tmp_path):
    e = edges(spark, DIAMOND)
    raw = tmp_path / "bin"
    raw.mkdir()
    np.array([[0, 1], [5, 6], [-1, 2**31 - 1], [3, 3], [4, 4]], "<i4").tofile(raw / "a")
    (raw / "b").write_bytes(np.array([[7, 8]], "<i4").tobytes() + b"xxx")
    (raw / "c").write_bytes(b"")
    (raw / "_ignored").write_bytes(b"12345678")
    for at in (str(raw), f"file://{raw}"):
        read = edge_io.read_binary(spark, at, split=2)
        assert sorted(map(tuple, read.collect())) == [(-1, 2**31 - 1), (0, 1), (3, 3), (4, 4), (5, 6), (7, 8)] and read.rdd.getNumPartitions() == 4
    edge_io.write_binary(e.repartition(3), str(tmp_path / "w"))
    assert sorted(map(tuple, edge_io.read_binary(spark, str(tmp_path / "w")).collect())) == sorted(r[:2] for r in DIAMOND)
    assert sum(f.stat().st_size for f in (tmp_path / "w").glob("part-*")) == 8 * 4 and not (tmp_path / "w" / "_temporary").exists()
    with pytest.raises(Exception, match="32 bits"):
        edge_io.write_binary(edges(spark, [(3_000_000_000, 1)]), str(tmp_path / "x"))
    lines = spark.createDataFrame([("# x",), ("1 2",), ("3\t4",), ("5",), ("",)], "value string")
    assert sorted(map(tuple, edge_io.parse_text(lines).collect())) == [(1, 2), (3, 4)]
    lists = spark.createDataFrame([("3 2 5 9",), ("4 0",), ("7",)], "value string")
    assert sorted(map(tuple, edge_io.parse_adjacency(lists).collect())) == [(3, 5), (3, 9)]


def test_rmat(spark):
    rows = edge_io.rmat(spark, 6, 500).orderBy("seq").collect()
    assert all((r["src"], r["tgt"]) == edge_io.rmat_recursive(r["seq"], 6) for r in rows[:60])
    many = edge_io.rmat(spark, 8, 20_000)
    assert abs(many.where("src < 128 and tgt < 128").count() / 20_000 - 0.57) < 0.02 and many.where("src > 255 or tgt > 255").count() == 0
    assert edge_io.rmat(spark, 6, 500).exceptAll(edge_io.rmat(spark, 6, 500).repartition(3)).count() == 0


def test_streaming_ends_like_batch(spark, tmp_path):
    rows = [(i, i // 5, "D" if i % 4 == 3 else "I", i % 6, (i * 5) % 7, 1.0) for i in range(40)]
    log = spark.createDataFrame(rows, runner.CHANGES)
    log.repartitionByRange(4, "seq").write.parquet(str(tmp_path / "in"))
    seen = []
    runner.ingest(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp"), lambda live, n: seen.append((n, live.count())))
    after = mutate.live(spark.read.parquet(str(tmp_path / "log")), 1 << 62)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, mutate.live(log, 1 << 62).collect()))
    assert [n for n, _ in seen] == [0, 1, 2, 3]
    upto = [mutate.live(spark.read.parquet(str(tmp_path / "log")).where(F.col("micro_batch") <= n), 1 << 62).count() for n in range(4)]
    assert [c for _, c in seen] == upto
    assert sum(r["inserts"] + r["deletes"] for r in runner.counts_by_batch(spark.read.parquet(str(tmp_path / "log"))).collect()) == 40


def test_results(spark):
    a = spark.createDataFrame([(i, 10.0 - i) for i in range(6)], "id long, value double")
    b = spark.createDataFrame([(i, float(i != 3) + (10.0 - i) / 100) for i in range(6)], "id long, value double")
    ta, tb = post.top_k(a, "value", 4), post.top_k(b, "value", 4)
    assert [(r["id"], r["rank"]) for r in ta.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert post.footrule(ta, tb).first().asDict() == {"n_common": 3, "footrule": 0}
    same = post.kendall(post.paired(ta, ta), "id_a", "id_b").first()
    assert (same["concordant"], same["discordant"], same["quality_q"]) == (6, 0, 1_000_000)
    assert same["p_q"] == pytest.approx(1e6 * math.erfc(18 / math.sqrt(4 * 3 * 13 / 2) / math.sqrt(2)), abs=2)
    labels = spark.createDataFrame([(5, 100), (3, 100), (9, 7)], "id long, label long")
    assert values(post.canonical(labels)) == {5: 3, 3: 3, 9: 7}

def test_ranks_are_cut_as_decimals(spark):
    """Whole millionths, of which those that end with the fourth decimal are cut to themselves."""
    x = spark.range(0, 4_000_000, 100)
    same = scalars.equal_to(F.col("id") / 1e6, (F.col("id") + 99) / 1e6) & scalars.equal_to(-F.col("id") / 1e6, -(F.col("id") + 1) / 1e6)
    assert x.where(~same | scalars.equal_to(F.col("id") / 1e6, (F.col("id") + 100) / 1e6)).count() == 0
    ranks = x.select("id", (F.col("id") / 1e6).alias("rank"))
    assert tuple(post.compare_ranks(ranks, x.select("id", ((F.col("id") + 99) / 1e6).alias("rank"))).first()) == (40_000, 0)



def test_helpers(spark):
    f = spark.createDataFrame([(1.00004, 1.00009), (1.0, 1.1)], "a double, b double")
    assert [tuple(r) for r in f.select(scalars.close(F.col("a"), F.col("b")), scalars.equal_to(F.col("a"), F.col("b"))).collect()] == [(True, True), (False, False)]
    h = scalars.mix64(np.arange(100_000))
    assert len(np.unique(h)) == 100_000 and abs(scalars.unit_interval(h).mean() - 0.5) < 0.01
    assert len(np.unique(scalars.mix32(np.arange(100_000)))) == 100_000
    row = spark.createDataFrame([([3, 1, 2], ["c", "a", "b"])], "k array<int>, v array<string>").select(scalars.sorted_with(F.col("k"), F.col("v")).alias("s")).first()["s"]
    assert [x["o0"] for x in row] == ["a", "b", "c"]
    x = spark.range(1, 70).select("id", scalars.next_power(F.col("id")).alias("n"), scalars.previous_power(F.col("id")).alias("p")).collect()
    assert all(r["n"] == 2 ** math.ceil(math.log2(r["id"])) and r["p"] == 2 ** int(math.log2(r["id"])) for r in x)


def test_jobs(spark):
    assert jobs.values_of("4..32") == [4, 8, 16, 32] and jobs.values_of("1,5") == [1, 5]
    product = jobs.expand(jobs.EngineConfig(), delta=[0.0, 0.1], shards=[1, 2, 3])
    assert len(product) == 6 and product[-1].shards == 3
    with pytest.raises(ValueError):
        jobs.expand(jobs.EngineConfig(), nothing=[1])
    r = jobs.Registry()
    r.add("n", lambda e: e.groupBy().count())
    assert r.names() == ["n"] and r.run_all(edges(spark, PATH))["n"].first()[0] == 4
    r.delete("n")
    r.clear()
    assert r.names() == []


def test_scheduler(spark):
    made = lambda name, cpu, of="a": jobs.Job(name, of, lambda e: e.groupBy("src").count(), cpu)
    groups = jobs.admitted([made("w", 10), made("x", 60), made("y", 50), made("z", 130), made("u", 30, "b")])
    assert [[j.name for j in g] for g in groups] == [["z"], ["x", "w"], ["y"], ["u"]]
    model = jobs.CpuModel.fitted([10.0, 50.0, 100.0], [20.0, 60.0, 110.0])
    assert model.predicted([made("a", 30), made("b", 40)]) == pytest.approx(80) and jobs.CpuModel.fitted([5.0], [9.0]) == jobs.CpuModel()
    e = edges(spark, DIAMOND)
    found = jobs.run_groups(spark, groups, {"a": e, "b": e})
    assert sorted(found) == ["u", "w", "x", "y", "z"] and all(values(f) == {0: 2, 1: 1, 2: 1} for f in found.values())
    known = jobs.profiled(spark, made("p", 0), e)
    assert known.seconds > 0 and known.cpu >= 0
    with pytest.raises(ZeroDivisionError):
        jobs.run_groups(spark, [[jobs.Job("bad", "a", lambda e: 1 / 0)]], {"a": e})


def test_runs_by_options(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    n = graphs.dense(spark, sf).count()
    base = jobs.EngineConfig(algorithm="bfs", batch_edges=-(-n // 3), deletion_percent=3, write_log=True, write_results=True, vertices_per_tile=64)
    carried = jobs.execute(spark, sf, base, str(tmp_path / "a")).collect()
    assert {r["batch_id"] for r in carried} == {0, 1, 2}
    assert edge_io.read_log(spark, str(tmp_path / "a" / "log")).count() == n and spark.read.parquet(str(tmp_path / "a" / "results")).count() == len(carried)
    scratch = jobs.execute(spark, sf, jobs.replace(base, incremental=False, write_log=False, write_results=False)).collect()
    assert sorted(map(tuple, carried)) == sorted(map(tuple, scratch))
    late = jobs.execute(spark, sf, jobs.replace(base, start_edges=n // 2, write_log=False, write_results=False)).collect()
    assert sorted(map(tuple, late)) == sorted(tuple(r) for r in carried if r["batch_id"])
    ranks = jobs.execute(spark, sf, jobs.EngineConfig(algorithm="pagerank_delta", batch_edges=n, incremental=False, delta=0.0)).collect()
    assert {r["id"]: r["value"] for r in ranks} == pytest.approx(values(alg.pagerank(graphs.dense(spark, sf))))


def test_one_run_over_the_log_equals_runs_by_batch(spark):
    rng = np.random.default_rng(5)
    log = [(int(s), int(t), float(w), int(b), bool(stays)) for s, t, w, b, stays in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(1, 9, 90), rng.integers(0, 12, 90), rng.random(90) < 0.7)]
    df = spark.createDataFrame(log, "src long, tgt long, weight double, since long, stays boolean")
    send = {"bfs": lambda v, w: v + 1, "sssp": lambda v, w: v + w, "sswp": min, "cc": lambda v, w: v}
    for name, (program, value) in jobs.PROGRAMS.items():
        best, want = max if name == "sswp" else min, set()
        for k in range(12):
            live = [(s, t, w) for s, t, w, since, stays in log if since == k or (stays and since < k)]
            now = {v: v for e in live for v in e[:2]} if value is None else {3: value}
            for _ in range(40):
                for s, t, w in live:
                    if s in now:
                        now[t] = best(now.get(t, send[name](now[s], w)), send[name](now[s], w))
            want |= {(k, v, x) for v, x in now.items()}
        begin = None if value is None else start(spark, 3).withColumn("value", F.lit(value))
        got = [tuple(r) for r in incremental.evolve_log(df, 12, program, begin).collect()]
        assert set(got) == want and len(got) == len(want)


def test_jobs_do_not_grow_with_the_batches(spark, tmp_path):
    sf, count = "/root/testdata/sf0.001", []
    n = graphs.dense(spark, sf).count()
    for batches in (3, 30):
        config = jobs.EngineConfig(algorithm="cc", batch_edges=-(-n // batches), deletion_percent=3, write_log=True, write_results=True, vertices_per_tile=64)
        spark.sparkContext.setJobGroup(f"batches-{batches}", "")
        try:
            out = jobs.execute(spark, sf, config, str(tmp_path / str(batches))).count()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert spark.read.parquet(str(tmp_path / str(batches) / "results")).count() == out
        count.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batches-{batches}")))
    assert 0 < count[1] < 3 * count[0]


def test_results_of_batches_become_rows_only_where_they_are_written(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    n = graphs.dense(spark, sf).count()
    config = jobs.EngineConfig(algorithm="cc", batch_edges=-(-n // 300), deletion_percent=3, write_results=True)
    spark.sparkContext.setJobGroup("batches-300", "")
    try:
        out = jobs.execute(spark, sf, config, str(tmp_path))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    found, tracker, store = spark.read.parquet(str(tmp_path / "results")).select(*out.columns), spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    rows = out.count()
    assert found.count() == rows and found.exceptAll(out).isEmpty()
    stages = {s for j in tracker.getJobIdsForGroup("batches-300") for s in tracker.getJobInfo(j).stageIds}
    # supersteps pass on messages, the snapshots' writer spans; neither has a row for each batch
    assert 0 < max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < rows / 2


def test_labels_begin_once(spark):
    log = [(1, 2, k, True) for k in range(3, 9)] + [(1, 3, 1, False), (1, 3, 1, False), (2, 1, 5, False)]
    got = incremental.labelled(spark.createDataFrame(log, "src long, tgt long, since long, stays boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, False, 1), (1, 3, True, 1), (2, 3, True, 2), (3, 1, False, 3)]


def test_snapshots_in_parts_and_of_some_batches(spark, tmp_path):
    spans = [(i, i % 4, 10, float(i % 3)) for i in range(0, 40_000, 8)] + [(3, 2, 2, 7.0), (3, 5, 6, 8.0)]
    edge_io.write_snapshots(spark.createDataFrame(spans, "id long, first long, last long, value double"), str(tmp_path / "r"), [0, 2, 5, 10], rows=1000, together=3)
    got = spark.read.parquet(str(tmp_path / "r")).select("batch_id", "id", "value").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, v) for i, a, b, v in spans for k in range(a, b + 1) if k in (0, 2, 5, 10))


def test_cut_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    before = files()
    kept = cut(spark.range(10_000).repartition(3, "id"))
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:  # they go soon after
        time.sleep(0.2)
    assert not left and kept.count() == 10_000
