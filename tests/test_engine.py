"""Queries against their SQL, and the identities that estimators must keep."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sumlight import session
from sumlight.functions import hashes
from sumlight.functions.scoring import BALL, KDE, SOFTMAX, Scoring
from sumlight.operators import estimators as E
from sumlight.operators import evaluate as X
from sumlight.operators import retrieve as R
from sumlight.plans import experiment
from sumlight.plans import queries as Q
from sumlight.sources import images, synthetic, tables
from sumlight.streaming.ingest import ingest, ingested

SF = "/root/testdata/sf0.001"
SOME = ["l2_normalise", "text_stream_ids", "shard_manifest", "clean_asset_id", "rarity_levels_all", "max_levels", "level_rotation", "true_sum_kde", "est_combined_ball", "random_sample", "ann_int8_rescore", "recall_curve", "experiment_sum_estimates", "est_level_softmax", "topk_by_level", "recall_at_k", "worst_param_tradeoff", "synthetic_p95", "stream_ingest"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark", "labels", "pages", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_sql_agrees(spark, con, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    by = sorted(got.columns)
    want = con.sql(Q.SQL[name]).df()
    assert sorted(want.columns) == by
    assert got[by].sort_values(by).reset_index(drop=True).equals(want[by].sort_values(by).reset_index(drop=True))


@pytest.fixture(scope="module")
def items(spark):
    return tables.table(spark, SF, "embeddings")


@pytest.mark.parametrize("s", [KDE, SOFTMAX, BALL], ids=lambda s: s.name)
def test_identities(items, s):
    queries, n = R.query_set(items), items.count() - 1
    truth = {(r.qid, r.param): r.true_sum for r in E.true_sum(items, queries, s, list(s.params)).collect()}
    assert truth == pytest.approx({(r.qid, r.param): r.true_sum for r in E.true_sum_generic(items, queries, s, list(s.params)).collect()})
    u, many = R.top_by_level(items, queries, s, n + 1), R.population(items, queries)
    top = R.top(items, queries, s, n)
    for rows in (E.level_estimate(u, many, s, s.params, [n + 1]), E.topk_estimate(top, s, s.params, [n]), E.random_estimate(R.sample(items, queries, s, n), E.max_sim(top), many, s, s.params, [n])):
        assert {(r.qid, r.param): r.estimate for r in rows.collect()} == pytest.approx(truth)


def test_blocks_agree_with_one_block(items, monkeypatch):
    queries = R.query_set(items)
    one = {(r.qid, r.rk): r.id for r in R.top(items, queries, SOFTMAX, 10).collect()}
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 64 * 7)
    assert one == {(r.qid, r.rk): r.id for r in R.top(items, queries, SOFTMAX, 10).collect()}


def test_ingest_resumes(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = synthetic.vectors(spark, 20, 4, seed=3).select("asset_id")
    read = lambda: sorted(r.asset_id for r in ingested(spark, out).collect())
    spark.range(12).join(rows.withColumn("id", F.substring("asset_id", 11, 9).cast("long")), "id").select("asset_id").coalesce(2).write.parquet(source)
    for _ in range(2):
        ingest(spark, source, "asset_id string", out, lambda batch: batch)
        assert len(read()) == 12
    spark.createDataFrame([(f"synthetic-{i}",) for i in range(12, 20)], "asset_id string").coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, "asset_id string", out, lambda batch: batch)
    assert len(set(read())) == 20
    with pytest.raises(ValueError, match="written with"):
        ingest(spark, source, "asset_id string", out, lambda batch: batch, geometry={"dim": 9})


def test_vectors_can_be_made_again(spark):
    whole = {r.asset_id: r.embedding for r in synthetic.vectors(spark, 10, 3).collect()}
    assert {r.asset_id: r.embedding for r in synthetic.vectors(spark, 10, 3, begin=6).collect()} == {k: v for k, v in whole.items() if int(k[10:]) >= 6}


def test_a_new_scoring_function_is_summed_as_it_is(items):
    """Without forms for arrays, and through the whole experiment."""
    half = Scoring("half", "dot", lambda d: d * 0.5, lambda s, m, p: F.exp((s - m) / p))
    queries, params = R.query_set(items), [0.1, 0.5]
    truth = {(r.qid, r.param): r.true_sum for r in E.true_sum(items, queries, half, params).collect()}
    assert truth == pytest.approx({(r.qid, r.param): r.true_sum for r in E.true_sum_generic(items, queries, half, params).collect()})
    soft = {(r.qid, r.param): r.true_sum for r in E.true_sum(items, queries, SOFTMAX, [0.2, 1.0]).collect()}
    assert truth == pytest.approx({(q, p / 2): v for (q, p), v in soft.items()})
    grid = experiment.Grid((5,), (25,), (25,))
    rows = experiment.run(items, queries, grid, {"mine": (half, tuple(params))}).collect()
    assert {r.method for r in rows} == {"our_5", "topk_25", "random_25", "combined_25_25"} and all(r.true_sum == pytest.approx(truth[r.qid, r.param]) for r in rows)


def test_cuts_are_the_single_searches(items):
    queries = R.query_set(items)
    rows = R.cuts(items, queries, "euclid", 30, 5, 20).collect()
    for place, want in (("rk", R.top(items, queries, KDE, 30)), ("rl", R.top_by_level(items, queries, KDE, 5)), ("rr", R.sample(items, queries, KDE, 20))):
        assert {(r.qid, r.id, r[place]): -r.raw**2 for r in rows if r[place]} == pytest.approx({(r.qid, r.id, r[place]): r.sim for r in want.collect()})


def test_distances_of_near_and_equal_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0 + 1e-7]), (3, [1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: -r.sim for r in R.scored(df, df.where("vec_id = 0"), BALL).collect()}
    assert got == pytest.approx({1: 0.0, 2: 1e-7, 3: (999999.0**2 + 4) ** 0.5}, rel=1e-6)


@pytest.mark.parametrize("name", ["ann_lsh_recall", "ann_fitted_recall"])
def test_approximate_searches_find_nine_in_ten(spark, name):
    assert Q.QUERIES[name](spark, SF).first()["mean"] >= 0.9


def test_projections_rank_the_candidates_of_each_block(spark, monkeypatch):
    """Pairs of vectors that share a bucket are not sent anywhere; each block sends a query's best."""
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 4 * 25)  # blocks of 25
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 4)), 5, axis=0) + 0.05 * rng.normal(size=(150, 4))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    near = R.approximate_lsh(df, R.query_set(df), 6, tables=3, width=0.8)
    assert "hashValue" not in near._jdf.queryExecution().executedPlan().toString()
    codes = R.lsh_codes(x, 0.8, 3)
    for q in (0, 50, 100):
        meets = [i for i in range(150) if i != q and (codes[i] == codes[q]).any()]
        want = sorted(meets, key=lambda i: (round(float(np.linalg.norm(x[i] - x[q])), 12), -i))[:6]
        assert [r.id for r in near.where(f"qid = {q}").orderBy("rk").collect()] == want and len(meets) < 149


def test_the_recall_of_projections_sends_no_pairs(spark):
    assert "hashValue" not in Q.QUERIES["ann_lsh_recall"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("times", "more"), [(2, 40), (1, 0), (0, 1)])
def test_samples_rank_few_pairs_and_miss_none(spark, monkeypatch, times, more):
    """Whatever the bound is, also where queries have too few pairs below it."""
    monkeypatch.setattr(R, "DRAW_TIMES", times, raising=False)
    monkeypatch.setattr(R, "DRAW_MORE", more, raising=False)
    items = spark.createDataFrame([(i, [1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = R.drawn(items, R.query_set(items), 20)
    assert "bound" in got._jdf.queryExecution().optimizedPlan().toString()
    tag = lambda q, i: hashlib.md5(f"R0:{q}:{i}".encode()).hexdigest()
    want = {(q, i, k + 1) for q in range(0, 400, 50) for k, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: tag(q, i))[:20])}
    rows = got.collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(want)


def test_timing_searches_a_metric_once(spark, monkeypatch):
    """Settings of one metric share what is retrieved; every setting and method has its seconds."""
    asked = []
    raw_pairs, drawn = R.raw_pairs, R.drawn
    monkeypatch.setattr(R, "raw_pairs", lambda items, queries, metric, *a, **b: asked.append(metric) or raw_pairs(items, queries, metric, *a, **b))
    monkeypatch.setattr(R, "drawn", lambda *a, **b: asked.append("drawn") or drawn(*a, **b))
    items = spark.read.parquet(f"{SF}/embeddings.parquet")
    grid, settings = experiment.Grid((5,), (10,), (10,)), {"a": (KDE, (0.5,)), "b": (BALL, (1.2,)), "c": (BALL, (1.3,))}
    rows = experiment.timed(spark, items, R.query_set(items), grid, settings).collect()
    assert sorted(asked) == ["drawn", "euclid", "euclid", "euclid"]
    assert {(r.setting, r.method) for r in rows} == {(s, m) for s in settings for m in ("our_5", "topk_10", "random_10", "combined_10_10")} and all(r.seconds > 0 for r in rows)


def test_the_tradeoff_searches_no_more_than_its_timing(spark, monkeypatch):
    """What was retrieved for the seconds serves the errors too, and a metric's items are scored once more for all sums."""
    asked = []
    raw_pairs, drawn, sums = R.raw_pairs, R.drawn, E.true_sum
    monkeypatch.setattr(R, "raw_pairs", lambda items, queries, metric, *a, **b: asked.append(metric) or raw_pairs(items, queries, metric, *a, **b))
    monkeypatch.setattr(R, "drawn", lambda *a, **b: asked.append("drawn") or drawn(*a, **b))
    monkeypatch.setattr(E, "true_sum", lambda *a, **b: asked.append("sum") or sums(*a, **b))
    rows = Q.QUERIES["time_error_tradeoff"](spark, SF).collect()
    assert sorted(asked) == ["dot"] * 3 + ["drawn"] + ["euclid"] * 3
    want = {(r.setting, r.method): r for r in Q.QUERIES["worst_param_tradeoff"](spark, SF).where("method in ('our_40', 'topk_200', 'random_200', 'combined_200_200')").collect()}
    assert {(r.setting, r.method) for r in rows} == set(want) and all([r[c] for c in ("param", "worst_error", "low", "high")] == [want[r.setting, r.method][c] for c in ("param", "worst_error", "low", "high")] for r in rows)


@pytest.mark.parametrize("at_once", [2, 256])
def test_error_statistics_are_those_of_the_single_rows(items, monkeypatch, at_once):
    """Of blocks of 60 items; parameters so small that no item is in the ball, so that errors are null."""
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 64 * 60)
    monkeypatch.setattr(E, "ERRORS_AT_ONCE", at_once)
    grid = experiment.Grid((3, 40), (5, 200), (4, 300))
    settings = {"k": (KDE, (0.1, 0.5, 2.0)), "b": (BALL, (0.01, 1.2, 1.3, 9.0)), "s": (SOFTMAX, (0.001, 0.1)), "again": (KDE, (0.3,))}
    queries = R.query_set(items)
    got = {(r.setting, r.method, r.param): r for r in experiment.error_statistics(items, queries, grid, settings).collect()}
    rows = experiment.run(items, queries, grid, settings).checkpoint()
    by = ["setting", "method", "param"]
    want = X.median_errors(rows, *by).join(X.order_statistics(rows, "rel_error", by, 0.4, 0.6).select(*by, "low", "high"), by, "left").collect()
    assert len(got) == len(want) == (2 + 2 + 2 + 4) * 10
    for r in want:
        have = got[r.setting, r.method, r.param]
        for c in ("n", "median_error", "low", "high"):
            assert have[c] is None if r[c] is None else have[c] == pytest.approx(r[c], rel=1e-9, abs=1e-12)


def test_heads_of_many_hashes():
    """Of every length of beginning and ending, also of more than one block."""
    ids = np.array([0, 5, -7, 10, 99, 100, 12345, 123456, 2**63 - 1, -(2**63)])
    ends = hashes.Endings(ids.astype("S"))
    for begin in ("", "R", "R0:5:", "R0:50:", "R0:500:", "R12:123456789:", "x" * 50):
        assert ends.heads(begin.encode()).tolist() == [int(hashlib.md5(f"{begin}{i}".encode()).hexdigest()[:8], 16) for i in ids.tolist()]


@pytest.mark.parametrize(("metric", "keep"), [("euclid", (5, 0)), ("dot", (0, 2)), ("euclid", (3, 2)), ("dot", (500, 500))])
def test_kept_pairs_are_the_best_with_ties(spark, monkeypatch, metric, keep):
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 3 * 1000)
    x = np.random.default_rng(2).integers(0, 2, (200, 3)).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").coalesce(1)
    all_rows = R.raw_pairs(df, R.query_set(df), metric).collect()
    got = {(r.qid, r.id) for r in R.raw_pairs(df, R.query_set(df), metric, keep).collect()}
    want = set()
    for q in range(0, 200, 50):
        rows = sorted((r for r in all_rows if r.qid == q), key=lambda r: (-r.raw if metric == "dot" else r.raw, -r.id))
        want |= {(q, r.id) for r in rows[: keep[0]]}
        for level in {r.level for r in rows}:
            want |= {(q, r.id) for r in [r for r in rows if r.level == level][: keep[1]]}
    assert got == want


def test_queries_of_many_files_lie_in_few_partitions(spark, tmp_path):
    """Each of these reads and packs all items again."""
    spark.range(1200).selectExpr("id as vec_id", "array(double(id), 1d) as embedding").repartition(24).write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/many")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        items = spark.read.parquet(f"{tmp_path}/many")
        assert items.rdd.getNumPartitions() > 20
        asked = R.asked_blocks(R.query_set(items))
        assert asked.rdd.getNumPartitions() == 2 and sum(len(r.q_ids) for r in asked.collect()) == 24 * 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def png(pixels, kinds, colour):
    height, width, depth = pixels.shape
    before, lines = np.zeros((height + 1, width + 1, depth), int), b""
    before[1:, 1:] = pixels
    for y, kind in enumerate(kinds):
        left, up, corner = before[y + 1, :-1], before[y, 1:], before[y, :-1]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        lines += bytes([kind]) + ((pixels[y].astype(int) - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_are_decoded_counted_and_numbered(spark, tmp_path):
    rng = np.random.default_rng(3)
    colour, grey, alpha = (rng.integers(0, 256, (5, 4, n)).astype(np.uint8) for n in (3, 1, 4))
    ppm = b"P6 4 5\n255\n" + colour.tobytes()
    (tmp_path / "a.ppm").write_bytes(ppm)
    rows = [(0, ppm), (1, png(colour, range(5), 2)), (2, b"no image"), (3, png(grey, [4, 3, 2, 1, 0], 0)), (4, None), (5, png(alpha, [0, 1, 4, 4, 3], 6)), (6, png(colour, range(5), 2)[:50])]
    seen = Observation()
    got = images.image_items(spark.createDataFrame(rows, "n long, image binary"), "image", order="n", seen=seen).collect()
    want = {"0": colour, "1": colour, "3": np.repeat(grey, 3, axis=2), "5": alpha[:, :, :3]}
    assert {r.asset_id: (r.width, r.height, bytes(r.pixels)) for r in got} == {k: (4, 5, v.tobytes()) for k, v in want.items()}
    assert seen.get == {"written": 4, "skipped": 3}
    held = spark.createDataFrame([("x", (ppm,))], "id string, image struct<bytes: binary>")
    assert [r.asset_id for r in images.image_items(held, "image", "id").collect()] == ["x"]
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.ppm",), (f"file://{tmp_path}/none.ppm",), ("not a url",)], "url string")
    assert [(r.asset_id[-5:], r.width) for r in images.image_items(urls, "url").collect()] == [("a.ppm", 4)]
    assert [r.asset_id[-5:] for r in images.image_files(spark, f"{tmp_path}/a.ppm").collect()] == ["a.ppm"]


def test_texts_that_are_zero_and_rows_without_ids(spark):
    rows = [(0, "0", 0, "x\ny"), (1, " a ", 7, None), (2, "", 0, "z"), (3, None, 5, " ")]
    seen = Observation()
    df = spark.createDataFrame(rows, "n long, title string, count long, id string")
    got = sorted((r.asset_id, r.text) for r in tables.text_items(df, ["title", "count"], ["id"], order="n", seen=seen).collect())
    assert got == [("1", "a  7"), ("3", "5"), ("x y", "0")] and seen.get == {"written": 3, "skipped": 1}
    assert sorted(r.asset_id for r in tables.text_items(df, ["title", "count"], ["id"]).collect()) == ["(unknown)", "(unknown)", "x y"]


def test_shards_and_single_files(spark, tmp_path):
    rows = synthetic.vectors(spark, 10, 3).coalesce(1)
    tables.write_shards(rows, f"{tmp_path}/s", 4, raw=True, normalised=True)
    back = tables.open_items(spark, f"{tmp_path}/s")
    assert back.count() == 10 and len(list((tmp_path / "s").glob("*.parquet"))) == 3 and "normalised_embedding" in back.columns
    tables.write_single(rows, f"{tmp_path}/one")
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    with pytest.raises(ValueError, match="no rows"):
        tables.write_single(rows.limit(0), f"{tmp_path}/none")
    with pytest.raises(ValueError, match="nothing to write"):
        tables.write_shards(rows, f"{tmp_path}/t", 4, raw=False)
    (tmp_path / "s" / "part-bad.parquet").write_bytes(b"damaged")
    assert tables.combine_results(spark, f"{tmp_path}/s").count() == 10
    (tmp_path / "l.jsonl").write_text('{"title": "t"}\n')
    assert tables.open_items(spark, f"{tmp_path}/l.jsonl", "json").first().title == "t"


def test_a_failed_batch_is_replayed(spark, tmp_path):
    source, out, failed = f"{tmp_path}/in", f"{tmp_path}/out", []
    synthetic.vectors(spark, 9, 2).select("asset_id").repartition(3).write.parquet(source)

    def transform(batch):
        if (tmp_path / "out" / "data" / "batch=0").exists() and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        ingest(spark, source, "asset_id string", out, transform)
    ingest(spark, source, "asset_id string", out, transform)
    assert failed and sorted(r.asset_id for r in ingested(spark, out).collect()) == [f"synthetic-{i}" for i in range(9)]


def test_results_in_wide_form_and_same_methods(spark):
    rows = spark.createDataFrame([("s", m, q, p, p * q) for m in ("a_1", "b_2") for q in (1, 2) for p in (0.5, 2.0)], "setting string, method string, qid long, param double, estimate double")
    assert {(r.method, r.qid): (r["0.5"], r["2.0"]) for r in experiment.wide(rows).collect()} == {(m, q): (0.5 * q, 2.0 * q) for m in ("a_1", "b_2") for q in (1, 2)}
    assert X.same_methods(rows, rows.where("qid = 1")) and not X.same_methods(rows, rows.where("method = 'a_1'"))


def test_settings_of_a_session(spark, monkeypatch):
    monkeypatch.setenv("DATASET_SIZE", "7")
    assert session.Config().dataset_size == 7 and session.session("x").sparkContext is spark.sparkContext


def test_missing_columns_are_named(items):
    with pytest.raises(ValueError, match="vec_id"):
        tables.require(items, "nothing")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
