"""The experiment: every estimator with every parameter, for all queries, in one plan a setting."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import SETTINGS, Scoring
from ..functions.text import method_name
from ..operators import estimators as E
from ..operators import retrieve as R
from ..operators.evaluate import packed_statistics
from ..sources.tables import shared_folder


@dataclass(frozen=True)
class Grid:
    """What estimators are run with."""

    levels: tuple[int, ...] = (5, 10, 20, 40)
    tops: tuple[int, ...] = (25, 50, 100, 200)
    samples: tuple[int, ...] = (25, 50, 100, 200)


@dataclass(frozen=True)
class Task:
    """A collection, the setting that it is summed under, and the parameters."""

    items: DataFrame
    queries: DataFrame
    scoring: Scoring
    params: tuple[float, ...]


def estimates(task: Task, grid: Grid = Grid(), cuts: DataFrame | None = None) -> DataFrame:
    """method, qid, param, estimate for all estimators. cuts: what R.cuts retrieved for the scoring function's metric."""
    items, queries, s, params = task.items, task.queries, task.scoring, list(task.params)
    if cuts is None:
        cuts = retrieved(items, queries, s.metric, grid)
    rows = cuts.withColumn("sim", s.sim(F.col("raw")))
    top, u, some = (rows.where(F.col(place).isNotNull()).select("qid", "id", "sim", *more, place) for place, more in (("rk", ["level"]), ("rl", ["level"]), ("rr", [])))
    n, maxes = R.population(items, queries), E.max_sim(top)
    cut = ["method", "qid", "param", "estimate"]
    named = lambda df, name, *by: df.withColumn("method", method_name(F.lit(name), *map(F.col, by))).select(cut)
    return (
        named(E.level_estimate(u, n, s, params, list(grid.levels)), "our", "k")
        .unionByName(named(E.topk_estimate(top, s, params, list(grid.tops)), "topk", "k"))
        .unionByName(named(E.random_estimate(some, maxes, n, s, params, list(grid.samples)), "random", "r"))
        .unionByName(named(E.combined_estimate(top, some, n, s, params, list(grid.tops), list(grid.samples)), "combined", "k", "r"))
    )


def retrieved(items: DataFrame, queries: DataFrame, metric: str, grid: Grid) -> DataFrame:
    """R.cuts, kept: a few hundred rows a query."""
    shared_folder(items.sparkSession)
    return R.cuts(items, queries, metric, max(grid.tops), max(grid.levels), max(grid.samples)).checkpoint()


def run(items: DataFrame, queries: DataFrame, grid: Grid = Grid(), settings: Mapping[str, tuple[Scoring, tuple[float, ...]]] = SETTINGS) -> DataFrame:
    """setting, method, qid, param, estimate, true_sum, rel_error, for any scoring functions and their grids.

    Every metric is searched once: similarity falls with distance in all settings, so these rank items alike.
    """
    from ..operators.evaluate import relative_error

    cuts: dict[str, DataFrame] = {}
    out = None
    for name, (s, params) in settings.items():
        if s.metric not in cuts:
            cuts[s.metric] = retrieved(items, queries, s.metric, grid)
        rows = estimates(Task(items, queries, s, tuple(params)), grid, cuts[s.metric])
        rows = rows.join(E.true_sum(items, queries, s, list(params)), ["qid", "param"], "left").withColumn("setting", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("setting", "method", "qid", "param", "estimate", "true_sum", relative_error(F.col("estimate"), F.col("true_sum")).alias("rel_error"))


def error_statistics(items: DataFrame, queries: DataFrame, grid: Grid = Grid(), settings: Mapping[str, tuple[Scoring, tuple[float, ...]]] = SETTINGS, cuts: Mapping[str, DataFrame] | None = None, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """setting, method, param, median_error, n, low, high: of all queries' errors, as run's rows have them.

    Scoring functions need forms for arrays. A metric's items are scored once for the sums of all its settings; estimates are
    worked out query by query in numpy, and errors are sent in rows of many. cuts: what is retrieved already, by metric.
    """
    if missing := [name for name, (s, _) in settings.items() if s.array_sim is None or s.array_term is None]:
        raise ValueError(f"no forms for arrays: {', '.join(missing)}")
    n = F.broadcast(items.where("embedding is not null").agg((F.count("*") - 1).alias("n")))
    out = None
    for metric in dict.fromkeys(s.metric for s, _ in settings.values()):
        named = [(name, s, np.array(params, float)) for name, (s, params) in settings.items() if s.metric == metric]
        cut = cuts[metric] if cuts else retrieved(items, queries, metric, grid)
        rows = cut.unionByName(E.all_sums(items, queries, [(s, p) for _, s, p in named]), allowMissingColumns=True)
        rows = rows.repartition("qid").crossJoin(n).sortWithinPartitions("qid")
        errors = rows.mapInArrow(E.query_errors(named, list(grid.levels), list(grid.tops), list(grid.samples)), "setting string, method string, param double, errors binary")
        out = errors if out is None else out.unionByName(errors)
    return packed_statistics(out, low, high)


def wide(results: DataFrame, value: str = "estimate") -> DataFrame:
    """A row for each setting, method and query, a column for each parameter."""
    return results.groupBy("setting", "method", "qid").pivot("param").agg(F.first(value))


def _by_raw(metric: str) -> Scoring:
    """Ranks items as every scoring function of the metric does; raw scores can be told from its similarities."""
    return Scoring(metric, metric, (lambda d: d) if metric == "dot" else (lambda d: -d), lambda s, m, p: s)


def timed(spark: SparkSession, items: DataFrame, queries: DataFrame, grid: Grid = Grid(), settings: Mapping[str, tuple[Scoring, tuple[float, ...]]] = SETTINGS) -> DataFrame:
    """setting, method, seconds: each estimator's largest case with one parameter, retrieval and sum."""
    return timed_and_cuts(spark, items, queries, grid, settings)[0]


def timed_and_cuts(spark: SparkSession, items: DataFrame, queries: DataFrame, grid: Grid = Grid(), settings: Mapping[str, tuple[Scoring, tuple[float, ...]]] = SETTINGS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """timed's rows, and what was retrieved for them, by metric, as R.cuts gives it.

    What settings of one metric retrieve alike is retrieved and timed once, and its seconds count for each estimator that
    needs it.
    """
    shared_folder(spark)
    rows = []
    k, level, m = max(grid.tops), max(grid.levels), max(grid.samples)
    n = R.population(items, queries)

    def kept(df: DataFrame) -> tuple[DataFrame, float]:
        began = time.perf_counter()
        return df.checkpoint(), time.perf_counter() - began

    drawn, draw = kept(R.drawn(items, queries, m))
    held: dict[str, dict[str, tuple[DataFrame, float]]] = {}
    for name, (s, params) in settings.items():
        one, rank = [params[len(params) // 2]], _by_raw(s.metric)
        if s.metric not in held:
            some, more = kept(R.with_raw(drawn, items, queries, s.metric).select("qid", "id", rank.sim(F.col("raw")).alias("sim"), "rr"))
            held[s.metric] = {"some": (some, draw + more), "first": kept(R.top(items, queries, rank, 1)), "top": kept(R.top(items, queries, rank, k)), "levels": kept(R.top_by_level(items, queries, rank, level))}
        # The similarity of the same raw score, in this setting.
        found = {what: df.withColumn("sim", s.sim(rank.sim(F.col("sim")))) for what, (df, _) in held[s.metric].items()}
        jobs = {
            f"our_{level}": (["levels"], E.level_estimate(found["levels"], n, s, one, [level])), f"topk_{k}": (["top"], E.topk_estimate(found["top"], s, one, [k])),
            f"random_{m}": (["some", "first"], E.random_estimate(found["some"], E.max_sim(found["first"]), n, s, one, [m])),
            f"combined_{k}_{m}": (["top", "some"], E.combined_estimate(found["top"], found["some"], n, s, one, [k], [m])),
        }
        for method, (pieces, job) in jobs.items():
            began = time.perf_counter()
            job.write.format("noop").mode("overwrite").save()
            rows.append((name, method, time.perf_counter() - began + sum(held[s.metric][what][1] for what in pieces)))
    cuts = {}
    for metric, pieces in held.items():
        raw = F.col("sim") if metric == "dot" else -F.col("sim")
        top, levels, some = (pieces[what][0].withColumn("raw", raw).drop("sim") for what in ("top", "levels", "some"))
        cuts[metric] = top.unionByName(levels, allowMissingColumns=True).unionByName(some, allowMissingColumns=True).select("qid", "id", "raw", "level", "rk", "rl", "rr")
    return spark.createDataFrame(rows, "setting string, method string, seconds double"), cuts
