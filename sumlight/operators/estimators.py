"""Estimators of a sum of terms over all items but the query, for every query and parameter in one plan.

A grid is a list of parameters; it is expanded after retrieval has cut the rows down. mx is each query's greatest
similarity, by which exponents are shifted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import Scoring
from .retrieve import asked_blocks, best_first, packed, raw_scores, scored


def grid(params: list[float] | tuple[float, ...], name: str = "param", kind: str = "double") -> Column:
    return F.explode(F.array(*[F.lit(p).cast(kind) for p in params])).alias(name)


def max_sim(top: DataFrame) -> DataFrame:
    """qid, mx of retrieved rows that hold each query's best."""
    return top.groupBy("qid").agg(F.max("sim").alias("mx"))


def _terms(rows: DataFrame, maxes: DataFrame, scoring: Scoring, params) -> DataFrame:
    wide = rows.join(maxes, "qid").select("*", grid(params))
    return wide.withColumn("f", scoring.term(F.col("sim"), F.col("mx"), F.col("param")))


def _partial_sums(scoring: Scoring, params: list[float]):
    """For a pair of blocks: each query's greatest similarity and, shifted by it, the sum of terms of each parameter."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for ids, qids, raw in raw_scores(row, scoring.metric):
                    out = []
                    for j, qid in enumerate(qids.tolist()):
                        use = ids != qid
                        if use.any():
                            sim = scoring.array_sim(raw[j] if use.all() else raw[j][use])
                            top = float(sim.max())
                            out += [(qid, p, top, v) for p, v in zip(params, scoring.sums(sim, top, np.array(params)).tolist(), strict=True)]
                    columns = list(zip(*out, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True)], ["qid", "param", "top", "value"])

    return run


def true_sum(items: DataFrame, queries: DataFrame, scoring: Scoring, params: list[float]) -> DataFrame:
    """qid, param, true_sum. Blocks give sums shifted by their own best, put on one scale when they meet.

    A scoring function without forms for arrays takes the generic way.
    """
    if scoring.array_sim is None or scoring.array_term is None:
        return true_sum_generic(items, queries, scoring, params)
    pairs = packed(items).crossJoin(asked_blocks(queries)).select("ids", "matrix", "q_ids", "q_matrix")
    parts = pairs.mapInArrow(_partial_sums(scoring, list(params)), "qid long, param double, top double, value double")
    best = F.max("top").over(W.partitionBy("qid", "param"))
    scale = scoring.term(F.col("top"), F.col("best"), F.col("param")) if scoring.by_max else F.lit(1.0)
    return parts.withColumn("best", best).groupBy("qid", "param").agg(F.sum(F.col("value") * scale).alias("true_sum"))


def true_sum_generic(items: DataFrame, queries: DataFrame, scoring: Scoring, params: list[float]) -> DataFrame:
    """The same for any scoring function, from the scores of all pairs."""
    rows = scored(items, queries, scoring)
    terms = _terms(rows, max_sim(rows), scoring, params)
    return terms.groupBy("qid", "param").agg(F.sum("f").alias("true_sum"))


def topk_estimate(top: DataFrame, scoring: Scoring, params, ks: list[int]) -> DataFrame:
    """qid, k, param, estimate: the sum over the k most similar items."""
    terms = _terms(top, max_sim(top), scoring, params).select("*", grid(ks, "k", "int")).where(F.col("rk") <= F.col("k"))
    return terms.groupBy("qid", "k", "param").agg(F.sum("f").alias("estimate"))


def random_estimate(sample: DataFrame, maxes: DataFrame, population: DataFrame, scoring: Scoring, params, rs: list[int]) -> DataFrame:
    """qid, r, param, estimate: a sample's sum, scaled to the population."""
    terms = _terms(sample, maxes, scoring, params).select("*", grid(rs, "r", "int")).where(F.col("rr") <= F.col("r"))
    sums = terms.groupBy("qid", "r", "param").agg(F.avg("f").alias("mean"))
    return sums.join(population, "qid").select("qid", "r", "param", (F.col("n") * F.col("mean")).alias("estimate"))


def sample_minus_top(sample: DataFrame, top: DataFrame) -> DataFrame:
    """A sample's rows with rk, the item's rank among the most similar, null beyond those retrieved."""
    return sample.join(top.select("qid", "id", "rk"), ["qid", "id"], "left")


def combined_estimate(top: DataFrame, sample: DataFrame, population: DataFrame, scoring: Scoring, params, ks: list[int], rs: list[int]) -> DataFrame:
    """qid, k, r, param, estimate: the top k exactly, the rest by the sampled items outside of it; null if there are none."""
    maxes = max_sim(top)
    rest = _terms(sample_minus_top(sample, top), maxes, scoring, params).select("*", grid(ks, "k", "int"), F.lit(0).alias("z")).select("*", grid(rs, "r", "int"))
    rest = rest.where((F.col("rr") <= F.col("r")) & (F.col("rk").isNull() | (F.col("rk") > F.col("k")))).groupBy("qid", "k", "r", "param").agg(F.avg("f").alias("mean"))
    head = topk_estimate(top, scoring, params, ks).select("*", grid(rs, "r", "int"))
    both = head.join(rest, ["qid", "k", "r", "param"], "left").join(population, "qid")
    return both.select("qid", "k", "r", "param", (F.col("estimate") + (F.col("n") - F.least(F.col("k"), F.col("n"))) * F.col("mean")).alias("estimate"))


def level_weights(u: DataFrame, ks: list[int]) -> DataFrame:
    """Rows of each k's U with p, the probability to be in it; nonfull, whether the level has fewer than k; and back.

    p is 1 less the shares of levels that were full before the row, walking by similarity. back marks the less similar
    half of the rows of levels that aren't full, the longer one.
    """
    wide = u.select("*", grid(ks, "k", "int")).where(F.col("rl") <= F.col("k"))
    walk = best_first("qid", "k").rowsBetween(W.unboundedPreceding, -1)
    full = F.when(F.col("rl") == F.col("k"), F.pow(F.lit(2.0), -F.col("level"))).otherwise(0.0)
    rows = wide.withColumn("p", 1 - F.coalesce(F.sum(full).over(walk), F.lit(0.0)))
    rows = rows.withColumn("nonfull", F.count("*").over(W.partitionBy("qid", "k", "level")) < F.col("k"))
    own = W.partitionBy("qid", "k", "nonfull")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("sim").desc(), F.col("id").desc()))).withColumn("size", F.count("*").over(own))
    return rows.withColumn("back", F.col("nonfull") & (F.col("place") > F.floor(F.col("size") / 2))).drop("place", "size")


def level_estimate(u: DataFrame, population: DataFrame, scoring: Scoring, params, ks: list[int]) -> DataFrame:
    """qid, k, param, estimate: inverse-probability weights, and the back half's mean for what they leave; null without."""
    terms = _terms(level_weights(u, ks), max_sim(u), scoring, params)
    sums = terms.groupBy("qid", "k", "param").agg(F.sum(F.col("f") / F.col("p")).alias("hit"), F.sum(1 / F.col("p")).alias("w"), F.avg(F.when(F.col("back"), F.col("f"))).alias("c"))
    return sums.join(population, "qid").select("qid", "k", "param", (F.col("hit") + F.col("c") * (F.col("n") - F.col("w"))).alias("estimate"))


# -- the same in numpy, a query at a time: for grids of many parameters

#: Bytes of sums that a task holds before it sends them on.
SUMS_BYTES = 64 << 20


def _merged(settings: list[tuple[Scoring, np.ndarray]], one: tuple[float, np.ndarray], two: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    """Of two lots of items: the best raw score, and all settings' sums on its scale."""
    (first, a), (second, b) = one, two
    best = max(first, second) if settings[0][0].metric == "dot" else min(first, second)
    out, at = np.empty(len(a)), 0
    for s, params in settings:
        some = slice(at, at := at + len(params))
        if s.by_max:
            top = s.array_sim(np.float64(best))
            out[some] = a[some] * s.array_term(s.array_sim(np.float64(first)), top, params) + b[some] * s.array_term(s.array_sim(np.float64(second)), top, params)
        else:
            out[some] = a[some] + b[some]
    return best, out


def _all_sums(settings: list[tuple[Scoring, np.ndarray]]):
    """For pairs of blocks: each query's best raw score, and the sums of all settings and parameters, a task's blocks put together."""
    metric, many = settings[0][0].metric, sum(len(p) for _, p in settings)

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], ["qid", "raw", "sums"])

    def run(batches):
        held: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for ids, qids, scores in raw_scores(row, metric):
                    for j, qid in enumerate(qids.tolist()):
                        use = ids != qid
                        if not use.any():
                            continue
                        raw = scores[j] if use.all() else scores[j][use]
                        best = float(raw.max() if metric == "dot" else raw.min())
                        sums = np.concatenate([s.sums(s.array_sim(raw), s.array_sim(np.float64(best)), params) for s, params in settings])
                        held[qid] = _merged(settings, held[qid], (best, sums)) if qid in held else (best, sums)
                    if 8 * many * len(held) > SUMS_BYTES:
                        yield sent(held)
                        held = {}
        if held:
            yield sent(held)

    return run


def all_sums(items: DataFrame, queries: DataFrame, settings: list[tuple[Scoring, np.ndarray]]) -> DataFrame:
    """qid, raw, sums, a row for each query and task: what _merged puts together. The settings are of one metric."""
    pairs = packed(items).crossJoin(asked_blocks(queries)).select("ids", "matrix", "q_ids", "q_matrix")
    return pairs.mapInArrow(_all_sums(settings), "qid long, raw double, sums binary")


def method_labels(ks: list[int], tops: list[int], samples: list[int]) -> list[str]:
    """The order of query_estimates' rows."""
    return [*(f"our_{k}" for k in ks), *(f"topk_{k}" for k in tops), *(f"random_{r}" for r in samples), *(f"combined_{k}_{r}" for k in tops for r in samples)]


def query_estimates(s: Scoring, params: np.ndarray, rows: dict[str, np.ndarray], n: int, ks: list[int], tops: list[int], samples: list[int]) -> np.ndarray:
    """One query's estimates, a row for each method and a column for each parameter; NaN for null.

    rows: id, raw, level, and the places rk, rl, rr, 0 outside of what they number.
    """
    sim = s.array_sim(rows["raw"])
    mx = sim[rows["rk"] > 0].max()
    terms = lambda use: s.array_term(sim[use][:, None], mx, params)
    none, out = np.full(len(params), np.nan), []

    u = np.flatnonzero(rows["rl"])
    u = u[np.lexsort((-rows["id"][u], -sim[u]))]
    f, places, levels = terms(u), rows["rl"][u], rows["level"][u]
    for k in ks:
        use = places <= k
        own, lv = f[use], levels[use]
        full = np.where(places[use] == k, 2.0 ** -lv.astype(float), 0.0)
        p = 1 - np.concatenate([[0.0], np.cumsum(full)[:-1]])
        open_ = np.flatnonzero(np.bincount(lv)[lv] < k)
        back = open_[len(open_) // 2 :]
        rest = own[back].sum(axis=0) / len(back) if len(back) else none
        out.append((own / p[:, None]).sum(axis=0) + rest * (n - (1 / p).sum()))

    t = np.flatnonzero(rows["rk"])
    t = t[np.argsort(rows["rk"][t])]
    f = terms(t)
    heads = [f[:k].sum(axis=0) for k in tops]
    out += heads

    r = np.flatnonzero(rows["rr"])
    r = r[np.argsort(rows["rr"][r])]
    f = terms(r)
    out += [n * (f[:m].sum(axis=0) / len(f[:m])) if len(r) else none for m in samples]
    rank = dict(zip(rows["id"][t].tolist(), rows["rk"][t].tolist(), strict=True))
    ranks = np.array([rank.get(i, np.iinfo(np.int64).max) for i in rows["id"][r].tolist()], np.int64)
    for k, head in zip(tops, heads, strict=True):
        for m in samples:
            rest = f[:m][ranks[:m] > k]
            out.append(head + (n - min(k, n)) * (rest.sum(axis=0) / len(rest)) if len(rest) else none)
    return np.array(out)


#: Queries whose errors are put in one row for each setting, method and parameter.
ERRORS_AT_ONCE = 256


def query_errors(named: list[tuple[str, Scoring, np.ndarray]], ks: list[int], tops: list[int], samples: list[int]):
    """From rows in the order of qid (R.cuts' with n, and all_sums'): setting, method, param and errors, those of many queries."""
    settings, labels = [(s, p) for _, s, p in named], method_labels(ks, tops, samples)

    def of_query(rows: pa.Table) -> list[np.ndarray] | None:
        sums = rows.filter(rows.column("sums").is_valid())
        cut = rows.filter(rows.column("sums").is_null())
        held = {c: cut.column(c).fill_null(0).to_numpy() for c in ("id", "raw", "level", "rk", "rl", "rr")}
        if not len(sums) or not held["rk"].any():
            return None
        total = None
        for raw, values in zip(sums.column("raw").to_pylist(), sums.column("sums").to_pylist(), strict=True):
            one = raw, np.frombuffer(values, float)
            total = _merged(settings, total, one) if total else one
        n, at, out = rows.column("n")[0].as_py(), 0, []
        for s, params in settings:
            truth = total[1][at : (at := at + len(params))]
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where(truth > 0, np.abs(query_estimates(s, params, held, n, ks, tops, samples) - truth) / truth, np.nan))
        return out

    def sent(held: list[list[np.ndarray]]):
        for i, (name, _, params) in enumerate(named):
            errors = np.ascontiguousarray(np.stack([x[i] for x in held]).transpose(1, 2, 0))
            columns = [name] * (len(labels) * len(params)), np.repeat(labels, len(params)).tolist(), params.tolist() * len(labels), [e.tobytes() for of_method in errors for e in of_method]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["setting", "method", "param", "errors"])

    def run(batches):
        held, before = [], None
        def queries():  # whole ones
            nonlocal before
            for batch in batches:
                if not len(batch):
                    continue
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([before, table]).combine_chunks() if before is not None else table
                ends = np.flatnonzero(np.diff(table.column("qid").to_numpy())) + 1
                for begin, end in zip([0, *ends], ends, strict=False):
                    yield table.slice(begin, end - begin)
                before = table.slice(ends[-1] if len(ends) else 0)
            if before is not None:
                yield before

        for rows in queries():
            if errors := of_query(rows):
                held.append(errors)
            if len(held) == ERRORS_AT_ONCE:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    return run
