"""The queries by name, and the same in DuckDB's SQL where SQL can express them.

Searches ask for every item whose id is divisible by 50 and run against all items.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import text as T
from ..functions import vectors as V
from ..functions.encoders import encode, hashing
from ..functions.scoring import ALL, BALL, KDE, SETTINGS, SOFTMAX, Scoring, powers
from ..operators import estimators as E
from ..operators import evaluate as X
from ..operators import retrieve as R
from ..operators import synthetic as Y
from ..sources import synthetic as source_synthetic
from ..sources import tables as S
from ..streaming.ingest import ingest, ingested
from . import experiment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GRID = experiment.Grid()
KS, TOPS, RS = list(GRID.levels), list(GRID.tops), list(GRID.samples)
CODES = (-0.4, 0.4)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = S.table(spark, d, "embeddings")
    return items, R.query_set(items)


# -- what the SQL has in common: q queries, s scores of all pairs, m maxima, u the best of each level, t, c, w rows of estimates

_Q = f"q as (select vec_id as qid, vec_id // {R.EVERY} as qidx, embedding::double[] as qe from embeddings where vec_id % {R.EVERY} = 0)"


def _scores(s: Scoring, vectors: str = "embedding::double[]") -> str:
    raw = f"list_distance({vectors}, qe) as dist" if s.metric == "euclid" else f"list_inner_product({vectors}, qe) as dot"
    return f"{_Q}, s0 as (select qid, vec_id as id, {L.level_sql('vec_id', f'(qidx % {L.COLUMNS})')} as level, {raw} from embeddings join q on vec_id <> qid), s as (select qid, id, level, {s.sim_sql} as sim from s0), m as (select qid, max(sim) as mx, count(*) as n from s group by qid)"


def _params(values: list | tuple, name: str, kind: str = "double") -> str:
    # With an exponent a literal is a double from the start, not a decimal.
    items = ", ".join(repr(v) if isinstance(v, int) or "e" in repr(v) else f"{v!r}e0" for v in values)
    return f"(select unnest([{items}]::{kind}[]) as {name})"


def _top(k: int) -> str:
    return f"t as (select * from (select *, row_number() over (partition by qid order by sim desc, id desc) as rk from s) where rk <= {k})"


def _levels(k: int) -> str:
    return f"u as (select * from (select *, row_number() over (partition by qid, level order by sim desc, id desc) as rl from s) where rl <= {k})"


def _sample(m: int) -> str:
    return f"a as (select * from (select *, row_number() over (partition by qid order by md5('R0:' || qid || ':' || id), id) as rr from s) where rr <= {m})"


_WEIGHTS = f"""w0 as (
  select u.*, k, 1 - coalesce(sum(case when rl = k then pow(2.0, -level) else 0.0 end) over (partition by qid, k order by sim desc, id desc rows between unbounded preceding and 1 preceding), 0.0) as p,
         count(*) over (partition by qid, k, level) < k as nonfull
  from u cross join {_params(KS, 'k', 'int')} where rl <= k),
w as (
  select *, nonfull and row_number() over (partition by qid, k, nonfull order by sim desc, id desc) > count(*) over (partition by qid, k, nonfull) // 2 as back from w0)"""


def _truth(s: Scoring) -> str:
    return f"select qid, param, sum({s.term_sql}) as true_sum from s join m using (qid) cross join {_params(s.params, 'param')} group by qid, param"


def _topk_sql(s: Scoring) -> str:
    return f"select qid, k, param, sum({s.term_sql}) as estimate from t join m using (qid) cross join {_params(TOPS, 'k', 'int')} cross join {_params(s.params, 'param')} where rk <= k group by qid, k, param"


def _random_sql(s: Scoring) -> str:
    return f"select qid, r, param, any_value(n) * avg({s.term_sql}) as estimate from a join m using (qid) cross join {_params(RS, 'r', 'int')} cross join {_params(s.params, 'param')} where rr <= r group by qid, r, param"


def _combined_sql(s: Scoring) -> str:
    rest = f"select a.qid, k, r, param, avg({s.term_sql.replace('sim', 'a.sim')}) as mean from a join m on a.qid = m.qid left join t on t.qid = a.qid and t.id = a.id cross join {_params(TOPS, 'k', 'int')} cross join {_params(RS, 'r', 'int')} cross join {_params(s.params, 'param')} where rr <= r and (rk is null or rk > k) group by a.qid, k, r, param"
    return f"select h.qid, h.k, g.r, h.param, h.estimate + (n - least(h.k, n)) * mean as estimate from ({_topk_sql(s)}) h cross join {_params(RS, 'r', 'int')} g join m on m.qid = h.qid left join ({rest}) z on z.qid = h.qid and z.k = h.k and z.r = g.r and z.param = h.param"


def _level_sql(s: Scoring) -> str:
    return f"select qid, k, param, sum(f / p) + avg(f) filter (back) * (any_value(n) - sum(1 / p)) as estimate from (select w.*, param, n, {s.term_sql} as f from w join m using (qid) cross join {_params(s.params, 'param')}) group by qid, k, param"


_LEVEL_LIST = ", ".join(f"{L.level_sql('vec_id', j)} as level_{j}" for j in range(L.COLUMNS))

# -- sources, filters, scalar functions


@query("l2_normalise", "select vec_id, round(sqrt(list_inner_product(v, v)), 6) + 0.0 as norm, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) + 0.0 as first, round(v[-1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) + 0.0 as last from (select vec_id, embedding::double[] as v from embeddings)")
def l2_normalise(spark, d):
    v = F.col("embedding")
    unit = S.table(spark, d, "embeddings").select("vec_id", V.norm(v).alias("norm"), V.normalised(v).alias("u"))
    return unit.select("vec_id", r6(F.col("norm")).alias("norm"), r6(F.element_at("u", 1)).alias("first"), r6(F.element_at("u", -1)).alias("last"))


_STRIP = r"regexp_replace(regexp_replace({}, '^[ \t\n\r\f\x0b]+', ''), '[ \t\n\r\f\x0b]+$', '')"


@query("text_stream_ids", f"select source || '|' || doc_id as asset_id, length(t)::int as n_chars, md5(t) as text_md5 from (select source, doc_id, {_STRIP.format('coalesce(text, repeat(chr(32), 0))')} as t from documents) where length(t) >= 1")
def text_stream_ids(spark, d):
    rows = S.text_items(S.table(spark, d, "documents"), ["text"], ["source", "doc_id"])
    return rows.select("asset_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("category_union", "select category, asset_id, length(text)::int as n_chars from (select 'documents' as category, 'documents|' || doc_id as asset_id, text from documents union all select 'benchmark', 'benchmark|' || item_id, text from benchmark)")
def category_union(spark, d):
    rows = S.category_union({"documents": S.table(spark, d, "documents"), "benchmark": S.table(spark, d, "benchmark")}, {"documents": "doc_id", "benchmark": "item_id"})
    return rows.select("category", "asset_id", F.length("text").alias("n_chars"))


@query("shard_manifest", "select (o // 64)::bigint as shard, count(*) as n_rows, min(o) as first_ordinal, max(o) as last_ordinal, min(doc_id) as first_id, max(doc_id) as last_id from (select doc_id, row_number() over (order by doc_id) - 1 as o from documents) group by 1")
def shard_manifest(spark, d):
    return S.manifest(S.table(spark, d, "documents"), "doc_id", 64)


@query("scroll_ids", "select vec_id from embeddings order by vec_id limit 100")
def scroll_ids(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id").orderBy("vec_id").limit(100)


@query("scroll_query_pool", "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) + 0.0 as norm from (select * from embeddings order by vec_id limit 50)")
def scroll_query_pool(spark, d):
    rows = S.table(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id").limit(50)
    return rows.select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"))


@query("retrieve_by_ids", f"select vec_id, {_LEVEL_LIST} from embeddings where vec_id % {R.EVERY} = 0")
def retrieve_by_ids(spark, d):
    items, ids = _items(spark, d)
    return items.join(ids.select("vec_id"), "vec_id", "left_semi").select("vec_id", *L.all_levels(F.col("vec_id")))


@query("query_filename", "select page_id, replace(trim(url, '/'), '/', '_') as filename from pages")
def query_filename(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.filename(F.col("url")).alias("filename"))


@query("clean_asset_id", "select doc_id, md5(coalesce(nullif(" + _STRIP.format("regexp_replace(text, '[\\r\\n]', ' ', 'g')") + ", ''), '(unknown)')) as id_md5 from documents")
def clean_asset_id(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.clean_id(F.col("text")).cast("binary")).alias("id_md5"))


@query("rarity_levels", f"select vec_id, {L.level_sql('vec_id', 0)} as level from embeddings")
def rarity_levels(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", L.level(F.col("vec_id"), 0).alias("level"))


@query("rarity_levels_all", f"select vec_id, {_LEVEL_LIST} from embeddings")
def rarity_levels_all(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", *L.all_levels(F.col("vec_id")))


@query("store_levels", f"select vec_id, label, {_LEVEL_LIST} from embeddings")
def store_levels(spark, d):
    items = S.table(spark, d, "embeddings").select("vec_id", "label")
    return items.join(rarity_levels_all(spark, d), "vec_id")


@query("filter_level", f"select vec_id from embeddings where {L.level_sql('vec_id', 0)} = 2")
def filter_level(spark, d):
    return S.table(spark, d, "embeddings").where(L.level(F.col("vec_id"), 0) == 2).select("vec_id")


@query("filter_has_id", "select vec_id, label from embeddings where vec_id in (select doc_id from labels)")
def filter_has_id(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", "label").join(S.table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("exclude_self", f"with {_scores(SOFTMAX)} select qid, count(*) as n from s group by qid")
def exclude_self(spark, d):
    return R.population(*_items(spark, d))


@query("max_levels", " union all ".join(f"select {j} as level_column, max({L.level_sql('vec_id', j)}) as max_level from embeddings" for j in range(L.COLUMNS)))
def max_levels(spark, d):
    rows = rarity_levels_all(spark, d).agg(*[F.max(f"level_{j}").alias(f"m{j}") for j in range(L.COLUMNS)])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("level_column"), F.col(f"m{j}").alias("max_level")) for j in range(L.COLUMNS)])).alias("e")).select("e.*")


@query("level_rotation", f"select vec_id as qid, {L.level_sql('vec_id', f'((vec_id // {R.EVERY}) % {L.COLUMNS})')} as level from embeddings where vec_id % {R.EVERY} = 0")
def level_rotation(spark, d):
    column = (F.floor(F.col("vec_id") / R.EVERY) % L.COLUMNS + 1).cast("int")
    return _items(spark, d)[1].select(F.col("vec_id").alias("qid"), F.element_at(F.array(*L.all_levels(F.col("vec_id"))), column).alias("level"))


@query("param_grid_union", "select setting, round(param, 6) + 0.0 as param from (select distinct setting, round(pow(10.0::double, b + i * step), 9) as param from (values ('image_ball', -3.0::double, 0.1::double, 50), ('image_ball', 0.5, 0.05, 26), ('text_ball', -5.0, 0.1, 60), ('text_ball', 0.0, 0.05, 36)) v(setting, b, step, n), lateral (select unnest(range(n))::double as i))")
def param_grid_union(spark, d):
    parts = [("image_ball", powers(-3, 2, 0.1)), ("image_ball", powers(0.5, 1.8, 0.05)), ("text_ball", powers(-5, 1, 0.1)), ("text_ball", powers(0, 1.8, 0.05))]
    rows = None
    for name, values in parts:
        one = spark.createDataFrame([(name, v) for v in values], "setting string, param double")
        rows = one if rows is None else rows.union(one)
    # Equal exponents that two ranges reach by different steps differ in their last digits.
    return rows.withColumn("param", F.round("param", 9)).distinct().select("setting", r6(F.col("param")).alias("param"))


# -- scores and terms


def _add_scoring(s: Scoring) -> None:
    @query(f"sim_{s.name}", f"with {_scores(s)} select qid, id, round(sim, 6) + 0.0 as sim from s")
    def sim(spark, d):
        return R.scored(*_items(spark, d), s).select("qid", "id", r6(F.col("sim")).alias("sim"))

    @query(f"f_{s.name}", f"with {_scores(s)} select qid, id, param, round({s.term_sql}, 6) + 0.0 as f from s join m using (qid) cross join {_params(s.params, 'param')}")
    def f(spark, d):
        rows = R.scored(*_items(spark, d), s)
        return E._terms(rows, E.max_sim(rows), s, s.params).select("qid", "id", "param", r6(F.col("f")).alias("f"))

    @query(f"true_sum_{s.name}", f"with {_scores(s)} select qid, param, round(true_sum, 6) + 0.0 as true_sum from ({_truth(s)})")
    def true_sum(spark, d):
        return E.true_sum(*_items(spark, d), s, list(s.params)).select("qid", "param", r6(F.col("true_sum")).alias("true_sum"))

    @query(f"est_topk_{s.name}", f"with {_scores(s)}, {_top(max(TOPS))} select qid, k, param, round(estimate, 6) + 0.0 as estimate from ({_topk_sql(s)})")
    def est_topk(spark, d):
        top = R.top(*_items(spark, d), s, max(TOPS))
        return E.topk_estimate(top, s, s.params, TOPS).withColumn("estimate", r6(F.col("estimate")))

    @query(f"est_random_{s.name}", f"with {_scores(s)}, {_sample(max(RS))} select qid, r, param, round(estimate, 6) + 0.0 as estimate from ({_random_sql(s)})")
    def est_random(spark, d):
        items, queries = _items(spark, d)
        rows = R.sample(items, queries, s, max(RS))
        return E.random_estimate(rows, E.max_sim(R.top(items, queries, s, 1)), R.population(items, queries), s, s.params, RS).withColumn("estimate", r6(F.col("estimate")))

    @query(f"est_combined_{s.name}", f"with {_scores(s)}, {_top(max(TOPS))}, {_sample(max(RS))} select qid, k, r, param, round(estimate, 6) + 0.0 as estimate from ({_combined_sql(s)})")
    def est_combined(spark, d):
        items, queries = _items(spark, d)
        top, rows = R.top(items, queries, s, max(TOPS)), R.sample(items, queries, s, max(RS))
        return E.combined_estimate(top, rows, R.population(items, queries), s, s.params, TOPS, RS).withColumn("estimate", r6(F.col("estimate")))

    @query(f"est_level_{s.name}", f"with {_scores(s)}, {_levels(max(KS))}, {_WEIGHTS} select qid, k, param, round(estimate, 6) + 0.0 as estimate from ({_level_sql(s)})")
    def est_level(spark, d):
        items, queries = _items(spark, d)
        u = R.top_by_level(items, queries, s, max(KS))
        return E.level_estimate(u, R.population(items, queries), s, s.params, KS).withColumn("estimate", r6(F.col("estimate")))


for _s in ALL.values():
    _add_scoring(_s)


@query("score_euclid", f"with {_scores(BALL)} select qid, id, round(-sim, 6) + 0.0 as score from s")
def score_euclid(spark, d):
    return R.scored(*_items(spark, d), BALL).select("qid", "id", r6(-F.col("sim")).alias("score"))


@query("score_dot", f"with {_scores(SOFTMAX)} select qid, id, round(sim, 6) + 0.0 as score from s")
def score_dot(spark, d):
    return R.scored(*_items(spark, d), SOFTMAX).select("qid", "id", r6(F.col("sim")).alias("score"))


@query("all_scores", f"with {_scores(SOFTMAX)} select qid, id, level, round(sim, 6) + 0.0 as sim from s")
def all_scores(spark, d):
    return R.scored(*_items(spark, d), SOFTMAX).select("qid", "id", "level", r6(F.col("sim")).alias("sim"))


@query("max_sim", f"with {_scores(SOFTMAX)} select qid, round(mx, 6) + 0.0 as max_sim from m")
def max_sim(spark, d):
    return E.max_sim(R.top(*_items(spark, d), SOFTMAX, 1)).select("qid", r6(F.col("mx")).alias("max_sim"))


# -- retrieval


@query("topk", f"with {_scores(SOFTMAX)}, {_top(100)} select qid, rk::int as rk, id, round(sim, 6) + 0.0 as sim from t")
def topk(spark, d):
    return R.top(*_items(spark, d), SOFTMAX, 100).select("qid", "rk", "id", r6(F.col("sim")).alias("sim"))


@query("topk_by_level", f"with {_scores(KDE)}, {_levels(20)} select qid, level, rl::int as rl, id, round(sim, 6) + 0.0 as sim from u")
def topk_by_level(spark, d):
    return R.top_by_level(*_items(spark, d), KDE, 20).select("qid", "level", "rl", "id", r6(F.col("sim")).alias("sim"))


@query("random_sample", f"with {_scores(SOFTMAX)}, {_sample(100)} select qid, rr::int as rr, id from a")
def random_sample(spark, d):
    return R.sample(*_items(spark, d), SOFTMAX, 100).select("qid", "rr", "id")


@query("sample_minus_topk", f"with {_scores(SOFTMAX)}, {_top(100)}, {_sample(100)} select a.qid, a.id from a left join t on t.qid = a.qid and t.id = a.id where t.id is null")
def sample_minus_topk(spark, d):
    items, queries = _items(spark, d)
    return E.sample_minus_top(R.sample(items, queries, SOFTMAX, 100), R.top(items, queries, SOFTMAX, 100)).where("rk is null").select("qid", "id")


_LOW, _HIGH = CODES
_CODED = f"[round((least(greatest(x, {_LOW}), {_HIGH}) - ({_LOW})) / (({_HIGH} - ({_LOW}))::double / 254)) * (({_HIGH} - ({_LOW}))::double / 254) + ({_LOW}) for x in embedding::double[]]"


def _ann(k: int) -> str:
    coarse = _scores(SOFTMAX, _CODED).replace(", m as", ", m_coarse as").replace("s0 as", "c0 as").replace("from s0", "from c0").replace(" s as", " c as").replace("from s group", "from c group")
    return f"{coarse}, cut as (select qid, id from (select *, row_number() over (partition by qid order by sim desc, id desc) as rk from c) where rk <= {int(2.5 * k)}), x as (select * from (select cut.qid, id, list_inner_product(embedding::double[], qe) as sim, row_number() over (partition by cut.qid order by list_inner_product(embedding::double[], qe) desc, id desc) as rk from cut join q on q.qid = cut.qid join embeddings on vec_id = id) where rk <= {k})"


@query("ann_int8_rescore", f"with {_ann(25)} select qid, rk::int as rk, id, round(sim, 6) + 0.0 as sim from x")
def ann_int8_rescore(spark, d):
    return R.approximate(*_items(spark, d), SOFTMAX, 25, *CODES).select("qid", "rk", "id", r6(F.col("sim")).alias("sim"))


@query("ann_lsh")
def ann_lsh(spark, d):
    return R.approximate_lsh(*_items(spark, d), 25).select("qid", "rk", "id", r6(F.col("sim")).alias("sim"))


@query("ann_lsh_recall")
def ann_lsh_recall(spark, d):
    items, queries = _items(spark, d)
    return X.recall_statistics(X.recalls(R.top(items, queries, BALL, 25), R.approximate_lsh(items, queries, 25), ["qid"], [25]), "k")


@query("ann_fitted_recall")
def ann_fitted_recall(spark, d):
    """Codes on the range that holds 0.99 of the elements, as measured."""
    items, queries = _items(spark, d)
    return X.recall_statistics(X.recalls(R.top(items, queries, SOFTMAX, 25), R.approximate(items, queries, SOFTMAX, 25), ["qid"], [25]), "k")


@query("level_weights", f"with {_scores(KDE)}, {_levels(max(KS))}, {_WEIGHTS} select qid, k, id, level, p from w")
def level_weights(spark, d):
    return E.level_weights(R.top_by_level(*_items(spark, d), KDE, max(KS)), KS).select("qid", "k", "id", "level", "p")


@query("nonfull_levels", f"with {_scores(KDE)}, {_levels(max(KS))}, {_WEIGHTS} select qid, k, level, count(*) as n from w where nonfull group by qid, k, level")
def nonfull_levels(spark, d):
    rows = E.level_weights(R.top_by_level(*_items(spark, d), KDE, max(KS)), KS)
    return rows.where("nonfull").groupBy("qid", "k", "level").agg(F.count("*").alias("n"))


@query("back_half", f"with {_scores(KDE)}, {_levels(max(KS))}, {_WEIGHTS} select qid, k, id from w where back")
def back_half(spark, d):
    return E.level_weights(R.top_by_level(*_items(spark, d), KDE, max(KS)), KS).where("back").select("qid", "k", "id")


# -- recall


@query("recall_truth_lists", f"with {_scores(SOFTMAX)}, {_top(25)} select qid, string_agg(id::varchar, ',' order by rk) as ids from t group by qid")
def recall_truth_lists(spark, d):
    top = R.top(*_items(spark, d), SOFTMAX, 25)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))), lambda x: x["id"].cast("string"))
    return top.groupBy("qid").agg(F.array_join(ids, ",").alias("ids"))


def _recalls(spark, d) -> DataFrame:
    items, queries = _items(spark, d)
    return X.recalls(R.top(items, queries, SOFTMAX, 100), R.approximate(items, queries, SOFTMAX, 100, *CODES), ["qid"], [25, 50, 100])


_RECALL = f"{_ann(100)}, s as (select qid, vec_id as id, list_inner_product(embedding::double[], qe) as sim from embeddings join q on vec_id <> qid), {_top(100)}, recall as (select t.qid, k, case when count(*) >= k then count(x.id)::double / k end as recall from t cross join {_params([25, 50, 100], 'k', 'int')} left join x on x.qid = t.qid and x.id = t.id and x.rk <= k where t.rk <= k group by t.qid, k)"


@query("recall_at_k", f"with {_RECALL} select qid, k, round(recall, 6) + 0.0 as recall from recall")
def recall_at_k(spark, d):
    return _recalls(spark, d).select("qid", "k", r6(F.col("recall")).alias("recall"))


_STATS = "round(avg(recall), 6) + 0.0 as mean, round(stddev_pop(recall), 6) + 0.0 as std, count(recall) as n, round(2 * stddev_pop(recall) / sqrt(count(recall)), 6) + 0.0 as interval"


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: r6(F.col(c)) for c in columns})


@query("recall_stats", f"with {_RECALL} select k, {_STATS} from recall group by k")
def recall_stats(spark, d):
    return _rounded(X.recall_statistics(_recalls(spark, d), "k"), "mean", "std", "interval")


@query("recall_global", f"with {_RECALL} select {_STATS} from recall where k = 100")
def recall_global(spark, d):
    return _rounded(X.recall_statistics(_recalls(spark, d).where("k = 100")), "mean", "std", "interval")


_CURVE = (
    _scores(SOFTMAX)
    + f", {_levels(20)}, c as (select qid, vec_id as id, {L.level_sql('vec_id', f'(qidx % {L.COLUMNS})')} as level, list_inner_product({_CODED}, qe) as sim from embeddings join q on vec_id <> qid), v as (select * from (select *, row_number() over (partition by qid, level order by sim desc, id desc) as rl from c) where rl <= 20), recall as (select u.qid, u.level, k, case when count(*) >= k then count(v.id)::double / k end as recall from u cross join {_params([5, 10, 20], 'k', 'int')} left join v on v.qid = u.qid and v.level = u.level and v.id = u.id and v.rl <= k where u.rl <= k group by u.qid, u.level, k)"
)


@query("recall_curve", f"with {_CURVE} select k, level, {_STATS} from recall group by k, level")
def recall_curve(spark, d):
    items, queries = _items(spark, d)
    truth = R.top_by_level(items, queries, SOFTMAX, 20).withColumnRenamed("rl", "rk")
    found = R.top_by_level(items, queries, SOFTMAX, 20, CODES).withColumnRenamed("rl", "rk")
    return _rounded(X.recall_statistics(X.recalls(truth, found, ["qid", "level"], [5, 10, 20]), "k", "level"), "mean", "std", "interval")


# -- the experiment and its statistics


def _experiment_sql() -> str:
    parts = []
    for name, (scoring, params) in SETTINGS.items():
        s = replace(scoring, params=params)
        rows = " union all ".join([
            f"select 'our_' || k as method, qid, param, estimate from ({_level_sql(s)})", f"select 'topk_' || k, qid, param, estimate from ({_topk_sql(s)})",
            f"select 'random_' || r, qid, param, estimate from ({_random_sql(s)})", f"select 'combined_' || k || '_' || r, qid, param, estimate from ({_combined_sql(s)})",
        ])
        parts.append(f"select * from (with {_scores(s)}, {_top(max(TOPS))}, {_levels(max(KS))}, {_sample(max(RS))}, {_WEIGHTS}, e as ({rows}), tr as ({_truth(s)}) select '{name}' as setting, method, e.qid, e.param, estimate, true_sum, case when true_sum > 0 then abs(estimate - true_sum) / true_sum end as rel_error from e left join tr on tr.qid = e.qid and tr.param = e.param)")
    return "results as (" + " union all ".join(parts) + ")"


@query("experiment_sum_estimates", f"with {_experiment_sql()} select setting, method, qid, param, round(estimate, 6) + 0.0 as estimate, round(true_sum, 6) + 0.0 as true_sum from results")
def experiment_sum_estimates(spark, d):
    return _rounded(experiment.run(*_items(spark, d)).drop("rel_error"), "estimate", "true_sum")


@query("relative_error", f"with {_experiment_sql()} select setting, method, qid, param, round(rel_error, 6) + 0.0 as rel_error from results")
def relative_error(spark, d):
    return _rounded(experiment.run(*_items(spark, d)).select("setting", "method", "qid", "param", "rel_error"), "rel_error")


@query("method_split", f"with {_experiment_sql()} select distinct method, split_part(method, '_', 1) as alg, substr(method, instr(method, '_') + 1) as label from results")
def method_split(spark, d):
    alg, label = T.method_parts(F.col("method"))
    return experiment.run(*_items(spark, d)).select("method").distinct().select("method", alg.alias("alg"), label.alias("label"))


_MEDIANS = "medians as (select setting, method, param, case when count(rel_error) * 4 >= count(*) then quantile_cont(rel_error, 0.5) end as median_error, count(rel_error) as n from results group by setting, method, param)"


def _medians(spark, d) -> DataFrame:
    return X.median_errors(experiment.run(*_items(spark, d)), "setting", "method", "param")


@query("median_rel_error", f"with {_experiment_sql()}, {_MEDIANS} select setting, method, param, round(median_error, 6) + 0.0 as median_error, n from medians")
def median_rel_error(spark, d):
    return _rounded(_medians(spark, d), "median_error")


@query("quality_curve", f"with {_experiment_sql()}, {_MEDIANS} select setting, split_part(method, '_', 1) as alg, method, round(log10(param), 6) + 0.0 as log_param, round(median_error, 6) + 0.0 as median_error from medians")
def quality_curve(spark, d):
    return _medians(spark, d).select("setting", T.method_parts(F.col("method"))[0].alias("alg"), "method", r6(F.log10("param")).alias("log_param"), r6(F.col("median_error")).alias("median_error"))


_TRADEOFF = """
worst as (
  select setting, method, arg_max(param, (coalesce(median_error, 0.0), -param)) as param, max(coalesce(median_error, 0.0)) as worst_error
  from medians group by setting, method),
placed as (
  select r.setting, r.method, r.rel_error, row_number() over (partition by r.setting, r.method order by r.rel_error) - 1 as place,
         count(*) over (partition by r.setting, r.method) as size
  from results r join worst w on r.setting = w.setting and r.method = w.method and r.param = w.param where rel_error is not null)
select w.setting, w.method, w.param, round(worst_error, 6) + 0.0 as worst_error,
       round(max(rel_error) filter (place = floor(size * 0.4)), 6) + 0.0 as low, round(max(rel_error) filter (place = floor(size * 0.6)), 6) + 0.0 as high
from worst w join placed p on w.setting = p.setting and w.method = p.method group by w.setting, w.method, w.param, worst_error"""


def _tradeoff(spark, d, cuts=None) -> DataFrame:
    S.shared_folder(spark)
    errors = experiment.error_statistics(*_items(spark, d), cuts=cuts).checkpoint()
    worst = X.worst(errors, "setting", "method")
    at = errors.where("n > 0").select("setting", "method", "param", "low", "high")
    return _rounded(worst.join(at, ["setting", "method", "param"]).select("setting", "method", "param", "worst_error", "low", "high"), "worst_error", "low", "high")


@query("worst_param_tradeoff", f"with {_experiment_sql()}, {_MEDIANS}, {_TRADEOFF}")
def worst_param_tradeoff(spark, d):
    return _tradeoff(spark, d)


@query("time_error_tradeoff")
def time_error_tradeoff(spark, d):
    """Of each estimator's largest case: its seconds, and its error at its worst parameter."""
    seconds, cuts = experiment.timed_and_cuts(spark, *_items(spark, d))
    return seconds.join(_tradeoff(spark, d, cuts), ["setting", "method"])


@query("time_ci", "select event_type, round(quantile_cont(value, 0.5), 6) + 0.0 as median, round(max(value) filter (place = floor(size * 0.4)), 6) + 0.0 as low, round(max(value) filter (place = floor(size * 0.6)), 6) + 0.0 as high, count(*) as n from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as place, count(*) over (partition by event_type) as size from events where value is not null) group by event_type")
def time_ci(spark, d):
    return _rounded(X.order_statistics(S.table(spark, d, "events"), "value", ["event_type"], 0.4, 0.6), "median", "low", "high")


@query("time_estimates")
def time_estimates(spark, d):
    return experiment.timed(spark, *_items(spark, d))


@query("combine_results", f"with {_scores(SOFTMAX)} select qid, param, round(true_sum, 6) + 0.0 as true_sum from ({_truth(SOFTMAX)})")
def combine_results(spark, d):
    path = S.scratch(spark, "results")
    S.save_results(QUERIES["true_sum_softmax"](spark, d).withColumn("setting", F.lit("softmax")), path, "setting")
    return S.combine_results(spark, path).select("qid", "param", "true_sum")


# -- the synthetic population

_N, _SEEDS, _K, _THRESHOLDS = 5_000, 40, 20, [10, 100, 1_000, 2_500]
_LEVEL = "cast(41 - length(bin(cast('0x' || substr(md5('S' || seed || ':' || id), 1, 10) as bigint))) as int)"
_HEADS = f"items as (select seed, id, {_LEVEL} as level from (select i // {_N} as seed, i % {_N} as id from range({_N * _SEEDS}) r(i))), u0 as (select * from (select *, row_number() over (partition by seed, level order by id) as rl from items) where rl <= {_K}), u as (select *, 1 - coalesce(sum(case when rl = {_K} then pow(2.0, -level) else 0.0 end) over (partition by seed order by id rows between unbounded preceding and 1 preceding), 0.0) as p, count(*) over (partition by seed, level) < {_K} as nonfull from u0)"
_TRIALS = f"b as (select *, nonfull and row_number() over (partition by seed, nonfull order by id) > count(*) over (partition by seed, nonfull) // 2 as back from u), trials as (select seed, threshold, sum(f / p) + avg(f) filter (back) * ({_N} - sum(1 / p)) as estimate from (select b.*, threshold, (case when id < threshold then 1.0 else 0.0 end)::double as f from b cross join {_params(_THRESHOLDS, 'threshold', 'int')}) group by seed, threshold)"


def _heads(spark) -> DataFrame:
    return Y.level_heads(Y.population(spark, _SEEDS, _N), _K)


@query("synthetic_U", f"with {_HEADS} select seed, id, level, p, nonfull from u")
def synthetic_u(spark, d):
    return _heads(spark).select("seed", "id", "level", "p", "nonfull")


@query("synthetic_estimate", f"with {_HEADS}, {_TRIALS} select seed, threshold, round(estimate, 6) + 0.0 as estimate, round(abs(estimate - threshold) / threshold, 6) + 0.0 as rel_error from trials")
def synthetic_estimate(spark, d):
    return _rounded(Y.estimates(_heads(spark), _N, _THRESHOLDS), "estimate", "rel_error")


@query("synthetic_p95", f"with {_HEADS}, {_TRIALS}, e as (select threshold, abs(estimate - threshold) / threshold as value from trials where estimate is not null), placed as (select *, row_number() over (partition by threshold order by value) - 1 as place, count(*) over (partition by threshold) as size from e) select threshold, round(max(value) filter (place = floor(size * 0.949)), 6) + 0.0 as p95, round(max(value) filter (place = floor(size * 0.936)), 6) + 0.0 as low, round(max(value) filter (place = floor(size * 0.963)), 6) + 0.0 as high from placed group by threshold")
def synthetic_p95(spark, d):
    rows = Y.estimates(_heads(spark), _N, _THRESHOLDS)
    around = X.order_statistics(rows, "rel_error", ["threshold"], 0.936, 0.963).select("threshold", "low", "high")
    at = X.order_statistics(rows, "rel_error", ["threshold"], 0.949, 0.949).select("threshold", F.col("low").alias("p95"))
    return _rounded(at.join(around, "threshold"), "p95", "low", "high")


# -- sources that make or move data


@query("synthetic_vectors")
def synthetic_vectors(spark, d):
    return source_synthetic.vectors(spark, 1_000, 64, seed=1).select("asset_id", r6(V.norm(F.col("embedding"))).alias("norm"))


@query("mean_pool")
def mean_pool(spark, d):
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    states = F.transform(words, lambda w: F.array(F.length(w).cast("double"), (F.crc32(w.cast("binary")) % 100).cast("double")))
    mask = F.transform(words, lambda w: (F.length(w) > 0).cast("double"))
    return S.table(spark, d, "documents").select("doc_id", V.mean_pool(states, mask).alias("pooled"))


@query("encode_text")
def encode_text(spark, d):
    rows = S.text_items(S.table(spark, d, "documents"), ["text"], ["source", "doc_id"])
    v = F.col("embedding")
    return encode(rows, lambda: hashing(32), 32, normalise=True).select("asset_id", r6(V.norm(v)).alias("norm"), *[r6(F.element_at(v, i)).alias(f"element_{i}") for i in (1, 16, 32)])


@query("stream_ingest")
def stream_ingest(spark, d):
    """All events, read as a stream of files and written batch by batch."""
    out, source = S.scratch(spark, "ingest"), S.scratch(spark, "events")
    rows = S.table(spark, d, "events")
    rows.select("event_id", "event_type", "value").repartitionByRange(4, "event_id").write.parquet(source)
    ingest(spark, source, "event_id bigint, event_type string, value double", out, lambda batch: batch.withColumn("asset_id", T.joined_id(F.col("event_type"), F.col("event_id"))))
    return ingested(spark, out).select("event_id", "asset_id", r6(F.col("value")).alias("value"))


SQL["stream_ingest"] = "select event_id, event_type || '|' || event_id as asset_id, round(value, 6) + 0.0 as value from events"
