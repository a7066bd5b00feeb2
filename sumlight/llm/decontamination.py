"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of a text's hashed GRAM-word runs, the least of every WINDOW consecutive ones is kept. Two texts that share
SPAN = GRAM + WINDOW - 1 words in a row keep a common value, so documents that share none with the benchmark need no
closer look. In the others each common value is extended to the SPAN-word windows around it, and these are compared
with the benchmark's windows word by word. Items of fewer than SPAN words are one window each, and shorter than any
fingerprint guarantees; documents' runs of just those lengths are compared with them, if there are such items.

Nulls and odd rows: null and empty texts have no words and are never hit, and items without words are left out. Items
with one id count once in a document. Repeated rows of documents stay and get equal values; a null doc_id is kept.
Empty tables: no documents, no rows; no benchmark, nothing hit. Other columns are ignored.

Scale: fingerprints and windows of the benchmark, and the documents that share a fingerprint, are broadcast only if
their measured size is at most MOST_BROADCAST bytes; beyond it they are joined by shuffles, whose skewed keys Spark
splits. The first join emits a document at most once for each fingerprint, and only keeps those found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, prepare, read

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
MOST_BROADCAST = 16 << 20

_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else; lower() does that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    cut = F.filter(F.split(folded(text), _CUT, -1), lambda w: w != "")
    return F.coalesce(cut, F.array().cast("array<string>"))


def gram_hashes(words: Column) -> Column:
    """A hash for each run of GRAM words; the text must have so many."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM)))


def fingerprints(hashes: Column) -> Column:
    """The distinct least hashes of all windows."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.array_min(F.slice(hashes, i, WINDOW))))


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """The table, marked for broadcast if it is small enough: its size is measured here."""
    size = df.agg(F.sum(row_bytes + 16)).first()[0] or 0
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def find_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """rk (a key of the row: xxhash64 of doc_id and text), at, span, item_id: where items' windows occur."""
    prepare(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    bench = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    windows = bench.withColumn("span", F.least(F.size("words"), F.lit(SPAN)))
    windows = windows.select("item_id", "span", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("span") + 1), lambda i: F.slice(F.col("words"), i, F.col("span")))).alias("window"))
    windows = windows.distinct().checkpoint()
    bytes_of = F.octet_length(F.concat_ws(" ", "window")) + 16 * SPAN

    hits = _long_hits(texts, bench, windows, bytes_of)
    lengths = [r[0] for r in windows.where(F.col("span") < SPAN).select("span").distinct().collect()]  # SPAN - 1 at most
    for n in sorted(lengths):
        cut = texts.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= n)
        cut = cut.select("rk", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.slice(F.col("words"), i, n))).alias("at", "window"))
        own = windows.where(F.col("span") == n).select("item_id", "window")
        hits = hits.union(cut.join(small(own, bytes_of), "window").select("rk", "at", F.lit(n).alias("span"), "item_id"))
    return hits


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item, with their columns."""
    rk = free(docs, "decontamination_rk")
    hit = find_hits(docs, items).select(F.col("rk").alias(rk)).distinct()
    return docs.withColumn(rk, F.xxhash64("doc_id", "text")).join(hit, rk, "left_anti").select(docs.columns)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op4's columns for every row of docs."""
    hits = find_hits(docs, items)
    places = hits.groupBy("rk", "at").agg(F.max("span").alias("span"))
    covered = places.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("at", "span"))).alias("runs"))
    step = lambda s, r: F.struct(F.greatest(s["upto"], r["at"] + r["span"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), r["at"] + r["span"] - F.greatest(s["upto"], r["at"]))).alias("n"))
    covered = covered.select("rk", F.aggregate("runs", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda s: s["n"].cast("long")).alias("n_hit"))
    named = hits.select("rk", "item_id").distinct().groupBy("rk").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))

    counts = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counts.join(covered.join(named, "rk"), "rk", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _long_hits(texts: DataFrame, bench: DataFrame, windows: DataFrame, bytes_of: Column) -> DataFrame:
    """rk, at, span, item_id: where the SPAN-word windows of items occur."""
    def printed(df: DataFrame, *keep: str) -> DataFrame:
        long = df.where(F.size("words") >= SPAN).withColumn("hashes", gram_hashes(F.col("words")))
        return long.select(*keep, F.explode(fingerprints(F.col("hashes"))).alias("print"))

    own = printed(bench).distinct().checkpoint()
    seen = printed(texts.select("rk", words_of(F.col("text")).alias("words")), "rk").join(small(own, F.lit(8)), "print", "left_semi")
    seen = seen.groupBy("rk").agg(F.collect_set("print").alias("prints")).checkpoint()
    near = texts.join(small(seen.withColumnRenamed("rk", "found"), F.size("prints") * 8 + 24), F.col("rk") == F.col("found"))
    near = near.select("rk", "prints", words_of(F.col("text")).alias("words")).dropDuplicates(["rk"])
    near = near.withColumn("hashes", gram_hashes(F.col("words")))
    at = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains(F.col("prints"), F.element_at("hashes", i + 1)))
    last = F.size("words") - SPAN
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), i - (WINDOW - 1)), F.least(i, last)))))
    cut = near.select("rk", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(F.col("words"), i + 1, SPAN).alias("window")))).alias("c")).select("rk", "c.at", "c.window")
    own = windows.where(F.col("span") == SPAN).select("item_id", "window")
    return cut.join(small(own, bytes_of), "window").select("rk", "at", F.lit(SPAN).alias("span"), "item_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _sql(docs: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
ditems as (select item_id, {words} as w from benchmark),
dwindows as (
  select distinct item_id, span, list_slice(w, i, i + span - 1) as win
  from (select item_id, w, least(len(w), {SPAN}) as span, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) as i from ditems where len(w) > 0)),
dwords as (select row_number() over () as rid, doc_id, {words} as w from {docs}),
dspans as (select distinct span from dwindows),
dcuts as (
  select rid, i, span, list_slice(w, i, i + span - 1) as win
  from (select rid, w, span, unnest(range(1, len(w) - span + 2)) as i from dwords cross join dspans where len(w) >= span)),
dhits as (select c.rid, c.i, c.span, d.item_id from dcuts c join dwindows d on c.span = d.span and c.win = d.win),
dplaces as (select distinct rid, unnest(range(i, i + span)) as p from dhits),
dcovered as (select rid, count(*) as n_hit from dplaces group by rid),
dnamed as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct rid, item_id::varchar as s from dhits) group by rid),
checked as (
  select d.rid, d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
         sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from dwords d left join dcovered using (rid) left join dnamed using (rid))"""


SQL = f"with {_sql('documents')}\nselect doc_id, n_words, n_hit, n_items, items_sha256, contaminated from checked"
