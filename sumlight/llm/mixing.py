"""Mixing sources to target weights: hash-threshold histograms, with DataFrame operations only.

Every document has a size (its words) and a 60-bit hash of its id. A source whose target is below its size takes the
documents whose hash lies under a threshold; a larger target takes every document some whole number of times and
those under the threshold once more. The threshold is found without sorting documents: sizes are summed by source and
hash bucket, the bucket in which the budget ends is found from the sums, and only that bucket is divided again, until
the buckets are single hashes.

Nulls and odd rows: a null text has size 0; a null source is a source of its own and comes last; a null doc_id hashes
as empty text. Rows with one doc_id share their hash and are taken or left together. An empty table gives an empty
result. Other columns of the input are ignored by `mix` and kept by `apply_mix`; where one of them has the name of a new
column, the new one has an underscore after it.

Scale: documents are scanned once for (source, hash, size), which is cut off by checkpoint(). The first round sums all of
these, partly before the shuffle; each further round first drops the documents outside of its source's boundary bucket,
all but one in 4096 or so, and sums the rest. So a round's sums are at most 4096 rows a source. The state, one row a
source, is broadcast if its measured size is at most MOST_BROADCAST bytes; beyond that it is joined by source and salt,
with a salt for each ROWS_A_SALT rows of the largest source. No document is sorted, and texts are never shuffled as long
as the sources fit into a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free, prepare, read

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is this many times its source's size at most.
MOST = 3
#: Bits of the hash, and those that one round settles.
BITS, STEP = 60, 12
MOST_BROADCAST = 16 << 20
ROWS_A_SALT = 1_000_000
#: What apply_mix adds to a row.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def size_of(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> those and target.

    The shares of sources under their limit are in the proportion of their weights, level * weight, where level makes
    all targets sum to the whole: sources are ordered by limit / weight, and those before the first whose limit
    exceeds its share are at their limit. One row a source; the window runs over that table alone.
    """
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("n", order).withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "n")
    everything = W.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    table = (
        table.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("free", F.col("limit") > F.col("level") * F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)["level"])
    )
    return table.select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def by_source(rows: DataFrame, state: DataFrame, salt: Column, most_rows: int) -> tuple[DataFrame, DataFrame, Column]:
    """rows and state, and the condition that joins them by rows' `source` and state's `s`: see Scale above."""
    size = state.agg(F.sum(F.coalesce(F.octet_length(F.col("s").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("s"))
    if size <= MOST_BROADCAST:
        return rows, F.broadcast(state), same
    salts = -(-most_rows // ROWS_A_SALT)
    own, other = free(rows, "salt"), free(rows, "state_salt")
    return rows.withColumn(own, F.pmod(salt, F.lit(salts)).cast("int")), state.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), same & (F.col(own) == F.col(other))


def histogram(sized: DataFrame, bits: int) -> DataFrame:
    """source, bucket, size: sums by the hash without its last bits."""
    return sized.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("size"))


def thresholds(sized: DataFrame, goals: DataFrame, most_rows: int = ROWS_A_SALT) -> DataFrame:
    """source, hash, size and source, source_size, target -> source, source_size, target, whole, threshold.

    A document is taken `whole` times, and once more if its hash is at most the threshold. Among the hashes, the
    threshold is the last one whose documents, added to those before, end nearer to the budget than they began.
    most_rows: rows of the largest source.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # prefix: the boundary bucket so far; before: the size of all below it; done: the hashes below it are taken.
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for bits in range(BITS - STEP, -STEP - 1, -STEP):
        if bits < BITS - STEP:
            rows, few, same = by_source(sized, state.select(F.col("source").alias("s"), "prefix"), F.col("hash"), most_rows)
            sized = rows.join(few, same & (F.shiftright("hash", bits + STEP) == F.col("prefix"))).select("source", "hash", "size").checkpoint()
        if bits < 0:
            break
        here = histogram(sized, bits).join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "right")
        here = here.select(F.col("s").alias("source"), "source_size", "target", "whole", "rest", "prefix", "before", "bucket", F.coalesce("size", F.lit(0)).alias("size"))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        here = here.withColumn("begin", F.col("before") + upto - F.col("size")).withColumn("end", F.col("before") + upto)
        # The boundary: the first bucket whose sizes pass the budget; with none, the last one.
        passed = F.col("end") > F.col("rest")
        pick = F.coalesce(F.min(F.when(passed, F.struct("bucket", "begin", "end"))), F.max(F.struct("bucket", "begin", "end")))
        state = here.groupBy("source", "source_size", "target", "whole", "rest").agg(pick.alias("p"))
        state = state.select("source", "source_size", "target", "whole", "rest", F.coalesce(F.col("p.bucket"), F.lit(0)).alias("prefix"), F.col("p.begin").alias("before"))
        state = state.checkpoint()
    # The boundary is now one hash, and sized its documents; they are taken if that ends nearer to the budget.
    at = sized.groupBy("source").agg(F.sum("size").alias("at"))
    both = state.withColumnRenamed("source", "s").join(at, F.col("source").eqNullSafe(F.col("s")), "left")
    nearer = 2 * F.col("before") + F.coalesce("at", F.lit(0)) <= 2 * F.col("rest")
    return both.select(F.col("s").alias("source"), "source_size", "target", "whole", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def added(docs: DataFrame) -> dict[str, str]:
    """The names that ADDED's columns get beside those of docs."""
    return {name: free(docs, name) for name in ADDED}


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """All columns of docs and those of ADDED: mix_copies says how often the mix takes the row."""
    prepare(docs.sparkSession)
    names = docs.columns
    # All columns of docs go into one, so that no name of theirs is in the way.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash"))
    sized = keyed.select("source", "hash", "size").checkpoint()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).checkpoint()
    most_rows = sizes.agg(F.max("n")).first()[0] or 1
    found = thresholds(sized, targets(sizes.drop("n"), weights, most).checkpoint(), most_rows).withColumnRenamed("source", "s").checkpoint()
    rows, few, same = by_source(keyed, found, F.col("hash"), most_rows)
    copies = F.col("whole") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)
    new = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": copies.cast("long")}
    return rows.join(few, same).select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[new[k].alias(v) for k, v in added(docs).items()])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row."""
    narrow = docs.select("doc_id", "source", "text")
    return apply_mix(narrow, weights, most).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _sql(docs: str) -> str:
    weight = "(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double"
    return f"""
sized as (
  select *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from {docs}),
sources as (select source, sum(size)::bigint as source_size, {MOST}.0::double * sum(size)::double as lim from sized group by source),
weighed as (select *, {weight} as weight, sum(source_size) over ()::double as total from sources),
levels as (
  select *, (total - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
          / (sum(weight) over () - coalesce(sum(weight) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0)) as level
  from weighed),
lowest as (select arg_min(level, lim / weight) filter (where lim > level * weight) as level from levels),
goals as (
  select l.source, l.source_size, coalesce(least(l.lim, m.level * l.weight), l.lim) as target from levels l cross join lowest m),
ranked as (
  select d.*, g.source_size, g.target,
         case when g.source_size > 0 then floor(g.target / g.source_size)::bigint else 0 end as whole,
         sum(d.size) over (partition by d.source order by d.hash range between unbounded preceding and current row) as upto,
         sum(d.size) over (partition by d.source, d.hash) as own
  from sized d join goals g on d.source is not distinct from g.source),
copied as (
  select *, whole + case when 2 * (upto - own) + own <= 2 * (target - whole * source_size) then 1 else 0 end as copies from ranked)"""


SQL = f"with {_sql('documents')}\nselect doc_id, size, source_size, target, (copies * size)::bigint as taken from copied"
