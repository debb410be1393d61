"""Mixing sources to target weights, in DataFrame functions only.

Method: sizes are summed per source, every source gets a repetition rate (target over size), and a document is
emitted floor(rate) times plus one copy drawn by a hash-seeded Bernoulli trial with the fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: The query's mix: weights by position of the source's name, the share of all sizes that is wanted, and the most
#: that a source may be repeated.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST = 150, 2
SEED = "mix-1"
#: Up to so many sources their targets are broadcast (some 64 bytes each); beyond, they are joined by shuffle, each source's
#: rows in so many parts, so that a large one is no single task's.
BROADCAST_SOURCES, SALTS = 50_000, 64


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(*columns: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the columns' values alone: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of every source.

    Sources in code-point order, null last, take the weights in turn. They share share_percent of all sizes by weight;
    a target stops at most times its source's size, and the excess is shared anew until none is above. If even the
    stops don't reach the wanted total, every target is its stop. The table has one row a source: a dimension, which
    is the only thing that is ever sorted in one piece.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    table_ = materialize(totals.withColumn("weight", weight.cast("long")), "sources")
    stop = F.col("source_size") * most
    wanted, level, held = None, None, -1
    while True:
        above = F.lit(False) if level is None else stop <= F.col("weight") * F.lit(level)
        total, free, stopped, count = table_.agg(F.sum("source_size"), F.sum(F.when(~above, F.col("weight"))), F.coalesce(F.sum(F.when(above, stop)), F.lit(0)), F.count_if(above)).first()
        wanted = (total or 0) * share_percent / 100.0
        if not free or count == held:
            break
        level, held = max(level or 0.0, (wanted - stopped) / free), count
    target = stop.cast("double") if not free or level is None else F.least(stop.cast("double"), F.col("weight") * F.lit(level))
    return table_.select("source", "source_size", target.alias("target"))


def mix_plan(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """Every row of documents with __size, __source_size, __target and __copies, the number of times the mix takes it.

    Rows of one id are drawn alike, wherever and whenever they are. A null source is a source of its own, a null or
    blank text has size 0 and is taken as its source's rate says; an empty table gives an empty plan.
    """
    sized = documents.withColumn("__size", words(F.col(text_col)))
    targets = source_targets(sized.select(F.col(source_col).alias("source"), F.col("__size").alias("size")), **how)
    targets = targets.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    same = F.col(source_col).eqNullSafe(F.col("__of"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), same, "left").drop("__of")
    else:
        targets = targets.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("__salt", F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(SALTS)).cast("int"))
        joined = sized.join(targets, same & (F.col("__salt") == F.col("__part")), "left").drop("__of", "__part", "__salt")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    return joined.withColumn("__copies", (whole + F.when(draw(id_col) < rate - whole, 1).otherwise(0)).cast("int"))


def emit(plan: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of a plan as often as its __copies says."""
    return plan.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken")
    )


OP5_SQL = rf"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select source, source_size, cast(list_extract([{", ".join(map(str, WEIGHTS))}], cast((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as integer)) as bigint) as weight
  from totals
), tried as (
  select row_number() over o as place, {MOST} * source_size as stop, weight,
    (cast((select sum(source_size) from weighed) * {SHARE_PERCENT} as double) / 100.0::double
      - cast(coalesce(sum({MOST} * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as double))
      / cast(sum(weight) over (o rows between current row and unbounded following) as double) as level
  from weighed window o as (order by cast(source_size as double) / weight, source nulls last)
), final as (
  select level from tried where stop > weight * level order by place limit 1
), targets as (
  select source, source_size, least({MOST} * source_size::double, weight * coalesce((select level from final), 'infinity'::double)) as target from weighed
), rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 1.0::double end as rate,
    cast(('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) / {2**52}.0::double as u
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from rated
"""
