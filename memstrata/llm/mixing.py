"""Mixing sources to target weights by Pareto order sampling.

Each document is expected ``target / source_size`` times its preference in
the mix. The whole part of that is certain copies; of the remainder a sample
of fixed size is drawn with unequal probabilities: documents are ranked by
their random odds divided by their inclusion odds, and the first are taken
until the source's words are full. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memstrata.session import durable

from .common import fresh, hex_unit, table, word_count

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
STEPS = 4096
SEED = 7


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight of all words, none above ``max_times`` its source.

    Sources come by code point, null last, and take the weights in turn.
    Sharing again what capped sources leave, by weight, until none is above,
    ends at target = min(cap, weight x level), with one level for all: the
    sources are sorted by cap / weight, and the level is read off running
    sums. One row per source: the summary of the corpus, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    listed = totals.withColumn("turn", (F.row_number().over(by_name) - 1) % n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn").cast("int") + 1)
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (listed.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_times).cast("double"))
            .withColumn("all_size", F.sum("source_size").over(everything))
            .withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("level_here", (F.col("all_size") - F.col("before")) / (F.col("all_weight") - F.col("weight_before")))
            .withColumn("level", F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.col("level_here"))).over(everything))
            .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def _times(target: Column, liked_size: Column, liked: Column, max_times: int) -> Column:
    """Expected copies of a row."""
    return F.least(F.lit(float(max_times)), F.coalesce(F.try_divide(target, liked_size), F.lit(0.0)) * liked)


def _rank(times: Column, u: Column) -> Column:
    """Pareto rank of a row: q = random odds / inclusion odds, as q / (1 + q); null where nothing is left to draw."""
    part = times - F.floor(times)
    q = F.try_divide(F.try_divide(u, 1 - u), F.try_divide(part, 1 - part))
    return F.when(part > 0, F.try_divide(q, 1 + q))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             preference: Column | None = None, weights: Sequence[int] = WEIGHTS, max_times: int = MAX_TIMES,
             seed: int = SEED, steps: int = STEPS) -> DataFrame:
    """All rows of ``docs`` with source_size, target, size and copies (how often the mix takes the row).

    ``preference`` scales a document's expected copies against the others of
    its source (positive; null and absent: 1); no row is expected more than
    ``max_times`` times. A null text has size 0 and is taken as often as its
    rank says, which changes no sum; a null source is a source of its own; a
    source without words has target 0 and is not taken. Ties, null ids and
    repeated rows share one random number and are taken together. An empty
    table gives an empty result. Clashing names of ``docs`` are kept: the new
    columns get underscores in front.

    Only (source, rank, words) is shuffled, as sums by source and step of the
    rank; rows of one step of one source meet, a ``steps``-th of it. Sources
    of any share of the rows are thereby split.
    """
    size, total, target, copies = (fresh(docs, x) for x in ("size", "source_size", "target", "copies"))
    chance = hex_unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))
    liked = F.lit(1.0) if preference is None else F.coalesce(F.when(preference > 0, preference.cast("double")), F.lit(1.0))
    # the given row is carried as one value, so that no name of its own meets a name of ours
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(f"`{source}`").alias("source"),
                        word_count(F.col(f"`{text}`")).alias("words"), chance.alias("u"), liked.alias("liked"))
    facts = durable(sized.drop("given"))
    totals = facts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum(F.col("words") * F.col("liked")).alias("liked_size"))
    liked_size = totals.select(F.col("source").alias("__of"), "liked_size")
    goal = targets(totals.select("source", "source_size"), weights, max_times)
    goal = durable(goal.join(liked_size, F.col("source").eqNullSafe(F.col("__of"))).drop("__of"))

    ranked = facts.join(goal, facts["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    ranked = ranked.withColumn("__times", _times(F.col("target"), F.col("liked_size"), F.col("liked"), max_times))
    ranked = ranked.withColumn("__whole", F.floor("__times").cast("long")).withColumn("__rank", _rank(F.col("__times"), F.col("u")))
    step = F.floor(F.col("__rank") * steps)
    whole = ranked.groupBy("source").agg(F.sum(F.col("words") * F.col("__whole")).alias("certain"), F.first("target").alias("target"))
    sums = ranked.where("__rank is not null").groupBy("source", step.alias("step")).agg(F.sum("words").alias("words"))
    run = Window.partitionBy("source").orderBy("step")
    sums = sums.withColumn("upto", F.sum("words").over(run))
    joined = sums.join(whole.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    joined = joined.withColumn("room", F.col("target") - F.col("certain"))
    edge = (joined.where("upto >= room").groupBy("source").agg(F.min_by(F.struct("step", (F.col("room") - F.col("upto") + F.col("words")).alias("room")), "step").alias("e"))
            .select("source", F.col("e.step").alias("step"), F.col("e.room").alias("room")))
    edge = durable(edge).withColumnsRenamed({"source": "__of", "step": "edge_step"})
    # inside the step where a source fills up: take ranks while that brings its words nearer to the target
    inside = (ranked.where("__rank is not null").withColumn("step", step)
              .join(edge, F.col("source").eqNullSafe(F.col("__of")) & (F.col("step") == F.col("edge_step")))
              .groupBy("source", "room", "__rank").agg(F.sum("words").alias("words"))
              .withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("__rank")))
              .groupBy("source").agg(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("room"), F.col("__rank"))).alias("last")))
    cut = (goal.select(F.col("source").alias("__of"), F.col("source_size").alias("__total"), "target", "liked_size")
           .join(edge.withColumnRenamed("__of", "__es"), F.col("__of").eqNullSafe(F.col("__es")), "left").drop("room")
           .join(inside, F.col("__of").eqNullSafe(F.col("source")), "left")
           .select("__of", "__total", F.col("target").alias("__goal"), F.col("liked_size").alias("__liked_size"),
                   F.when(F.col("edge_step").isNull(), F.lit(2.0))
                   .otherwise(F.coalesce("last", F.col("edge_step") / steps)).alias("__cut"),
                   (F.col("edge_step").isNotNull() & F.col("last").isNull()).alias("__open")))
    cut = durable(cut)
    with_cut = sized.join(cut, F.col("source").eqNullSafe(F.col("__of")))
    times = _times(F.col("__goal"), F.col("__liked_size"), F.col("liked"), max_times)
    rank = _rank(F.col("__times"), F.col("u"))
    taken = F.when(F.col("__open"), rank < F.col("__cut")).otherwise(rank <= F.col("__cut"))
    return (with_cut.withColumn("__times", times)
            .withColumn("__copies", F.floor("__times").cast("long") + F.when(taken, 1).otherwise(0).cast("long"))
            .select(*[F.col(f"given.`{c}`") for c in docs.columns], F.col("words").alias(size), F.col("__total").alias(total),
                    F.col("__goal").alias(target), F.col("__copies").alias(copies)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it.

    Nulls, empty texts, ties, repeated rows and clashing names are as in
    ``plan_mix``; an empty table gives an empty mix.
    """
    planned = plan_mix(docs, **options)
    copies = planned.columns[-1]
    copy = fresh(planned, "copy")
    return (planned.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op1(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as ubigint)::double + 0.5) / 4503599627370496.0 as u
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
listed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight,
         (source_size * 3)::double as cap
  from totals),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level_here
  from listed window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
goal as (
  select source, source_size, least(cap, weight * max(case when level_here * weight <= cap then level_here end) over ()) as target
  from levels),
rated as (
  select s.doc_id, s.source, s.size, g.source_size, g.target,
         least(3.0, coalesce(g.target / nullif(g.source_size, 0), 0.0)) as times, s.u
  from sized s join goal g on s.source is not distinct from g.source),
odds as (
  select *, floor(times) as whole, (u / (1 - u)) / ((times - floor(times)) / (1 - (times - floor(times)))) as o
  from rated),
ranked as (
  select *, case when times > whole then o / (1 + o) end as rnk,
         target - sum(whole * size) over (partition by source) as room
  from odds),
filled as (
  select *, sum(case when rnk is not null then size else 0 end) over (partition by source order by rnk nulls last) as upto,
         sum(case when rnk is not null then size else 0 end) over (partition by source, rnk) as here
  from ranked)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(size * (whole + case when rnk is not null and upto - here / 2.0 <= room then 1 else 0 end) as bigint) as taken
from filled
"""
