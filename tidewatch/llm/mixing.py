"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, read_table, word_count, written

SEED = 17
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Seeded order of documents: MD5 over seed, id and the text's MD5. Equal rows have equal keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def cyclic_weights(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """`sources` (one row per source) with a column `weight`: the given weights in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(turn, ((place - 1) % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, budget: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to `sources` (source, size, weight).

    The budget is shared by weight; a source above `max_epochs` times its size is clamped there and what it can't take is
    shared again among the others, until none is above. One aggregate row goes to the driver a round. Where even all
    clamps together hold less than the budget, every target is its clamp.
    """
    cap, weight = F.col("size") * float(max_epochs), F.col("weight")
    left, free, clamped = float(budget), None, -1
    while True:
        over = F.lit(False) if free is None else cap * F.lit(free) < F.lit(left) * weight
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(weight)), F.count(F.when(over, 1))).first()
        taken, open_weight, n = row[0] or 0.0, row[1] or 0.0, row[2]
        if n == clamped:
            break
        clamped, left, free = n, float(budget) - taken, open_weight
        if not free:
            return sources.withColumn("target", cap)
    return sources.withColumn("target", F.when(over, cap).otherwise(F.lit(left) * weight / F.lit(free)))


def mix_plan(sized: DataFrame, max_epochs: int = MAX_EPOCHS, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """What each source gives, from `sized` (source, size, key): one row per source.

    Columns: source, source_size, target, whole (repetitions of every document), cut_key and part. The remaining
    fraction of a repetition goes to the documents in order of `key`: below `cut_key` a document is taken once more,
    at `cut_key` `part` of its words are (rows of equal key share what is left evenly), above it nothing.

    Only the 4096 leading-digit buckets of a source are summed; rows are ordered only inside the one bucket in which
    the source's cut falls.
    """
    buckets = written(sized.groupBy("source", F.substring("key", 1, 3).alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    sources = written(cyclic_weights(buckets.groupBy("source").agg(F.sum("size").alias("size")), weights), "mix-sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    plan = (water_fill(sources, total, max_epochs).withColumn("goal", goal)
            .withColumn("whole", F.when(F.col("size") > 0, F.expr("goal div size")).otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", F.col("goal") - F.col("whole") * F.col("size"))
            .select("source", F.col("size").alias("source_size"), "target", "whole", "rest"))
    plan = written(plan, "mix-plan")

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reach = buckets.withColumn("upto", F.sum("size").over(by_bucket))
    edge = (reach.alias("b").join(plan.alias("p"), same("b.source", "p.source"))
            .where("p.rest > 0 and b.upto - b.size <= p.rest and p.rest < b.upto")
            .select(F.col("b.source").alias("at_source"), F.col("b.bucket").alias("at_bucket"), F.expr("p.rest - (b.upto - b.size)").alias("inside")))
    edge = written(edge, "mix-edges")
    near = (sized.withColumn("bucket", F.substring("key", 1, 3)).alias("s")
            .join(edge.alias("e"), same("s.source", "e.at_source") & (F.col("s.bucket") == F.col("e.at_bucket")))
            .groupBy("s.source", "s.key", "e.inside").agg(F.sum("s.size").alias("size"), F.count(F.lit(1)).alias("rows")))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (near.withColumn("upto", F.sum("size").over(by_key)).where("upto - size <= inside and inside < upto")
            .select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.expr("(inside - (upto - size)) div rows").alias("part")))
    joined = plan.alias("p").join(cuts.alias("c"), same("p.source", "c.cut_source"), "left")
    return written(joined.select(F.col("p.source").alias("source"), "source_size", "target", "whole",
                                 F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("part", F.lit(0)).cast("long").alias("part")), "mix-cuts")


def taken_words(size: Column, key: Column) -> Column:
    """Words taken of a document beside its `mix_plan` row."""
    once_more = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.least(size, F.col("part"))).otherwise(0)
    return (F.col("whole") * size + once_more).cast("long")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Words that a mix takes of each document: doc_id, source, size, source_size, target, taken.

    A size is the number of words of the whole text (null or empty: 0). Sources share all sizes by weight, at most
    `max_epochs` times their own size. Each source's taken words add up to its target rounded, but for fewer words
    than there are rows equal to the one at the cut. A null source is a source of its own; null ids and repeated rows
    are ordinary rows (equal rows get equal shares at the cut); an empty table gives no rows. The same rows and seed
    give the same mix. Other columns are ignored.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                                order_key(F.col(id_col), F.col(text_col), seed).alias("key")), "mix-sized")
    plan = mix_plan(sized, max_epochs, weights)
    return (sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
            .select("s.doc_id", F.col("s.source").alias("source"), F.col("s.size").alias("size"), "source_size", "target",
                    taken_words(F.col("s.size"), F.col("s.key")).alias("taken")))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of `docs` as often as its whole repetitions say, columns unchanged.

    A document at its source's cut whose last repetition is fractional is repeated whole if at least half of it is
    taken, else not. Documents without words are kept once, for they weigh nothing. Cases as in `mix_sources`.
    """
    size, key, own, times = (fresh(docs, x) for x in ("mix_size", "mix_key", "mix_source", "mix_times"))
    keyed = docs.withColumns({size: word_count(F.col(text_col)), key: order_key(F.col(id_col), F.col(text_col), seed)})
    sized = written(keyed.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(key).alias("key")), "mix-sized")
    plan = mix_plan(sized, max_epochs, weights)
    plan = plan.select(F.col("source").alias(own), F.struct("whole", "cut_key", "part").alias(times))
    part = F.when(F.col(key) < F.col(times).cut_key, 1).when((F.col(key) == F.col(times).cut_key) & (F.col(times).part * 2 >= F.col(size)), 1).otherwise(0)
    copies = F.when(F.col(size) == 0, 1).otherwise(F.col(times).whole + part).cast("int")
    joined = keyed.join(plan, F.col(source_col).eqNullSafe(F.col(own)))
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
filled AS (
  SELECT *, {MAX_EPOCHS}.0::DOUBLE * size AS cap, (SELECT sum(size) FROM sources)::DOUBLE
         - coalesce(sum({MAX_EPOCHS}.0::DOUBLE * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
         sum(w::DOUBLE) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, row_number() OVER o AS place
  FROM sources WINDOW o AS (ORDER BY size / w, source NULLS LAST)),
level AS (SELECT r, free, place FROM filled WHERE cap * free >= r * w ORDER BY place LIMIT 1),
targets AS (
  SELECT f.source, f.size AS source_size, CASE WHEN f.place < l.place THEN f.cap ELSE l.r * f.w / l.free END AS target FROM filled f, level l),
plan AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.goal - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) - sum(s.size) OVER (PARTITION BY s.source, s.key) AS before,
         count(*) OVER (PARTITION BY s.source, s.key) AS same
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN before + same * size <= rest THEN size ELSE least(size, greatest(rest - before, 0)::BIGINT // same) END)::BIGINT AS taken
FROM ordered
"""
