"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Each source has a share of all words and a weight schedule over training time t in [0, 1].  The schedule is a straight
line from ``start`` to ``2 - start`` (mean 1), times the source's target, so its integral is the demand
that the source has met by time t: D(t) = target * (start * t + (1 - start) * t * t).  The source's documents, in a
fixed shuffled order and as many passes as the demand up to t = 1 needs, fill that demand one after another; a pass of a document
is placed where the demand reaches its first word, by inverting D in closed form.  The stream of passes is then
range-sorted by position.

Targets.  Sources sorted by code point (null last) weigh 1, 2, 3 and so on, repeating.  They share the words of all
documents by weight; a target stops at ``most_passes`` = 3 times its source's words, and the excess is shared again by
weight until none is above.  That limit is a water level: the target is the smaller of the cap and level * weight,
and the level follows in one step from the sources sorted by cap / weight.

Takes.  The demand up to t = 1, rounded to words, is met by whole passes over the source and one last pass that ends inside one
document, so a source's taken words equal its rounded target and no document gives more than its size three times.

Scale.  A running count of words over a source that may hold a third of all rows isn't one window: rows fall into
16 ** ``FINE`` buckets of their source's shuffled order; words are summed by bucket before the shuffle, the
sums are accumulated over the buckets, and windows run within buckets only.  Bucket numbers come from two levels of
order prefixes, so the accumulation over buckets is itself split by source and prefix.  Sources may be as many as web hosts: their ranks and
running sums are made in range partitions (``running``), and only a row a partition is ever in one window.

Defined cases: null and empty texts have size 0 and are taken 0 times 0 words; null is a source of its own, last;
repeated rows and ids are documents each; documents without doc_id are shuffled by their text; sources of size 0 get target 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, pinned, table

NAME = "op2_curriculum_mixing"

MOST_PASSES = 3
#: Hex digits of the shuffled order in a coarse and a fine bucket: 16 ** 2 coarse, 16 ** 3 fine buckets a source.
COARSE, FINE = 2, 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and key (the shuffled order: md5 of the id, or of the text where that is null)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")).cast("binary")).alias("key"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Sums of all rows before each one in an order: new column -> expression to sum.

    Rows are dealt out in ranges of the order, and a window within each range is raised by the sums of the ranges before it.
    """
    ranged = pinned(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.select("*", *(F.coalesce(F.sum(F.expr(x)).over(inside), F.lit(0)).alias(f"_{name}") for name, x in sums.items()))
    parts = ranged.groupBy(F.col("_part").alias("_of")).agg(*(F.sum(F.expr(x)).alias(name) for name, x in sums.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select("_of", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}_before") for name in sums))
    found = found.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return found.select(*rows.columns, *((F.col(f"_{name}") + F.col(f"_{name}_before")).alias(name) for name in sums))


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size -> with weight and target."""
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = running(by_source, by_name, {"rank": "1"})
    caps = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most_passes).alias("cap"))
    filled = pinned(running(caps, [F.col("cap") / F.col("weight"), *by_name], {"full": "cap", "lighter": "weight"}))
    every = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, open_ = F.lit(every["size"] or 0), F.lit(every["weight"] or 0) - F.col("lighter")
    level = (total - F.col("full")) / open_  # if all sources before this one are at their caps
    at = filled.where(F.col("weight") * level <= F.col("cap")).agg(F.min(F.struct("full", open_.alias("open"))).alias("at")).first()["at"]
    cap = F.col("cap").cast("double")
    share = F.col("weight") * ((total - F.lit(at.full)).cast("double") / F.lit(at.open)) if at else cap
    return filled.select("source", "source_size", "weight", F.least(share, cap).alias("target"))


def placed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = MOST_PASSES) -> DataFrame:
    """One row a document: doc_id, source, size, key, source_size, weight, target, demand (up to t = 1, in words), passes (whole passes), base (words of the source before it) and taken."""
    rows = pinned(sizes(docs).select("*", F.substring("key", 1, COARSE).alias("coarse"), F.substring("key", 1, FINE).alias("fine")))
    fine = rows.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("words"))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    plan = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_passes)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("source", "coarse", F.coalesce(F.sum("words").over(earlier("source").orderBy("coarse")), F.lit(0)).alias("coarse_base"))
    fine = fine.select("source", "coarse", "fine", F.coalesce(F.sum("words").over(earlier("source", "coarse").orderBy("fine")), F.lit(0)).alias("fine_base"))
    coarse = coarse.toDF("coarse_source", "coarse_key", "coarse_base")
    table_of = fine.join(coarse, F.expr("source <=> coarse_source and coarse = coarse_key")).select("source", "fine", (F.col("coarse_base") + F.col("fine_base")).alias("bucket_base"))
    plan = plan.withColumnRenamed("source", "plan_source")
    table_of = table_of.join(plan, F.expr("source <=> plan_source")).select(F.col("source").alias("bucket_source"), F.col("fine").alias("bucket"), "bucket_base", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "fine").orderBy("key", "size", F.col("doc_id").isNull(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "source", "fine", "size", "key", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside"))
    found = rows.join(table_of, F.expr("source <=> bucket_source and fine = bucket")).select("doc_id", "source", "size", "key", "source_size", "weight", "target", F.round(met(F.lit(1.0), F.col("target"), start_of(F.col("weight")))).cast("long").alias("demand"), (F.col("bucket_base") + F.col("inside")).alias("base"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.expr("demand div greatest(source_size, 1)"))).otherwise(0).cast("long")
    last = F.col("demand") - F.col("passes") * F.col("source_size")  # words of the pass that isn't whole
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("base")))
    return found.withColumn("passes", passes).withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))


def start_of(weight: Column) -> Column:
    """Where a source's schedule starts: light sources early (1.5 down to 0.5), heavy ones late; always above 0, so demand grows."""
    return F.greatest(F.lit(0.5), 2.0 - 0.5 * weight.cast("double"))


def met(t: Column, target: Column, start: Column) -> Column:
    """Words that a source's schedule demands up to time t: its integral."""
    return target * (start * t + (1.0 - start) * t * t)


def position(done: Column, target: Column, start: Column) -> Column:
    """The time at which a source's demand reaches ``done`` words: met(t) = done, solved for t."""
    share = F.when(target > 0, F.least(F.lit(1.0), done / target)).otherwise(F.lit(0.0))
    bend = 1.0 - start
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 4.0 * bend * share))
    return F.when(F.abs(bend) < 1e-12, share).otherwise(2.0 * share / (start + root))


def stream(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = MOST_PASSES) -> DataFrame:
    """The training stream: a row for each pass over a document, with pass_no, words (that this pass takes, from the text's start) and position, range-sorted by position."""
    found = placed(docs, weights, most_passes).where("taken > 0")
    found = found.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken + size - 1) div size - 1"))))
    found = found.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass_no") * F.col("size")))
    done = F.col("pass_no") * F.col("source_size") + F.col("base")
    found = found.withColumn("position", position(done.cast("double"), F.col("target"), start_of(F.col("weight"))))
    return found.orderBy("position", "key", "pass_no").select("doc_id", "source", "size", "source_size", "target", "taken", "pass_no", "words", "position")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = MOST_PASSES) -> DataFrame:
    """Per document: its size, its source's size and target, the words taken, and the position of its first pass (null where none is)."""
    found = placed(docs, weights, most_passes)
    first = position(F.col("base").cast("double"), F.col("target"), start_of(F.col("weight")))
    found = found.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, first).alias("first_position"), "key")
    return found.orderBy("first_position", "key").drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


ORACLE_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), text, '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [1, 2, 3][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as weight, source_size * 3 as cap from s),
f as (select *, sum(source_size) over () as total,
  coalesce(sum(cap) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as full_,
  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as open_ from w),
l as (select min((total - full_, open_)) as x, min(case when weight * ((total - full_)::double / open_) <= cap then {'full_': full_, 'open_': open_} end) as lvl from f),
t as (select source, source_size, weight, greatest(0.5, 2.0 - 0.5 * weight::double) as start, case when lvl is null then cap::double else least(cap::double, weight * ((total - lvl.full_)::double / lvl.open_)) end as target from f, l),
p as (select d.doc_id, d.size, t.source_size, t.target, t.start, cast(round(t.target * (t.start * 1.0::double + (1.0 - t.start) * 1.0::double * 1.0::double)) as bigint) as demand,
  cast(coalesce(sum(d.size) over (partition by d.source order by d.key, d.size, d.doc_id nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as base
  from d join t on d.source is not distinct from t.source),
q as (select *, case when source_size > 0 then demand // greatest(source_size, 1) else 0 end as passes from p),
r as (select *, cast(passes * size + greatest(0, least(size, demand - passes * source_size - base)) as bigint) as taken,
  case when target > 0 then least(1.0::double, base::double / target) else 0.0::double end as share from q)
select doc_id, size, source_size, target, taken, round(case when taken > 0 then
  case when abs(1.0 - start) < 1e-12 then share else 2.0 * share / (start + sqrt(greatest(0.0::double, start * start + 4.0 * (1.0 - start) * share))) end end, 9) as first_position from r
"""
