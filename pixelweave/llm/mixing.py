"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. A source's documents are dealt to ranges of that key, each range is sorted, and
running sums of sizes come from the ranges' totals first and from inside a range after. A source is taken whole as
often as its budget holds it, and in the last epoch up to the document in which the budget runs out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import WORD

WEIGHTS = (3, 1, 2)
RANGES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size), a row for each source.

    Targets rise with their weights until a source meets ``most`` times its size; what is left goes on by weight. With
    sources ordered by the level at which they are full, the level at which all is given follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, none for each document
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("weight", weight).withColumn("full", full)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    summed = (
        ranked.withColumn("given", F.sum("full").over(order) - F.col("full"))
        .withColumn("lighter", F.sum("weight").over(order) - F.col("weight"))
        .withColumn("all_weight", F.sum("weight").over(Window.partitionBy()))
        .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    )
    level = (F.col("wanted") - F.col("given")) / (F.col("all_weight") - F.col("lighter"))
    # The first source that its level does not fill sets the level of all that follow.
    open_level = F.min(F.when(F.col("full") > level * F.col("weight"), F.struct(F.col("full") / F.col("weight"), level.alias("level")))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full") <= F.coalesce(open_level, F.lit(0.0)) * F.col("weight"), F.col("full"))
    return summed.withColumn("open_level", open_level).select(
        "source", "source_size",
        F.coalesce(target, F.least("full", F.col("open_level") * F.col("weight")), "full").alias("target"),
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) of every row, and the columns ``keep``.

    A null text has size 0; a null source is a source of its own, last in order; rows with a null or repeated doc_id are
    rows of their own, in order of doc_id, size and a hash of the text where keys tie. An empty table gives no rows. The same rows give the
    same mix whatever their order.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.xxhash64("text")
    sized = docs.select("doc_id", "source", size.alias("size"), tie.alias("tie"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    # Names for sources that joins and windows can both partition by, so that rows are shuffled once.
    sized = sized.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("named", F.col("source").isNotNull())
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    sized = sized.withColumn("key", key).withColumn("range", F.shiftright("key", 48 - RANGES.bit_length() + 1))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = ranges.withColumn("before", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    in_range = Window.partitionBy("name", "named", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("inside", F.sum("size").over(in_range) - F.col("size"))
    plan = before.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).selectExpr(
        "coalesce(b.source, '') as name", "b.source is not null as named", "b.range as range", "before", "source_size", "target"
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return summed.join(plan, ["name", "named", "range"]).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + extra).cast("long").alias("taken"),
        *[F.col(f"kept_{c}").alias(c) for c in keep if c not in ("doc_id", "source", "size")],
    )


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as key
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as full_size from sources),
summed as (
  select *, sum(full_size) over w - full_size as given, sum(weight) over w - weight as lighter, sum(weight) over () as all_weight,
         1.5::double * sum(source_size) over () as wanted
  from weighted window w as (order by full_size / weight, source nulls last)),
levels as (select *, (wanted - given) / (all_weight - lighter) as level from summed),
opened as (select *, arg_min(case when full_size > level * weight then level end, case when full_size > level * weight then full_size / weight end) over () as open_level from levels),
targets as (
  select source, source_size, case when open_level is null then full_size when full_size <= open_level * weight then full_size else open_level * weight end as target
  from opened),
placed as (
  select s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows unbounded preceding) - s.size as before
  from sized s join targets t on s.source is not distinct from t.source),
budgets as (
  select *, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from placed)
select doc_id, size, source_size, target::double as target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from budgets
"""
