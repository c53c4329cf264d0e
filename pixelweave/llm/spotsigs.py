"""Document fingerprints from spot signatures, in DataFrame operations only.

A common word is an anchor; with it go the next content words (words that are no common words). A document's
fingerprint is its set of such chains, hashed. So that short texts, lists and other languages have anchors too, every
word is an anchor with the words that follow it. Texts of all sizes go by this one rule, so that any two compare.
Likeness is the Jaccard likeness of two sets; it is at most the smaller set's size over the larger's, so sets whose
sizes are too far apart need no comparison (``near_pairs`` partitions by size on that ground).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import stage, width

#: Common words of four languages.
ANCHORS = tuple(
    "a an the is was are be to of and in on at it that this with for "
    "der die das und ist ein eine von zu den dem des mit "
    "le la les un une et est du de des que qui pour dans "
    "el los las y es en por con una se no".split()
)
CHAIN = 2


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``name``: the distinct hashed chains of column ``text``, ascending; a null text has none.

    Words are lower-cased runs of letters and digits. Each step is a generated column, which the
    optimizer doesn't write into the functions over arrays that read it, to be worked out again for each element.
    """
    words, places, content = F.col(f"{name}_words"), F.col(f"{name}_places"), F.col(f"{name}_content")
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    df = df.select("*", F.inline(F.array(F.struct(split.alias(f"{name}_words")))))
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i)), lambda p: p.isNotNull())
    others = F.filter(words, lambda w: ~w.isin(*ANCHORS))
    df = df.select("*", F.inline(F.array(F.struct(spots.alias(f"{name}_places"), others.alias(f"{name}_content")))))
    # The k-th anchor at word p has p - k content words before it; its chain is the content words that follow.
    by_spot = F.transform(places, lambda p, k: F.hash(F.element_at(words, p + 1), F.slice(content, p - k + 1, F.lit(chain))))
    by_word = F.transform(words, lambda w, i: F.hash(F.slice(words, i + 1, F.lit(chain))))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.concat(by_spot, by_word)))).drop(f"{name}_words", f"{name}_places", f"{name}_content")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise((both / (F.size(a) + F.size(b) - both)).cast("double"))


def to_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def _bucket(bounds: list, value: Column) -> Column:
    """How many of the rising ``bounds`` are below ``value``: a binary search, as a fold over its steps."""
    top = 1
    while top * 2 <= len(bounds):
        top *= 2
    steps, edges = [top >> k for k in range(top.bit_length())], F.array(*[F.lit(b) for b in bounds])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(bounds)) & (F.try_element_at(edges, at + by) < value), at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def fingerprints(docs: DataFrame, chain: int = CHAIN, share: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / share) code points replaced by the first as many (or all) of the next
    document: descending doc_id, nulls last, texts ascending where doc_ids tie; after the last comes the first, and a
    single document is its own next one. A null text is empty; a text without words has an empty fingerprint, and two of
    these are alike. Other columns are not read; an empty table gives no rows. Documents are cut to ranges of doc_id, each with
    the first document of the range after it, so that no window spans the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * width(spark)
    found = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("bounds")).first().bounds
    bounds = sorted(set(found or []))
    # Ranges rise with the doc_id; the one of nulls comes below all.
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(_bucket(bounds, F.col("doc_id")) if bounds else F.lit(0))
    rows = rows.withColumn("range", at.cast("int"))
    # A range's first document is shown at the end of the range before it, in order: the next higher range.
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id").alias("top")
    tops = rows.groupBy("range").agg(F.max(first).alias("top"))
    heads = rows.join(F.broadcast(tops), "range").where(F.col("doc_id").eqNullSafe(F.col("top.doc_id"))).groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.col("range").desc())  # a row for each range
    wrap = F.max("range").over(Window.partitionBy()), F.min("range").over(Window.partitionBy())
    shown = heads.withColumn("range", F.coalesce(F.lag("range").over(order), wrap[1])).withColumn("shown", F.lit(1))
    both = rows.withColumn("shown", F.lit(0)).unionByName(shown)
    following = Window.partitionBy("range").orderBy("shown", F.col("doc_id").desc_nulls_last(), "text")
    n, m = F.length("text"), F.floor(F.length("text") / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m))
    both = both.withColumn("next_text", F.lead("text").over(following))
    both = with_signatures(both, "text", "sigs", chain).withColumn("next_sigs", F.lead("sigs").over(following))
    both = both.where("shown = 0").withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    both = with_signatures(both.drop("text", "next_text"), "edited", "edited_sigs", chain)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("sigs")).alias("fingerprint"), to_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.75, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints, named by their smallest doc_id, that are alike to ``threshold``.

    Equal fingerprints are one. Sets are partitioned by size in steps of 1 / threshold: a partner is in the same or a
    neighbouring partition. There, sets meet that have one of their rarest chains in common (as many of them as two
    sets alike to the threshold can't both miss).
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs", chain).groupBy("sigs").agg(F.min("doc_id").alias("id")).where(F.size("sigs") > 0)
    sets = stage(sets.withColumn("n", F.size("sigs")).withColumn("level", F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")), "spots")
    each = sets.select("id", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("freq"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    rank = F.row_number().over(Window.partitionBy("id").orderBy("freq", "sig"))
    keys = each.join(often, "sig").withColumn("rank", rank).join(sets.select("id", "n", "level"), "id").where(F.col("rank") <= prefix).select("id", "sig", "n", "level")
    left = keys.select(F.col("id").alias("a"), "sig", F.col("n").alias("na"), F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"), F.col("level").alias("own"))
    right = keys.select(F.col("id").alias("b"), "sig", F.col("n").alias("nb"), "level")
    alike = (F.col("nb") * threshold <= F.col("na")) & (F.col("na") * threshold <= F.col("nb")) & ((F.col("own") < F.col("level")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "level"]).where(alike).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness"))
    return near.where(F.col("likeness") >= threshold)
