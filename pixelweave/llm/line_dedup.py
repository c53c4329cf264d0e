"""Removal of repeated runs of lines, in DataFrame operations only.

Lines that hold words are a document's sequence of line IDs (hashes). Distributed prefix doubling sorts the suffixes of
all sequences: a round ranks them by twice as many lines, from a suffix's rank and that of the suffix half-way on. Suffixes
of one rank are an interval of the suffix array whose longest common prefix has at least the round's lines. Suffixes
alone in their interval, or too near their document's end for the round's lines, leave; rounds go on until none is left.

Each interval's first suffix, by place, keeps its lines, and the later ones lose the prefix they share. A run of m lines
that also starts earlier lies in intervals of 2^k <= m < 2^(k+1) lines twice, from its first line and up to its last,
so the union of what intervals delete is that of the maximal repeated runs. Only for runs so short that their words decide
whether they count (fewer than ``min_words`` lines may hold too few) does the exact number of lines matter: the lengths
up to ``min_words`` between the powers of two get intervals of their own, named by the ranks of their two overlapping halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import WORD, attach, stage, unstage

MIN_WORDS = 5
_LAST = (1 << 63) - 1
_RANGES = 1024
PLACE = ["did", "mark", "i"]


def _rank(suffixes: DataFrame, base: str, by: str, low: Column, high: Column, *more: Column) -> DataFrame:
    """(base, by, n, rank) and aggregates ``more``: ranks of the pairs (base, by) that more than one suffix has; rank orders by base, then by.

    ``base`` is a rank already, so a pair's is that plus the number of suffixes of the same base with a smaller ``by``.
    Running sums go over ranges of ``by`` first and inside a range after, so a base that many share is no single task's.
    """
    pairs = suffixes.groupBy(base, by).agg(F.count("*").alias("n"), *more).where("n > 1")
    others = [c for c in pairs.columns if c not in (base, by, "n")]
    span = F.greatest(F.lit(1.0), (high.cast("double") - low.cast("double")) / _RANGES)
    pairs = pairs.withColumn("range", F.floor((F.col(by).cast("double") - low.cast("double")) / span).cast("int"))
    ranges = pairs.groupBy(base, "range").agg(F.sum("n").alias("total"))
    before = ranges.withColumn("before", F.sum("total").over(Window.partitionBy(base).orderBy("range")) - F.col("total")).drop("total")
    inside = F.sum("n").over(Window.partitionBy(base, "range").orderBy(by)) - F.col("n")
    return pairs.withColumn("inside", inside).join(before, [base, "range"]).select(base, by, "n", *others, (F.col(base) + F.col("before") + F.col("inside")).alias("rank"))


def line_sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """did, mark, i (place among lines with words), no (line number), left (lines from here on), line (ID), reach.

    ``reach`` is the number of lines from here that hold ``min_words`` words; null where the document ends before. It is
    worked out inside the array, from as many shifted copies, so that no row of a line carries its document's array. Rows equal
    in did and mark become one before their lines are rows; most of them meet on the map side already.
    """
    lines = F.split("text", "\n", -1)
    with_words = F.transform(lines, lambda x, k: F.struct(F.xxhash64(x).alias("line"), k.alias("no"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    rows = docs.select("did", "mark", F.filter(with_words, lambda x: x["words"] > 0).alias("lines"))
    rows = rows.groupBy("did", "mark").agg(F.first("lines").alias("lines"))
    # A generated column is reckoned once; the functions over arrays below read it for each line.
    rows = rows.select("did", "mark", F.inline(F.array(F.struct(F.col("lines"), F.col("lines.words").alias("words"), F.size("lines").alias("size")))))
    shifted = [F.slice("words", k + 1, F.greatest(F.col("size") - k, F.lit(0))).alias(f"w{k}") for k in range(1, min_words)]

    def row(x, i):
        total, reach = x["words"], F.when(x["words"] >= min_words, 1)
        for k in range(1, min_words):
            total = total + x[f"w{k}"]
            reach = reach.when(total >= min_words, k + 1)
        return F.struct(i.alias("i"), x["lines"]["no"].alias("no"), (F.col("size") - i).alias("left"), x["lines"]["line"].alias("line"), reach.alias("reach"))

    rows = rows.select("did", "mark", F.transform(F.arrays_zip("lines", "words", *shifted), row).alias("rows"))
    return rows.select("did", "mark", F.inline_outer("rows")).where("line is not null")  # the inner form would reckon the array twice, to filter by it


def _later(runs: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(did, mark, i, lines): the suffixes in ``runs`` that are not the first, by place, of their interval ``keys``."""
    firsts = runs.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1")
    return attach(runs.select(*PLACE, *keys, "lines"), firsts, keys, total).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "lines")


def repeated_runs(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The table of lines, and (did, mark, i, lines): for each line at which repeated runs start that also start earlier, the most
    lines of an interval's prefix. ``docs``: did, mark, text.

    A round's number of lines is a column of its table, and ranges and hot keys go by the number of all lines: so all rounds are the
    same plan, whose code is made once on the driver and on each executor, however many rounds there are.
    """
    lines = stage(line_sequences(docs, min_words), "lines")
    total = lines.count()
    first = _rank(lines.select("line").withColumn("zero", F.lit(0).cast("long")), "zero", "line", F.lit(-(1 << 63)), F.lit(_LAST))
    # ``later``: whether the suffix is not the first of its interval; lines of round one tell that only where one line is enough.
    columns = [*PLACE, "left", "reach", "rank", "lines"]
    level = attach(lines, first, ["line"], total).select(*PLACE, "left", "reach", "rank", F.lit(1).alias("lines"), F.lit(False).alias("later"))
    level = stage(level, "suffixes")
    # Equal runs have equal words, so whether a run has enough of them (``reach``) holds for its whole interval.
    found, span = stage(_later(level.where("reach <= lines"), ["rank"], total), "later"), 1
    while not level.isEmpty():
        for length in range(span + 1, min(2 * span, min_words + 1)):
            half = level.select("did", "mark", (F.col("i") - (length - span)).alias("i"), F.col("rank").alias("next"))
            both = level.where((F.col("left") >= length) & (F.col("reach") <= length)).withColumn("lines", F.lit(length)).join(half, PLACE)
            found = stage(_later(both, ["rank", "next"], total), "later", found)
        # Only suffixes with lines enough for the next round, whose second half is in an interval too, go on.
        ahead = level.select("did", "mark", (F.col("i") - F.col("lines")).alias("i"), F.col("rank").alias("next"))
        pairs = stage(level.where("left >= 2 * lines").select(*columns).join(ahead, PLACE), "pairs")
        unstage(level)
        place = F.struct(*PLACE)
        halves = pairs.select(F.col("rank").alias("base"), "next", *PLACE)
        ranks = _rank(halves, "base", "next", F.lit(0), F.lit(total), F.min(place).alias("first"))
        ranked = attach(pairs, ranks.select(F.col("base").alias("rank"), "next", "n", "first", F.col("rank").alias("new")), ["rank", "next"], total)
        later = (place > F.col("first")).alias("later")
        level = stage(ranked.select(*PLACE, "left", "reach", F.col("new").alias("rank"), (F.col("lines") * 2).alias("lines"), later), "suffixes")
        unstage(pairs)
        found = stage(level.where("later and reach <= lines").select(*PLACE, "lines"), "later", found)
        span *= 2
    unstage(level)
    return lines, found.groupBy(*PLACE).agg(F.max("lines").alias("lines"))


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(did, mark, gone): the numbers of the lines to delete, for documents that have any; ``docs``: did, mark, text."""
    lines, runs = repeated_runs(docs, min_words)
    # Overlapping and adjoining runs of a document become one: the maximal stretches of repeated lines.
    order = Window.partitionBy("did", "mark").orderBy("i")
    before = F.max(F.col("i") + F.col("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(before >= F.col("i"), 0).otherwise(1)).withColumn("stretch", F.sum("new").over(order))
    stretches = runs.groupBy("did", "mark", "stretch").agg(F.min("i").alias("a"), F.max(F.col("i") + F.col("lines")).alias("b"))
    covered = stretches.select("did", "mark", F.explode(F.sequence("a", F.col("b") - 1)).alias("i"))
    return covered.join(lines.select(*PLACE, "no"), PLACE).groupBy("did", "mark").agg(F.collect_set("no").alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` less the deleted lines, and line_count and lines_removed.

    A line goes if a run of consecutive lines around it, with at least ``min_words`` words, also starts earlier: in a document with a
    smaller doc_id (nulls last; rows that share one, in order of a hash of their text) or earlier in the same one. Runs
    are judged on the input. Lines without words are no part of runs and stay. Rows equal in doc_id and text count as one
    and get the same result. Null texts stay null, with no lines; an empty text is one line. An empty table gives no rows.
    Lines are told apart by 64-bit hashes. Columns of ``docs`` may have any names but those two; where more than one is called
    ``text`` or ``doc_id`` in other cases of letters, Spark's own rules for such names hold.
    """
    did, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")
    gone = repeated_lines(docs.select(did.alias("did"), mark.alias("mark"), "text"), min_words)
    # All columns travel in one struct, so that none can clash with the names used here.
    held = docs.select(did.alias("did"), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    joined = held.join(gone, ["did", "mark"], "left")
    # A generated column is split once; the functions over arrays below read it for each line.
    joined = joined.select("held", "gone", F.inline(F.array(F.struct(F.split("held.text", "\n", -1).alias("lines")))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda k: F.element_at("lines", k + 1)), "\n")
    columns = [F.when(F.col("gone").isNull(), F.col("held.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"held.`{c}`") for c in docs.columns]
    return joined.select(
        *columns, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("line_count"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed")
    )


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the kept text; a null text is empty)."""
    out = line_dedup(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("line_count")).cast("long").alias("n_lines"),
                      F.greatest("lines_removed", F.lit(0)).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Every line of a repeated run of 5 words and more lies in one of at most 5 lines: from the last start at or before the line with
#: 5 words up to the run's end, or, if that start is the line's own, in the first few lines. So lengths 1 to 5 decide all.
ORACLE = """
with split as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
numbered as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as no from split),
worded as (
  select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from numbered),
sequence as (
  select *, row_number() over (partition by doc_id order by no) as i from worded where words > 0),
ahead as (
  select doc_id, i, [line, lead(line, 1) over w, lead(line, 2) over w, lead(line, 3) over w, lead(line, 4) over w] as next_lines,
    [words, lead(words, 1) over w, lead(words, 2) over w, lead(words, 3) over w, lead(words, 4) over w] as next_words
  from sequence window w as (partition by doc_id order by i)),
lengths as (select doc_id, i, next_lines, next_words, unnest(range(1, 6)) as m from ahead),
runs as (
  select doc_id, i, m, array_to_string(next_lines[1:m], chr(10)) as run from lengths where next_words[m] is not null and list_sum(next_words[1:m]) >= 5),
placed as (select *, first_value((doc_id, i)) over (partition by m, run order by doc_id, i) as first_place from runs),
covered as (select distinct doc_id, unnest(range(i, i + m)) as i from placed where (doc_id, i) <> first_place),
gone as (select doc_id, no from covered join sequence using (doc_id, i)),
kept as (
  select doc_id, string_agg(line, chr(10) order by no) as kept from numbered anti join gone using (doc_id, no) group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
"""
