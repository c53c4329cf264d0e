"""The corpus pipeline: toxicity, line dedup, n-gram near duplicates, source mixing and packing, a written table between each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import WORD, attach, stage
from pixelweave.llm.line_dedup import line_dedup
from pixelweave.llm.mixing import mix_sources
from pixelweave.llm.ngram_join import ngram_components
from pixelweave.llm.packing import pack
from pixelweave.llm.tokens import vocabulary
from pixelweave.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go.

    Null, empty and wordless texts stay; rows that repeat or share a doc_id are judged by their own text. Columns beside those
    of documents go; an empty table gives no rows. Labels may be empty or contradict each other (then toxic counts).
    """
    return drop_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; so does a document that loses lines and has no word left.

    Null, empty and wordless texts lose no lines and stay. Rows equal in doc_id and text count as one and stay both, alike. Columns
    beside those of documents go; an empty table gives no rows.
    """
    out = line_dedup(docs.select(*COLUMNS))
    return _documents(out.where((F.col("lines_removed") <= 0) | (F.regexp_count("text", F.lit(WORD)) > 0)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest doc_id (nulls last), then the smallest hash of its text.

    Rows equal in doc_id and text count as one, and one of them stays. Rows that share a doc_id or have none but differ in text
    are rows of their own. Null, empty and wordless texts have no near duplicates, so they stay. Columns beside those of
    documents go; an empty table gives no rows.
    """
    did = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("did")
    found = stage(ngram_components(docs, mark=True).select("*", did), "near")
    total, place = found.count(), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    firsts = found.where("set_id is not null").groupBy("set_id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    judged = attach(found.where("set_id is not null"), firsts, ["set_id"], total).select("did", "mark", (place != F.col("first")).alias("lost"))
    judged = judged.withColumn("copies", F.lit(True)).union(found.where("set_id is null").select("did", "mark", F.lit(False), F.lit(False)))
    decided = judged.groupBy("did", "mark").agg(F.max("lost").alias("lost"), F.max("copies").alias("copies"), F.count("*").alias("n"))
    rows = attach(docs.select(*COLUMNS, did, F.xxhash64("text").alias("mark")), decided, ["did", "mark"], total).where("not lost")
    repeated = rows.where("copies and n > 1").dropDuplicates(["did", "mark"])
    return rows.where("not (copies and n > 1)").unionByName(repeated).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and as many of its first words as the mix takes beyond that.

    The mix takes words, so texts without words go here. A null source is a source of its own; rows that repeat or share a doc_id
    are rows of their own. Columns beside those of documents go; an empty table gives no rows.
    """
    rows = mix_sources(docs, keep=("text", "lang")).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    times = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0)))).withColumn("rest", F.when(F.col("copy") > whole, rest))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("rest")), " ")
    return _documents(times.withColumn("text", F.when(F.col("rest").isNull(), F.col("text")).otherwise(cut)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its sequence and offset; a null text is one end mark, an empty table gives no rows."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), 2048, cache=100_000)  # workers live on through all stages


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram near duplicates", without_near_duplicates),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: A learned model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
