"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return the columns of
``documents``; nulls, empty texts and empty tables pass as the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import stash, table, tokenizer_path
from cellwright.llm.line_dedup import line_dedup
from cellwright.llm.mixing import poisson_mix
from cellwright.llm.ngram_join import grouped
from cellwright.llm.packing import best_fit_packing
from cellwright.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows dropped as near duplicates up to which their ids and text hashes are broadcast (16 bytes each, and the table's own).
BROADCAST_LOST = 2_000_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the importance resampling rejects."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"), seed=11).select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that 10 documents or more hold, but for their first occurrence; a document that had text and has none left goes."""
    kept = line_dedup(docs, min_docs=10, keep_first=True)
    left = kept.filter((F.col("__n_dropped") == 0) | (F.trim(F.col("text")) != ""))
    return left.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id (then text hash) of each component of near duplicates (five-word shingles, similarity 0.8).

    Texts without shingles are all kept; of rows with equal ids and texts one stays.
    """
    groups = grouped(docs, "doc_id", "text", words=5, top=4, bottom=5)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    groups = stash(groups.select("doc_id", "t", "n", "vertex", row.alias("row")), "grouped-rows")
    first = groups.filter("n > 0").groupBy("vertex").agg(F.min("row").alias("row")).select("row.__id", "row.__t")
    linked = groups.filter("n > 0").select("doc_id", "t").distinct()
    lost = linked.join(first, linked.doc_id.eqNullSafe(first["__id"]) & (linked.t == first["__t"]), "left_anti")
    lost = stash(lost.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")), "lost-rows")
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    # a bounded number of ids goes to the texts; more of them meet the texts in a shuffle
    few = lost.limit(BROADCAST_LOST + 1).count() <= BROADCAST_LOST
    kept = hashed.join(F.broadcast(lost) if few else lost, hashed.doc_id.eqNullSafe(lost["__id"]) & (hashed["__text"] == lost["__t"]), "left_anti")
    if groups.groupBy("doc_id", "t").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__text"])
    return kept.select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents so that all sources have equal shares of the rows, in a global shuffle."""
    return poisson_mix(docs, seed=17).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 ids."""
    return best_fit_packing(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The quality model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
