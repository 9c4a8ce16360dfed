"""A corpus pipeline of five training-data operators; each stage's rows are written and read again by the next.

    quality rules -> one document of each near-duplicate group -> pseudonyms -> mixture of sources -> packed sequences

Each stage takes (spark, docs, sf_dir) and works on all of docs.  All but the last return the columns of `documents`, and any others
that docs has, whatever their names: a row travels as one struct beside what a stage computes.

Rows are told apart by id, text, source and language; rows that agree in these are copies, of which the near-duplicate stage keeps
one, and of which the mixture takes all shares from one.  Rows of equal (or null) id and other text are documents of their own.  Null and empty
texts fail the quality rules; in the other stages they are documents of no words (linked with nothing, unchanged, never mixed, packed as
an end token).  Very long texts are read whole.  Of a group of near duplicates the smallest id stays, a null id only if all are null.
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.llm import jaccard, mixing, packing, pii, quality
from tempograph.llm.common import stored, table, words


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), key (what tells rows apart, in the order of ids, null ids last), text, source."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    of = lambda c: F.col("row").getField(c)
    key = F.struct(of("doc_id").isNull().alias("none"), F.coalesce(of("doc_id"), F.lit(0)).alias("id"), F.xxhash64(of("text"), of("source"), of("lang")).alias("content"))
    return docs.select(row.alias("row")).select("row", key.alias("key"), of("text").alias("text"), of("source").alias("source"), of("lang").alias("lang"))


def first_of_copies(rows: DataFrame) -> DataFrame:
    """One row of each key; after a join by key no further shuffle."""
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy(F.lit(0)))).where("copy = 1")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules fail, or that are outliers of their language and source, go."""
    rows = keyed(docs)
    return quality.quality_rules(rows, keep=("row",)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    rows = keyed(docs)
    found = jaccard.near_duplicates(rows.select("key", "text"), id_col="key")
    stays = found.where("id = component_id").select("id").distinct()
    return first_of_copies(rows.join(stays, rows["key"] == stays["id"])).select("row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(pii.pseudonymise(docs, pii.key_of(spark), kinds_col=None))


#: a word and the white space after it
WORD = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"


def words_from(text: Column, first: Column, n: Column) -> Column:
    """n words of text from the first (from 0), with the white space between them."""
    part = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), (first + 1).cast("int"), n.cast("int"))
    return F.regexp_replace(F.array_join(part, ""), r"[\x20\x09-\x0D]+$", "")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document or, where a block ends inside it, a run of its words."""
    rows = keyed(docs)
    sizes = rows.select(F.col("key").alias("id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    documents, parts = mixing.pieces(stored(sizes, "mix_sizes"))
    runs = parts.groupBy("source", "at", "size", "epoch").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"))
    runs = runs.select(F.col("source").alias("s"), F.col("at").alias("a"), F.col("size").alias("z"), F.struct("from_word", "to_word").alias("run"))
    on = documents["source"].eqNullSafe(F.col("s")) & (documents["at"] == F.col("a")) & (documents["size"] == F.col("z"))
    taken = documents.join(runs, on).groupBy("id").agg(F.collect_list("run").alias("runs"), F.first("size").alias("size"))
    once = first_of_copies(rows.select("row", "key").join(taken, F.col("key") == F.col("id"))).select("row", "size", F.explode("runs").alias("run"))
    n = F.col("run.to_word") - F.col("run.from_word")
    text = F.when(n == F.col("size"), F.col("row.text")).otherwise(words_from(F.col("row.text"), F.col("run.from_word"), n))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return with_length(once.select(*columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", source_mixture), ("packing", packing_stage)]

#: tokenizers and the operators' hashes aren't SQL; tests hold the run against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
