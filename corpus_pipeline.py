"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go; lines that many documents have stay in one; of each group of near duplicates the smallest
id stays; documents that benchmark items contaminate go; what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontaminate, linededup, ngramjoin, toxicity
from trackloom.llm.common import arrow_batches, checkpointed, remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't more likely toxic than not, with the columns of documents; the model is fitted to labelled rows of this stage's input."""
    arrow_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(~toxicity.rejects()).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of at least 40 code points that 5 documents have, but for the largest id; n_chars follows."""
    arrow_batches(spark)
    out = linededup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of similarity 0.8 connect, and those without links.

    Of rows that share that smallest id one stays, the first by its text's hash. Rows with a null id have no links.
    """
    arrow_batches(spark)
    linked = checkpointed(ngramjoin.join(docs).where("n_links > 0").groupBy(F.col("doc_id").alias("linked")).agg(F.min("class_id").alias("root")))
    docs = docs.select(*COLUMNS)
    alone = docs.join(linked, F.col("doc_id") == F.col("linked"), "left_anti")
    roots = docs.join(linked.where("linked = root"), F.col("doc_id") == F.col("linked"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return alone.unionByName(roots.withColumn("place", place).where("place = 1").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover less than a twentieth of the words; their texts stay as they are."""
    arrow_batches(spark)
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, as little-endian unsigned 32-bit integers, their number, and the digest of their decoding; other columns don't go on."""
    import public_tokenizers

    arrow_batches(spark)
    out = bpe.encode(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A fitted model has no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's folder is removed when the next stage has been written; the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
