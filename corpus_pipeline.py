"""The document pipeline: each stage calls one operator, and its decisions take effect on the documents that go on.

A doc_id names a document, together with its text where rows share a doc_id or have none: of such rows those with other
texts are judged apart, and fully equal ones stay or go together. Rows without a doc_id go through the n-gram stage
unchanged, as it compares documents by their ids. Null texts count as empty. Only the columns of ``documents`` go from
stage to stage; others, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import toxicity
from hushlake.llm.common import discard, scratch_of, written
from hushlake.llm.exact_dedup import exact_duplicates
from hushlake.llm.jaccard import jaccard_join
from hushlake.llm.mixing import mix_sources
from hushlake.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go. The classifier learns from the labelled ones."""
    fitted = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), fitted).where(~F.col("tox_rejected")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id goes on."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower).cast("binary"), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_sha"))
    return docs.select(*COLUMNS).join(kept, same, "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by n-gram similarity the one with the smallest doc_id goes on."""
    docs = docs.select(*COLUMNS)
    kept = jaccard_join(docs).where(F.col("class_id") == F.col("doc_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document goes on as often as the mix takes it, and not at all where it takes none. Rows of one source that
    share a doc_id go on equally often."""
    taken = mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.max("copies").alias("_copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    return docs.select(*COLUMNS).join(taken, same).select(*COLUMNS, copies.alias("_copy")).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in token sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what one returns is written as Parquet and read again by the next.

    Once a stage's documents are written, what the stage itself wrote on the way is deleted, and the documents that it
    read, so that the shared folder holds one stage's tables at a time. The last stage's stay, as its rows are read later.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch_of() as used:
            result = stage(spark, docs, sf_dir)
        with scratch_of() as table:
            docs = written(result)
        discard(spark, read + used)
        read = table
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the n-gram join and the tokenizer cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None
