"""A corpus pipeline in stages; each reads what its predecessor kept.

toxicity: documents that the model rejects go. near duplicates: one document of each group stays, the one with the smallest
id. repeated passages: words of windows that an earlier document has are cut out, and a document with no word left goes.
benchmark leaks: documents that hold a test item go. packing: the rest, as token sequences.
All but the last return the columns of `documents`, and any others; a text that nothing is cut from stays as it is, null or empty too, and
n_chars is that of the text. Rows with a null id are judged for toxicity and leaks like others, have no near copies and lose no words;
repeated rows stay or go together. An empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm import decontam, jaccard, packing, substring, toxicity
from collatio.llm._store import cut

#: Near duplicates: words of a shingle, and the similarity in per cent.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model of the labels that may be learnt from."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # so that a column named like the result stays what it is
    return toxicity.score(rows, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of the n-gram Jaccard join; rows without an id stay."""
    found = jaccard.near(docs.select("doc_id", "text"), WORDS, PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that an earlier document has."""
    out = substring.remove_repeats(docs, squeeze=False).where("n_removed = 0 or n_removed < n_words")
    text = out.select("doc_id", "text", "row.*")
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return text.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, row by row."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]
#: SQL can express neither a trained model nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
