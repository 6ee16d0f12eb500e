"""A corpus pipeline of five stages, each over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, nearcopies, suffixes, toxicity
from plumbline.llm.common import numbered, whole_id, without_ids, written
from plumbline.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.

    Without a labelled text of either kind all stay.  Null and empty texts are
    scored like any other; equal rows stay or go together.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=None))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document with the smallest doc_id stays.

    SimHash proposes pairs, whose shingles decide; a prefix-filter join adds the pairs that fingerprints miss.
    Null and empty texts are copies of each other; a null doc_id is the
    smallest; of rows that repeat a doc_id and text one stays.
    """
    rows = numbered(docs)
    return without_ids(rows, nearcopies.near_copies(rows.select("_id", F.col("_record.text").alias("text"))).select("_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, all but the first; characters stay whole and n_chars follows the text.

    All rows stay; null texts stay null, and texts that are repeats as a whole become empty.
    """
    cut = suffixes.cut_records(docs, characters=True)
    old = {c: F.col("_record").getField(c) for c in docs.columns}
    text = F.when(F.size("removed") == 0, old["text"]).otherwise(F.col("kept").cast("string"))
    new = old | {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in old else {})
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts, and all texts where the benchmark is empty, stay."""
    rows = numbered(docs)
    found = decontaminate.contamination(rows.select(F.col("_id").alias("doc_id"), F.col("_record.text").alias("text")), table(spark, sf_dir, "benchmark"))
    return without_ids(rows, found.select(whole_id("doc_id").alias("_id")).distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids (``ids``), with what the ids decode to (``decoded``); null and empty texts have none."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffixes", cut_repeats), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: SQL can express neither the models nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
