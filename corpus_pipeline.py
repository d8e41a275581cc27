"""A corpus made ready for training: language ID, exact and near dedup, benchmark decontamination, packing.

Each stage takes what the one before kept, decides by one operator and, but for the last, returns the columns of
documents. Stages between them pass tables written to the shared folder, so a lost executor costs one stage at most.

Nulls, empty and repeated rows have the results that the operators define; a stage without rows returns none. Rows that
differ in no column are told apart by a row key, so exactly one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barspark.llm import decontaminate, exact_dedup, langid, packing, simhash
from barspark.llm.common import ROW, keyed, table, without
from barspark.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones among them, and texts of no known language go."""
    prefix = "_lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    judged = langid.identify(docs, langid.fit(docs), prefix=prefix)
    return judged.where(f"not {prefix}rejected").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    rows = keyed(docs)
    found = exact_dedup.exact_groups(rows, row=ROW)
    return without(rows, found.where("not kept")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays."""
    rows = keyed(docs)
    found = simhash.near_duplicates(rows, row=ROW)
    return without(rows, found.where("not kept")).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), row=ROW)
    return without(rows, found.where("contaminated")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", sequences),
]

#: Neither the language model, nor the fingerprints, nor the ids of a tokenizer can be had in SQL; tests/llm has the checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
