"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its
result is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents. Stages that remove copies tell rows apart by a number written with them, so
documents that share a doc_id, or have none, are judged by their texts like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import exact, langid, minhash, packing, personal
from linewright.llm.queries import table, vocabulary
from linewright.plans.scratch import discard, settled, written

WORDS = 5  # per shingle
PERCENT = 80  # similarity from which documents are near copies
SEQUENCE = 2048  # tokens


def _numbered(docs: DataFrame) -> DataFrame:
    """(_docs, doc_id, text, _number): whole rows as one column, so that no name of theirs clashes."""
    rows = docs.select(F.struct(*docs.columns).alias("_docs"), F.monotonically_increasing_id().alias("_number"))
    return written(rows, "pipeline-rows")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("_docs.doc_id", "_docs.text", "_number")


def _kept(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows whose number is in ``stay``, with the columns they had."""
    names = rows.schema["_docs"].dataType.names
    return rows.join(stay.select("_number"), "_number", "left_semi").select(*(F.col(f"_docs.`{c}`").alias(c) for c in names))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without a letter go, and long ones that are too dear in each."""
    return langid.decided(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest row, then the smallest id."""
    rows = _numbered(docs)
    return _kept(rows, exact.exact_duplicates(_texts(rows), number="_number").filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id; texts without words all stay."""
    rows = _numbered(docs)
    found = minhash.linked(_texts(rows), WORDS, PERCENT)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_number"))
    alone = found.filter("root IS NULL").select("_number")
    chosen = found.filter("root IS NOT NULL").groupBy("root").agg(first.alias("_first")).select("_first._number")
    return _kept(rows, chosen.unionByName(alone))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of SEQUENCE tokens."""
    return packing.pack(docs, vocabulary(), size=SEQUENCE)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Language ID, signatures and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
