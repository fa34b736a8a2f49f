from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewright.sources.lines import unpacked

LINE_ROWS = "doc_id bigint, pos bigint, line string"


def packed_docs(spark: SparkSession, docs: dict[int, list]) -> DataFrame:
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, lines array<string>")


def row_docs(spark: SparkSession, docs: dict[int, list]) -> DataFrame:
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, LINE_ROWS)


def as_docs(df: DataFrame) -> dict[int, list]:
    """Packed documents or line rows as {doc_id: lines in order}."""
    if "lines" in df.columns:
        return {r["doc_id"]: r["lines"] for r in df.collect()}
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["pos"])):
        out.setdefault(r["doc_id"], []).append(r["line"])
    return out


def positions(df: DataFrame) -> dict[int, list]:
    rows = unpacked(df) if "lines" in df.columns else df
    out: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["pos"])):
        out.setdefault(r["doc_id"], []).append(r["pos"])
    return out
