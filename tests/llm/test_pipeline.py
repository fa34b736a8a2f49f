"""The pipeline against the same steps done plainly in Python."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as pipeline  # noqa: E402
from linewright.llm import packing  # noqa: E402
from linewright.llm.queries import vocabulary  # noqa: E402
from test_copies import brute_components, brute_exact  # noqa: E402
from test_texts import brute_personal  # noqa: E402
from test_tokens import check_packed  # noqa: E402


def plainly(rows):
    """doc_id -> text that is packed, for distinct ids and texts with a language each."""
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    verdicts = brute_exact(rows)
    rows = [(d, t) for d, t in rows if verdicts[d][2]]
    roots = brute_components(rows, pipeline.WORDS, pipeline.PERCENT)
    out = {}
    for d, t in rows:
        if roots[d] == d:
            at, parts = 0, []
            for start, end, kind in sorted((s, e, k) for k, s, e in brute_personal(t)):
                if start >= at:
                    parts += [t[at:start], f"<{kind.upper()}>"]
                at = max(at, end)
            out[d] = "".join(parts) + t[at:]
    return out


def test_pipeline_of_documents(spark, sf_dir, documents):
    got = pipeline.run(spark, sf_dir).collect()
    want = plainly([(r.doc_id, r.text) for r in documents.collect()])
    assert {r.doc_id for r in got} == set(want)
    assert 0 < len(want) < documents.count()
    bins, tokens = check_packed(got, want, Tokenizer.from_file(vocabulary()), pipeline.SEQUENCE)
    assert bins <= tokens / pipeline.SEQUENCE + 3


def test_stages_keep_columns_and_other_rows(spark, odd, documents):
    columns = documents.columns
    clean = documents.withColumn("text", F.concat(F.lit("own "), F.col("doc_id"), F.lit(" words "), F.sha1(F.col("doc_id").cast("string"))))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clean, None)
        assert out.columns == columns, name
        assert out.count() == clean.count(), name
        assert stage(spark, odd, None).columns == odd.columns, name


def test_one_of_each_group_stays(spark, odd):
    exact = pipeline.exact_dedup(spark, odd, None).collect()
    assert {r.doc_id for r in exact} == {1, 4, 6, 7, 8, None} and len(exact) == 6
    near = pipeline.near_dedup(spark, odd, None).collect()
    assert {r.doc_id for r in near} == {1, 2, 3, 4, 6, 7, 8, None} and len(near) == 8


@pytest.mark.parametrize("stage", [pipeline.exact_dedup, pipeline.near_dedup])
def test_texts_that_share_an_id_or_have_none(spark, stage):
    """Each distinct text stays once, whatever its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (6, c), (None, "x " + c), (None, "y"), (None, "y"), (None, None), (8, a), (4, "y"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in stage(spark, docs, None).collect())
    want = [(0, ""), (4, "y"), (5, a), (5, b), (6, c)]
    near = [(0, "x " + c)] if stage is pipeline.exact_dedup else []
    assert got == sorted(want + near)


def test_nothing_is_lost_without_labels(spark, documents):
    plain = documents.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language(spark, plain, None).count() == documents.filter(r"text rlike '\\p{L}'").count()


def test_foreign_texts_go(spark):
    """A long text in a script that no label has is too dear; a short one stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = spark.createDataFrame([(-1, "漢字仮名交じり文" * 40), (-2, "漢字"), (-3, "...")], "doc_id bigint, text string")
    both = docs.unionByName(foreign, allowMissingColumns=True)
    kept = {r.doc_id for r in pipeline.language(spark, both, None).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {-2}


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_of_nothing(spark, nothing, stage):
    assert stage(spark, nothing, None).count() == 0


def test_last_stage_packs_what_it_gets(spark, odd):
    rows = pipeline.packed(spark, odd, None).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert rows[0].asDict().keys() == packing.pack(odd, vocabulary()).limit(1).collect()[0].asDict().keys()
