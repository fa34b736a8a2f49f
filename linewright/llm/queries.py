"""The corpus operators bound to the test tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import (
    bpe,
    divergence,
    exact,
    html_text,
    infill,
    langid,
    minhash,
    packing,
    personal,
    quality,
    secrets,
    sharding,
    simhash,
)

Query = Callable[[SparkSession, str], DataFrame]
BINDINGS: dict[str, tuple[Query, str | None]] = {}


def bind(sql: str | None = None):
    def add(query: Query) -> Query:
        BINDINGS[query.__name__] = (query, sql)
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Place of the installed vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@bind(
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), grams AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
        FROM words
    ), sizes AS (SELECT doc_id, len(g) AS n FROM grams
    ), flat AS (SELECT doc_id, unnest(g) AS gram FROM grams
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
        FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * same >= 85 * (x.n + y.n - same)
    ), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
    ), reach AS (
        SELECT doc_id, doc_id AS seen FROM sizes
        UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.seen
    ), roots AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sizes JOIN roots USING (doc_id)
    """
)
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@bind(
    r"""
    WITH bare AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
        CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
        doc_id = first_value(doc_id) OVER best AS kept, sha256(t) AS text_sha256
    FROM bare WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id)
    """
)
def op3_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@bind()
def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@bind()
def op5_best_two_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), size=2048)


@bind()
def op9_bpe_round_trip(spark, sf_dir):
    return bpe.round_trips(table(spark, sf_dir, "documents"), vocabulary())


@bind()
def op10_ring_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


@bind()
def op2_text_density(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@bind()
def op6_risk_controlled_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@bind()
def op8_guess_cost_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@bind()
def op7_boosted_personal_data(spark, sf_dir):
    return personal.find_personal(table(spark, sf_dir, "documents"))


@bind(
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), uses AS (SELECT r, lang, source, unnest(w) AS term FROM d
    ), kept AS (SELECT lang, term FROM uses GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30
    ), n AS (SELECT lang, source, term, count(*) AS c FROM uses JOIN kept USING (lang, term) GROUP BY 1, 2, 3
    ), terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1
    ), groups AS (SELECT DISTINCT lang, source FROM d
    ), sizes AS (
        SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN n USING (lang, source) GROUP BY 1, 2
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
            CAST(1 + (1000000000 * CAST(coalesce(c, 0) + 5 AS HUGEINT)) // (g.n + 5 * v) AS BIGINT) AS p
        FROM sizes g JOIN kept k USING (lang) JOIN terms USING (lang)
        LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
    ), q AS (
        SELECT lang, term, CAST(1 + (1000000000 * CAST(sum(c) + 5 AS HUGEINT))
            // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q
        FROM n JOIN terms USING (lang) GROUP BY lang, term, v
    ), found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
            CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM found
    )
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """
)
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@bind(
    r"""
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), drawn AS (
        SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x,
            CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[25:32] AS BIGINT) % 100 AS z
        FROM units
    ), parts AS (
        SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form,
            coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p,
            coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
            coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS s
        FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts
    """
)
def op12_swar_fill_in_middle(spark, sf_dir):
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(output, form).cast("binary"), 256).alias("restored_sha256"),
    )


@bind()
def op13_anchor_simhash(spark, sf_dir):
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"), width=3, threshold=3, seed=42)
