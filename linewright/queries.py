"""The operators bound to the test tables, each with the same result as DuckDB SQL.

``BINDINGS[name] = (query, sql)``; ``sql`` is None where SQL cannot tell the answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import paths, text
from linewright.operators import (
    aggregates,
    changes,
    filters,
    joins,
    line_edits,
    line_rows,
    namespace,
    ordering,
    prefix_index,
    rights,
    stabbing,
)
from linewright.plans import ranking
from linewright.plans.scratch import scratch_path
from linewright.sources import byte_ranges, ends, lines, listing, sinks
from linewright.streaming import changes as live
from linewright.streaming import follow, growing

Query = Callable[[SparkSession, str], DataFrame]
BINDINGS: dict[str, tuple[Query, str | None]] = {}


def bind(sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        BINDINGS[query.__name__] = (query, sql)
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Line rows of ``documents``."""
    return lines.line_scan(table(spark, sf_dir, "documents"), [*keys, "doc_id"])


def doc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed lines of ``documents``."""
    return lines.packed(table(spark, sf_dir, "documents"), ["doc_id"])


# The line view of documents in SQL; queries on it start with this.
LINES_SQL = """
WITH l AS (
  SELECT source, doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS a FROM documents)
)"""


# --- scans, sources, sinks -------------------------------------------------------


@bind(LINES_SQL + " SELECT doc_id, pos, line FROM l")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir)


@bind(
    """
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos,
       concat(lpad(CAST(event_id AS VARCHAR), 12, '0'), ' ', event_type) AS line
FROM events
"""
)
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sorted text files; files in name order make one sequence of lines."""
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    out = scratch_path(spark, "text")
    table(spark, sf_dir, "events").select(
        F.concat(number, F.lit(" "), "event_type").alias("line")
    ).orderBy("line").write.text(out)
    found = lines.scan_files(spark, out)
    # part-00000.., in order: a line's place over all files is the rank of (path, pos).
    return ranking.global_rank(found, ["path", "pos"], "rank").select(
        (F.col("rank") - 1).alias("pos"), "line"
    )


@bind(
    """
SELECT CAST(0 AS BIGINT) AS src_no, 'documents' AS src, doc_id AS a, CAST(0 AS BIGINT) AS b, text
FROM documents
UNION ALL SELECT 1, 'benchmark', item_id, 0, text FROM benchmark
UNION ALL SELECT 2, 'conversations', conv_id, turn, text FROM conversations
"""
)
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("bigint").alias("b")
    docs, items, turns = (
        table(spark, sf_dir, t) for t in ("documents", "benchmark", "conversations")
    )
    return lines.concat_sources(
        [
            ("documents", docs.select(F.col("doc_id").alias("a"), zero, "text")),
            ("benchmark", items.select(F.col("item_id").alias("a"), zero, "text")),
            (
                "conversations",
                turns.select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), "text"),
            ),
        ],
        ["a", "b"],
    )


@bind("SELECT * FROM events")
def append_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    low = F.coalesce(F.col("value") < 10, F.lit(False))
    out = scratch_path(spark, "append")
    sinks.append_table(out, events.filter(low))
    sinks.append_table(out, events.filter(~low))
    return spark.read.parquet(out)


@bind("SELECT * FROM orders")
def copy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "copy")
    sinks.copy_table(spark, f"{sf_dir}/orders.parquet", out, dst_format="orc")
    return spark.read.orc(out)


@bind(
    """
SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(strlen(concat(c_name, ' ', c_mktsegment)) + 1) AS BIGINT) AS length
FROM customer GROUP BY 1
"""
)
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text files, a folder per nation: bytes found in each folder."""
    out = scratch_path(spark, "catalog")
    rows = table(spark, sf_dir, "customer")
    rows.select("c_nationkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("line")).write.partitionBy(
        "c_nationkey"
    ).text(out)
    found = listing.file_catalog(spark, out, recursive=True, sort="size", folders=True)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)$", 1).try_cast("bigint")
    return found.select(nation.alias("nation"), "length")


@bind(
    """
WITH c AS (
  SELECT concat('n=', c_nationkey) AS nation, concat('n=', c_nationkey, '/s=', c_mktsegment) AS segment,
         strlen(c_name) + 1 AS n FROM customer
), t AS (
  SELECT '' AS folder, segment AS below, n FROM c UNION ALL SELECT '', nation, 0 FROM c
  UNION ALL SELECT nation, segment, n FROM c UNION ALL SELECT segment, NULL, n FROM c
)
SELECT folder, CAST(sum(n) AS BIGINT) AS length, count(DISTINCT below) AS n_folders FROM t GROUP BY folder
"""
)
def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text files, in folders per nation and segment: what lies at or below each."""
    out = scratch_path(spark, "tree")
    table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), "c_name"
    ).write.partitionBy("n", "s").text(out)
    totals = listing.folder_totals(listing.walk(spark, out), out)
    below = F.substr("path", F.lit(len(out) + 2))
    return totals.select(below.alias("folder"), "length", "n_folders")


FILE_ROWS = 5000  # events in one file of file_ends


@bind(
    f"""
WITH l AS (
  SELECT event_id // {FILE_ROWS} AS file,
         concat(lpad(CAST(event_id AS VARCHAR), 12, '0'), ' ', event_type) AS line FROM events
), r AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS up,
         row_number() OVER (PARTITION BY file ORDER BY line DESC) AS down FROM l
)
SELECT file, 'first' AS part, up AS rank, line FROM r WHERE up <= 10
UNION ALL SELECT file, 'last', 11 - down, line FROM r WHERE down <= 10
"""
)
def file_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sorted text files: the first and the last ten lines of each."""
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    out = scratch_path(spark, "ends")
    table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FILE_ROWS}").alias("file"),
        F.concat(number, F.lit(" "), "event_type").alias("line"),
    ).repartition("file").sortWithinPartitions("file", "line").write.partitionBy("file").text(out)
    parts = [
        ends.file_ends(spark, out, 10, last=last, recursive=True).withColumn("part", F.lit(name))
        for name, last in (("first", False), ("last", True))
    ]
    file = F.regexp_extract("path", "file=([0-9]+)/", 1).cast("bigint").alias("file")
    return parts[0].unionByName(parts[1]).select(file, "part", "rank", "line")


LOCATIONS_SQL = """
WITH p AS (
  SELECT list_filter(
    string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^?#]*)', 1), '/'),
    lambda s: s <> '') AS parts
  FROM pages
), n AS (
  SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p
)"""

LISTING_SQL = """
SELECT array_to_string(parts[1:depth - 1], '/') AS parent, parts[depth] AS child,
       bool_or(depth < len(parts)) AS is_dir, count(*) AS n_paths
FROM n GROUP BY 1, 2"""


@bind(LOCATIONS_SQL + LISTING_SQL)
def namespace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.namespace_listing(
        table(spark, sf_dir, "pages"), paths.url_location(F.col("url"))
    )


@bind(
    LOCATIONS_SQL
    + f", c AS ({LISTING_SQL}) SELECT parent, count(*) AS n_entries FROM c GROUP BY 1"
)
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.namespace_counts(
        table(spark, sf_dir, "pages"), paths.url_location(F.col("url"))
    )


@bind(
    LOCATIONS_SQL
    + """
SELECT array_to_string(parts[1:depth], '/') AS path, depth, count(*) AS n_paths
FROM n GROUP BY 1, 2"""
)
def namespace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespace.namespace_tree(
        table(spark, sf_dir, "pages"), paths.url_location(F.col("url"))
    )


@bind(
    LOCATIONS_SQL
    + """
, h AS (SELECT page_id, array_to_string(parts, '/') AS path, parts FROM
        (SELECT page_id, list_filter(
           string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^?#]*)', 1), '/'),
           lambda s: s <> '') AS parts FROM pages)
), r AS (
  SELECT array_to_string(parts[1:1 + page_id % 3], '/') AS path, min(len(parts[1:1 + page_id % 3])) AS depth,
         max(page_id) AS owner
  FROM h WHERE page_id % 4 = 0 GROUP BY 1
), m AS (
  SELECT page_id, depth, owner, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) AS n
  FROM h JOIN r ON h.path = r.path OR starts_with(h.path, r.path || '/')
)
SELECT page_id, CAST(depth AS INTEGER) AS rule_depth, owner
FROM h LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (page_id)
"""
)
def inherited_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth page owns its host, its first folder or its second; the latest owner holds."""
    pages = table(spark, sf_dir, "pages")
    location = paths.url_location(F.col("url"))
    head = F.slice(paths.segments(location), F.lit(1), (1 + F.col("page_id") % 3).cast("int"))
    rules = pages.filter("page_id % 4 = 0").select(
        F.array_join(head, "/").alias("folder"), F.col("page_id").alias("owner")
    )
    held = rights.inherit(pages, location, rules, F.col("folder"), ["owner"], order="owner")
    return held.select("page_id", "rule_depth", "owner")


def _grown(spark: SparkSession, whole: str, inbox: str, halves: int) -> None:
    """Files of ``inbox`` with the first half of the bytes of those in ``whole``, or with all."""
    files = spark.read.format("binaryFile").load(whole).select("path", "length")

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                store, inner = byte_ranges.located(f"{inbox}/{path.rsplit('/', 1)[1]}")
                store.create_dir(inner.rsplit("/", 1)[0])
                left = length * halves // 2
                with byte_ranges.opened(path) as source, store.open_output_stream(inner) as sink:
                    while left and (block := source.read(min(left, 1 << 20))):
                        sink.write(block)
                        left -= len(block)
            yield pd.DataFrame({"n": [len(batch)]})

    files.mapInPandas(copied, "n bigint").agg(F.sum("n")).first()


@bind("SELECT concat(event_id, ' ', event_type) AS line FROM events")
def tail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text files that grow: cut off at half their bytes first, then whole."""
    whole, inbox, out, mark = (scratch_path(spark, f"tail-{x}") for x in ("all", "inbox", "out", "mark"))
    table(spark, sf_dir, "events").select(
        F.concat(F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("line")
    ).write.text(whole)
    for halves in (1, 2):
        _grown(spark, whole, inbox, halves)
        follow.land(growing.tail_files(spark, inbox), out, mark).awaitTermination()
    return spark.read.schema(growing.SCHEMA).parquet(out).select("line")


@bind("SELECT * FROM events")
def follow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in an inbox in two slices; each is followed in a run of its own."""
    events = table(spark, sf_dir, "events")
    inbox, out, mark = (scratch_path(spark, f"follow-{x}") for x in ("inbox", "out", "mark"))
    low = F.coalesce(F.col("value") < 10, F.lit(False))
    for part in (low, ~low):
        sinks.append_table(inbox, events.filter(part))
        stream = follow.follow_files(spark, inbox, events.schema, recursive=True)
        follow.land(stream, out, mark).awaitTermination()
    return spark.read.parquet(out)


@bind(
    LINES_SQL
    + """
, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
       line
FROM k WHERE prev IS DISTINCT FROM line"""
)
def rewrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, name = scratch_path(spark, "rewrite"), f"rewrite_{uuid.uuid4().hex}"
    sinks.rewrite_table(doc_arrays(spark, sf_dir), name, root)
    edited = line_edits.collapse_repeats(spark.table(name), lambda a, b: a == b)
    sinks.rewrite_table(edited, name, root)
    return lines.unpacked(spark.table(name))


@bind(
    """
SELECT c_name AS name, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  '
    WHEN 3 THEN concat('  ', c_mktsegment, ' ') WHEN 4 THEN concat(c_mktsegment, chr(10), c_custkey)
    ELSE c_mktsegment || ' & ' || c_custkey END AS value FROM customer
"""
)
def xml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with blanks around, blanks only, nothing, NULL and line breaks come back as they were."""
    kind, number = F.col("c_custkey") % 7, F.col("c_custkey").cast("string")
    value = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "")
        .when(kind == 2, "  ")
        .when(kind == 3, F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
        .when(kind == 4, F.concat("c_mktsegment", F.lit("\n"), number))
        .otherwise(F.concat("c_mktsegment", F.lit(" & "), number))
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), value.alias("value"))
    out = scratch_path(spark, "xml")
    sinks.xml_export(rows, out)
    return sinks.xml_import(spark, out)


# --- filters and fields ----------------------------------------------------------


@bind(LINES_SQL + " SELECT doc_id, pos, line FROM l WHERE regexp_matches(line, '(?i)license|copyright')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.grep_lines(doc_lines(spark, sf_dir), "license|copyright", ignore_case=True)


@bind(
    """
WITH t AS (
  SELECT concat(c_mktsegment, c_custkey, ': ', c_name) AS line FROM customer
  UNION ALL SELECT concat('node-', s_suppkey, ': ', s_name) FROM supplier
)
SELECT line, row_number() OVER (ORDER BY line) AS rank FROM t
WHERE NOT contains(line, 'MACHINERY') AND regexp_matches(line, '(?i)^\\w+[0-9]+:')
"""
)
def tagged_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.concat("c_mktsegment", F.col("c_custkey").cast("string"), F.lit(": "), "c_name").alias("line")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node-"), F.col("s_suppkey").cast("string"), F.lit(": "), "s_name").alias("line")
    )
    return ordering.tagged_grep(
        customers.unionByName(suppliers), "MACHINERY", r"^\w+[0-9]+:", rank="rank"
    )


@bind(
    """
SELECT p_partkey, spec, regexp_full_match(spec, '\\w+:Brand#[1-3]+') AS ok
FROM (SELECT p_partkey, concat(p_type, ':', p_brand) AS spec FROM part
      UNION ALL SELECT p_partkey, concat(p_name, ':', p_brand) FROM part)
"""
)
def validate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    specs = part.select(
        "p_partkey",
        F.explode(
            F.array(*[F.concat(c, F.lit(":"), "p_brand") for c in ("p_type", "p_name")])
        ).alias("spec"),
    )
    return filters.validate_route(specs, "spec", r"\w+:Brand#[1-3]+")


@bind(
    """
SELECT p_partkey, spec, regexp_full_match(spec, '\\w+:Brand#[1-3]+') AS accepted
FROM (SELECT p_partkey, concat(p_type, ':', p_brand) AS spec FROM part
      UNION ALL SELECT p_partkey, concat(p_name, ':', p_brand) FROM part)
"""
)
def write_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specs of validate_route, both routes written in one pass."""
    checked = validate_route(spark, sf_dir)
    out = scratch_path(spark, "routes")
    sinks.write_routes(checked, F.col("ok"), out)
    return spark.read.parquet(out).select("p_partkey", "spec", F.col("accepted").cast("boolean"))


@bind(
    """
WITH t AS (
  SELECT source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
  FROM documents
)
SELECT source, count(*) AS n_texts, CAST(sum(len(w)) AS BIGINT) AS n_tokens,
       CAST(sum(len(list_filter(w, lambda x: NOT starts_with(x, '-')))) AS BIGINT) AS n_plain
FROM t GROUP BY source
"""
)
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.token_profile(table(spark, sf_dir, "documents"), "text", ["source"])


COMMANDS_SQL = """
WITH c AS (
  SELECT event_id, value,
         concat('  ', event_type, ' -', left(event_type, 1), '  /u', user_id, ' ') AS cmd
  FROM events
), t AS (
  SELECT *, list_filter(regexp_split_to_array(cmd, '\\s+'), lambda x: x <> '') AS w FROM c
)"""


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines made of events: verb, one option, one path."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        F.concat(
            F.lit("  "),
            "event_type",
            F.lit(" -"),
            F.left("event_type", F.lit(1)),
            F.lit("  /u"),
            F.col("user_id").cast("string"),
            F.lit(" "),
        ).alias("cmd"),
    )


@bind(
    COMMANDS_SQL
    + """
SELECT event_id, cmd, CAST(len(w) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(w, lambda x: NOT starts_with(x, '-'))) AS BIGINT) AS n_plain,
       w[1] AS verb
FROM t"""
)
def token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.token_columns(_commands(spark, sf_dir).drop("value"), "cmd")


@bind(
    """
WITH p AS (
  SELECT page_id,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host
  FROM pages
), n AS (
  SELECT *, concat('/srv/', host, rtrim(path, '/')) AS abs_path FROM p
)
SELECT page_id, concat('./x/..//', ltrim(path, '/')) AS path, abs_path,
       regexp_extract(abs_path, '[^/]*$') AS base,
       regexp_extract(abs_path, '^(.*)/[^/]*$', 1) AS parent,
       regexp_extract(abs_path, '[^/]*$') AS leaf
FROM n
"""
)
def url_path_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.lit("./x/..//"), F.ltrim(paths.url_path(F.col("url")), F.lit("/"))
        ).alias("path"),
        F.concat(F.lit("/srv/"), paths.url_host(F.col("url"))).alias("cwd"),
    )
    return filters.path_profile(pages, "path", F.col("cwd")).drop("cwd")


IPV4 = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


@bind(
    LINES_SQL
    + f"""
SELECT doc_id, pos, regexp_extract(line, '{IPV4}', 1) AS ip,
       string_split(regexp_extract(line, '{IPV4}', 1), '.')[4] AS suffix
FROM l WHERE regexp_matches(line, '{IPV4}')"""
)
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.extract_fields(doc_lines(spark, sf_dir), IPV4, ["ip"])
    return found.select("doc_id", "pos", "ip", F.substring_index("ip", ".", -1).alias("suffix"))


@bind(
    """
WITH a AS (
  SELECT event_id, event_type, left(event_type, 1) AS c, user_id FROM events
)
SELECT event_id,
       CASE WHEN c = 'c' THEN concat(event_type, '=u', user_id, ' -c -R')
            WHEN c = 'e' THEN concat(event_type, ' = u', user_id, ' -l')
            ELSE concat(event_type, '=u', user_id, '  -A  -B') END AS line,
       event_type AS name, concat('u', user_id) AS verb,
       CASE c WHEN 'c' THEN 'common' WHEN 'e' THEN 'local' ELSE 'hdfs' END AS scope,
       CASE c WHEN 'c' THEN '-R' WHEN 'e' THEN '' ELSE '-B' END AS option
FROM a WHERE c <> 'v'
"""
)
def parse_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    head = F.left(kind, F.lit(1))
    line = (
        F.when(head == "c", F.concat(kind, F.lit("="), user, F.lit(" -c -R")))
        .when(head == "e", F.concat(kind, F.lit(" = "), user, F.lit(" -l")))
        .when(head == "v", F.concat(kind, F.lit(" "), user))
        .otherwise(F.concat(kind, F.lit("="), user, F.lit("  -A  -B")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return filters.parse_aliases(rows, "line")


@bind(
    """
SELECT page_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS element
FROM (SELECT page_id, string_split(url, '/') AS a FROM pages)
"""
)
def split_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filters.split_explode(pages, "url", "/").drop("url")


@bind(
    COMMANDS_SQL
    + """
SELECT event_id,
       array_to_string(CASE WHEN list_contains(w, '-p') THEN w
                            ELSE list_concat(w[1:1], ['-p'], w[2:]) END, ' ') AS cmd
FROM t"""
)
def ensure_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _commands(spark, sf_dir).select("event_id", text.tokens(F.col("cmd")).alias("cmd"))
    grown = filters.ensure_element(cut, "cmd", F.lit("-p"))
    return grown.withColumn("cmd", F.array_join("cmd", " "))


@bind(
    """
SELECT s_suppkey, replace(s_name, '#', '') AS host,
       concat('server.', regexp_extract(s_name, '[0-9]+'), '=', replace(s_name, '#', ''),
              ':2888:3888') AS server
FROM supplier
"""
)
def server_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.replace("s_name", F.lit("#"), F.lit("")).alias("host")
    )
    return filters.server_lines(hosts, "host")


@bind(
    """
SELECT p_partkey, CASE WHEN ends_with(p_type, 'L') THEN concat(p_type, '_HOME')
                       ELSE upper(concat(p_type, '_HOME')) END AS variable
FROM part
"""
)
def home_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower("p_type")
    given = F.when(F.endswith("p_type", F.lit("L")), F.concat(kind, F.lit("_home"))).otherwise(kind)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.home_variable(given).alias("variable")
    )


@bind("SELECT doc_id, left(text, 100) AS text, length(text) > 100 AS cut FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return filters.truncate_text(docs, "text", 100)


# --- joins -----------------------------------------------------------------------


@bind(
    """
WITH r AS (
  SELECT s_suppkey, concat('NATION_[', lpad(CAST(s_nationkey AS VARCHAR), 3, '0'), '-12]') AS spec,
         unnest(range(s_nationkey, 13)) AS n, s_nationkey AS lo
  FROM supplier
), h AS (
  SELECT s_suppkey, spec, n - lo AS host_no, concat('NATION_', n) AS host FROM r
  UNION ALL
  SELECT s_suppkey, concat('NATION_', s_nationkey, ',NATION_0'), 0, concat('NATION_', s_nationkey)
  FROM supplier
  UNION ALL
  SELECT s_suppkey, concat('NATION_', s_nationkey, ',NATION_0'), 1, 'NATION_0' FROM supplier
)
SELECT s_suppkey, spec, CAST(host_no AS BIGINT) AS host_no, host, n_nationkey, n_regionkey
FROM h JOIN nation ON host = n_name
"""
)
def spec_expand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey").cast("string")
    specs = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.explode(
            F.array(
                F.concat(F.lit("NATION_["), F.lpad(nation, 3, "0"), F.lit("-12]")),
                F.concat(F.lit("NATION_"), nation, F.lit(",NATION_0")),
                F.concat(F.lit("NATION_"), nation, F.lit(",,NATION_0")),
            )
        ).alias("spec"),
    )
    return joins.spec_expand_join(specs, table(spark, sf_dir, "nation"), "n_name").drop("n_name")


@bind(
    """
WITH s AS (
  SELECT concat('supplier ', s_suppkey) AS asker, CAST(7 * s_suppkey AS HUGEINT) AS lo,
         CAST(7 * s_suppkey + s_nationkey AS HUGEINT) AS hi FROM supplier
  UNION ALL
  SELECT r_name, 300 * r_regionkey, CAST('1000000000000000000000000000000' AS HUGEINT) FROM region
)
SELECT asker, concat('c[', lo, '-', hi, ']') AS spec, CAST(o_custkey - lo AS BIGINT) AS host_no, o_orderkey
FROM s JOIN orders ON o_custkey BETWEEN lo AND hi
"""
)
def spec_stab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by host ranges: narrow ones of suppliers, and ones of regions that nothing could open."""
    low = F.col("s_suppkey").cast("bigint") * 7
    narrow = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier "), "s_suppkey").alias("asker"),
        F.concat(F.lit("c["), low, F.lit("-"), low + F.col("s_nationkey"), F.lit("]")).alias("spec"),
    )
    wide = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("asker"),
        F.concat(F.lit("c["), F.col("r_regionkey") * 300, F.lit(f"-{10**30}]")).alias("spec"),
    )
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("host"), "o_orderkey")
    found = stabbing.spec_stab_join(narrow.unionByName(wide), orders, "host")
    return found.select("asker", "spec", F.col("host_no").cast("bigint").alias("host_no"), "o_orderkey")


TARGETS = ["node2", "node3", "node4"]


@bind(
    """
SELECT page_id, url, CAST(target_no AS BIGINT) AS target_no, target
FROM pages, (VALUES (0, 'node2'), (1, 'node3'), (2, 'node4')) AS t(target_no, target)
"""
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fan_out(table(spark, sf_dir, "pages").select("page_id", "url"), TARGETS)


ALIASES = """
  (0, 'common', 'click', 'press', '-R'),
  (1, 'hdfs', 'click', 'never', ''),
  (2, 'local', 'click', 'never', ''),
  (3, 'hdfs', 'view', 'look', ''),
  (4, 'local', 'view', 'look', '-l'),
  (5, 'local', 'error', 'fail', '-x'),
  (6, 'hdfs', 'signup', 'never', ''),
  (7, 'hdfs', 'signup', 'join', '-n')
"""

ALIASES_SQL = f"""
a AS (SELECT scope, name, arg_max(verb, no) AS verb, arg_max(option, no) AS option
      FROM (VALUES {ALIASES}) AS v(no, scope, name, verb, option) GROUP BY 1, 2),
ac AS (SELECT * FROM a WHERE scope = 'common'),
ah AS (SELECT * FROM a WHERE scope = 'hdfs'),
ao AS (SELECT * FROM a WHERE scope = 'local')"""


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {ALIASES} AS v(no, scope, name, verb, option)")


@bind(
    f"""
WITH {ALIASES_SQL}
SELECT event_id, event_type, coalesce(ac.verb, ah.verb, ao.verb, event_type) AS verb,
       CASE WHEN ac.name IS NOT NULL THEN ac.option WHEN ah.name IS NOT NULL THEN ah.option
            ELSE coalesce(ao.option, '') END AS option
FROM events
LEFT JOIN ac ON ac.name = event_type
LEFT JOIN ah ON ah.name = event_type AND value < 10
LEFT JOIN ao ON ao.name = event_type
"""
)
def lookup_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    found = joins.lookup_precedence(
        events, "event_type", _aliases(spark), F.coalesce(F.col("value") < 10, F.lit(False))
    )
    return found.drop("value")


@bind(
    COMMANDS_SQL
    + f""", {ALIASES_SQL}
SELECT event_id,
       array_to_string(list_filter(list_concat(
         [coalesce(ac.verb, ao.verb, w[1]),
          CASE WHEN ac.name IS NOT NULL THEN ac.option ELSE coalesce(ao.option, '') END],
         w[2:]), lambda x: x <> ''), ' ') AS cmd
FROM t
LEFT JOIN ac ON ac.name = w[1]
LEFT JOIN ao ON ao.name = w[1]
"""
)
def apply_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _commands(spark, sf_dir).select("event_id", text.tokens(F.col("cmd")).alias("cmd"))
    found = joins.apply_aliases(cut, "cmd", _aliases(spark), F.lit(False))
    return found.withColumn("cmd", F.array_join("cmd", " "))


@bind(
    """
WITH u AS (
  SELECT c_custkey, concat(c_name, ' (new)') AS c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer WHERE c_acctbal < 2000
)
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)
UNION ALL SELECT * FROM u
"""
)
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    updates = customer.filter("c_acctbal < 2000").withColumn(
        "c_name", F.concat("c_name", F.lit(" (new)"))
    )
    return joins.keyed_upsert(customer, updates, ["c_custkey"])


@bind(
    """
WITH s AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 9000 THEN c_name END AS name, c_mktsegment AS segment
  FROM customer WHERE c_acctbal >= 1000
), d AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 8500 THEN c_name END AS name,
         replace(c_mktsegment, 'BUILDING', 'BUILT') AS segment
  FROM customer WHERE c_acctbal < 7000 OR c_acctbal > 8000
)
SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey,
       CASE WHEN d.c_custkey IS NULL THEN 'added' WHEN s.c_custkey IS NULL THEN 'target_only'
            WHEN s.name IS NOT DISTINCT FROM d.name AND s.segment IS NOT DISTINCT FROM d.segment
            THEN 'same' ELSE 'changed' END AS status,
       s.name AS src_name, d.name AS dst_name, s.segment AS src_segment, d.segment AS dst_segment
FROM s FULL JOIN d ON s.c_custkey = d.c_custkey
"""
)
def sync_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    src = customer.filter(balance >= 1000).select(
        "c_custkey",
        F.when(balance < 9000, F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    dst = customer.filter((balance < 7000) | (balance > 8000)).select(
        "c_custkey",
        F.when(balance < 8500, F.col("c_name")).alias("name"),
        F.replace("c_mktsegment", F.lit("BUILDING"), F.lit("BUILT")).alias("segment"),
    )
    delta = joins.sync_delta(src, dst, ["c_custkey"])
    return delta.select(
        "c_custkey",
        "status",
        *[
            F.col(f"{side}.{c}").alias(f"{side}_{c}")
            for c in ("name", "segment")
            for side in ("src", "dst")
        ],
    )


PREFIX_SQL = """
WITH q AS (
  SELECT left(p_name, 3) AS query FROM part UNION SELECT left(p_name, 6) FROM part
), m AS (
  SELECT query, p_name, row_number() OVER (PARTITION BY query ORDER BY p_name) AS rank
  FROM q JOIN part ON starts_with(p_name, query)
)
SELECT query, rank, p_name FROM m WHERE rank <= 3
"""


@bind(PREFIX_SQL)
def prefix_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    heads = [F.left("p_name", F.lit(n)) for n in (3, 6)]
    asked = part.select(F.explode(F.array(*heads)).alias("query"))
    return joins.prefix_complete(asked, part, 3, line="p_name")


@bind(PREFIX_SQL)
def prefix_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of prefix_complete against a written index of the same lines."""
    part = table(spark, sf_dir, "part")
    heads = [F.left("p_name", F.lit(n)) for n in (3, 6)]
    asked = part.select(F.explode(F.array(*heads)).alias("query"))
    index = scratch_path(spark, "prefix-index")
    prefix_index.write_index(part, index, line="p_name")
    return prefix_index.look_up(index, asked, 3, line="p_name")


@bind(
    """
WITH q AS (
  SELECT left(p_name, 3) AS query FROM part UNION SELECT ''
), m AS (
  SELECT query, p_name, row_number() OVER (PARTITION BY query ORDER BY p_partkey DESC) AS rank
  FROM q JOIN part ON starts_with(p_name, query)
)
SELECT query, rank, p_name FROM m WHERE rank <= 5
"""
)
def prefix_complete_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of their source, here newest part first."""
    part = table(spark, sf_dir, "part").withColumn("place", -F.col("p_partkey"))
    asked = part.select(
        F.explode(F.array(F.left("p_name", F.lit(3)), F.lit(""))).alias("query")
    )
    return joins.prefix_complete(
        asked, part, 5, line="p_name", order=["place"], empty_asks_all=True
    )


@bind(
    """
SELECT * FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
"""
)
def member_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 450000")
    return joins.member_filter(table(spark, sf_dir, "customer"), big, {"c_custkey": "o_custkey"})


@bind(
    """
SELECT * FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
"""
)
def member_filter_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 450000")
    return joins.member_filter(
        table(spark, sf_dir, "customer"), big, {"c_custkey": "o_custkey"}, negate=True
    )


# --- aggregations ----------------------------------------------------------------


def _servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", F.concat("c_name", F.lit(":2181")).alias("v")
    )


@bind(
    """
WITH r AS (
  SELECT c_nationkey, concat(c_name, ':2181') AS v,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS no
  FROM customer
)
SELECT c_nationkey, (no - 1) // 25 AS part, count(*) AS n_values,
       string_agg(v, ',' ORDER BY no) AS text
FROM r GROUP BY 1, 2
"""
)
def ordered_concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_concat_parts(
        _servers(spark, sf_dir), ["c_nationkey"], "v", ["c_custkey"], part_size=25
    )


@bind(
    """
SELECT c_nationkey, count(*) AS n_values, string_agg(concat(c_name, ':2181'), ',' ORDER BY c_custkey) AS text
FROM customer GROUP BY 1
"""
)
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_concat(_servers(spark, sf_dir), ["c_nationkey"], "v", ["c_custkey"])


@bind(
    """
SELECT source, bool_or(regexp_matches(text, 'token = |[0-9]{3}-[0-9]{4}')) AS found
FROM documents GROUP BY source
"""
)
def exists_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return aggregates.exists_matching(docs, ["source"], "token = |[0-9]{3}-[0-9]{4}")


@bind(
    """
SELECT c_custkey, CASE WHEN c_acctbal < 3000 THEN concat(c_mktsegment, '*')
                       ELSE c_mktsegment END AS c_mktsegment
FROM customer
"""
)
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    override = customer.filter("c_acctbal < 3000").withColumn(
        "c_mktsegment", F.concat("c_mktsegment", F.lit("*"))
    )
    return aggregates.merge_last_wins([customer, override], ["c_custkey"], "c_mktsegment")


# --- ordered line edits ----------------------------------------------------------


@bind(
    """
WITH t AS (
  SELECT c_custkey, string_split(concat_ws(chr(10),
    concat('# ', c_mktsegment, '_HOME'), concat('export ', c_mktsegment, '_HOME=/opt/', c_name),
    concat('export PATH=$PATH:$', c_mktsegment, '_HOME/bin'), '', '', '# KEEP', 'export KEEP=1'),
    chr(10)) AS a
  FROM customer
), l AS (
  SELECT c_custkey, unnest(range(len(a))) AS pos, unnest(a) AS line FROM t
), kept AS (
  SELECT * FROM l WHERE NOT (regexp_matches(line, '^#\\s+\\bBUILDING_HOME\\b')
    OR contains(line, 'export BUILDING_HOME=') OR contains(line, '$BUILDING_HOME'))
), grown AS (
  SELECT * FROM kept
  UNION ALL
  SELECT c_custkey, 100 + i, b FROM t, (VALUES (0, ''), (1, ''), (2, '# BUILDING_HOME'),
    (3, 'export BUILDING_HOME=/opt/b'), (4, 'export PATH=$PATH:$BUILDING_HOME/bin'),
    (5, 'export PATH=$PATH:$BUILDING_HOME/sbin')) AS v(i, b)
), p AS (
  SELECT *, lag(line) OVER (PARTITION BY c_custkey ORDER BY pos) AS prev FROM grown
)
SELECT c_custkey,
       CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY pos) - 1 AS INTEGER) AS pos, line
FROM p WHERE NOT (line = '' AND coalesce(prev, 'x') = '')
"""
)
def block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = F.concat("c_mktsegment", F.lit("_HOME"))
    profile = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), home),
        F.concat(F.lit("export "), home, F.lit("=/opt/"), "c_name"),
        F.concat(F.lit("export PATH=$PATH:$"), home, F.lit("/bin")),
        *[F.lit(s) for s in ("", "", "# KEEP", "export KEEP=1")],
    )
    profiles = table(spark, sf_dir, "customer").select("c_custkey", profile.alias("text"))
    block = line_edits.env_block("building_home", "/opt/b", "sbin")
    edited = line_edits.block_upsert(
        lines.packed(profiles, ["c_custkey"]), "BUILDING_HOME", block
    )
    return lines.unpacked(edited)


@bind(
    LINES_SQL
    + """
, grown AS (
  SELECT doc_id, pos, line FROM l WHERE NOT contains(line, 'License')
  UNION ALL
  SELECT doc_id, 1000000 + i, b FROM documents, (VALUES (0, ''), (1, '# License')) AS v(i, b)
), p AS (
  SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM grown
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
       line
FROM p WHERE NOT (line = '' AND coalesce(prev, 'x') = '')"""
)
def block_upsert_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_edits.block_upsert(
        doc_arrays(spark, sf_dir), "License", ["# License"], broad=True
    )
    return lines.unpacked(edited)


@bind(
    LINES_SQL
    + """
, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
       line
FROM k WHERE prev IS DISTINCT FROM line"""
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_edits.collapse_repeats(doc_arrays(spark, sf_dir), lambda a, b: a == b)
    return lines.unpacked(edited)


CHANGES_SQL = """
SELECT event_id, ts, user_id, event_type, prev FROM (
  SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS no FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id))
WHERE no > 1 AND prev IS DISTINCT FROM event_type"""

CHANGE_COLUMNS = ["event_id", "ts", "user_id", "event_type"]


@bind(CHANGES_SQL)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(*CHANGE_COLUMNS)
    return changes.change_log(events, ["user_id"], ["ts", "event_id"], "event_type")


@bind(
    """
SELECT event_id, ts, user_id, event_type, prev FROM (
  SELECT *, lag(user_id) OVER w AS prev, row_number() OVER w AS no FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id))
WHERE no > 1 AND prev IS DISTINCT FROM user_id"""
)
def change_log_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows each: the runs of one key are spread over tasks."""
    events = table(spark, sf_dir, "events").select(*CHANGE_COLUMNS)
    return changes.change_log(
        events, ["event_type"], ["ts", "event_id"], "user_id", max_rows=1500
    )


@bind(
    LINES_SQL
    + """
, h AS (
  SELECT *, max(CAST(contains(line, '@') AS INT)) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near
  FROM l
)
SELECT doc_id, pos, line, contains(line, '@') AS is_hit FROM h WHERE near = 1"""
)
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = lines.packed(table(spark, sf_dir, "documents"), ["doc_id"], holding="@")
    return line_edits.grep_context(arrays, "@", literal=True)


@bind(
    LINES_SQL
    + """
, f AS (
  SELECT *, min(CASE WHEN contains(line, 'the') THEN pos END) OVER (PARTITION BY doc_id) AS hit FROM l
)
SELECT doc_id, pos, CASE WHEN pos = hit THEN replace(line, 'the', 'THE') ELSE line END AS line
FROM f"""
)
def rewrite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.unpacked(line_edits.rewrite_lines(doc_arrays(spark, sf_dir), "the", "THE"))


@bind(LINES_SQL + " SELECT doc_id, pos, replace(line, 'License', 'LICENSE') AS line FROM l")
def rewrite_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_edits.rewrite_lines(
        doc_arrays(spark, sf_dir), "License", "LICENSE", mode="all"
    )
    return lines.unpacked(edited)


@bind(
    LINES_SQL
    + """
, a AS (SELECT doc_id, pos, CASE WHEN contains(line, 'token =') THEN 'broker.id=1' ELSE line END AS line FROM l
), b AS (SELECT doc_id, pos, CASE WHEN contains(line, 'Licens') THEN 'delete.topic=true' ELSE line END AS line FROM a)
SELECT doc_id, pos, CASE WHEN contains(line, 'id=1') THEN 'broker.id=2' ELSE line END AS line FROM b"""
)
def rewrite_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("token =", "broker.id=1"), ("Licens", "delete.topic=true"), ("id=1", "broker.id=2")]
    return lines.unpacked(line_edits.rewrite_by_rules(doc_arrays(spark, sf_dir), rules))


@bind(
    LINES_SQL
    + """
, f AS (
  SELECT doc_id, min(CASE WHEN contains(line, 'Licens') THEN pos END) AS hit, max(pos) AS top
  FROM l GROUP BY doc_id
), g AS (
  SELECT doc_id, CAST(pos AS DOUBLE) AS o, line FROM l
  UNION ALL SELECT doc_id, coalesce(hit - 0.5, top + 2), '# before' FROM f
  UNION ALL SELECT doc_id, top + 1, 'Licens' FROM f WHERE hit IS NULL
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, line
FROM g"""
)
def insert_before_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_edits.insert_before_marker(doc_arrays(spark, sf_dir), "Licens", ["# before"])
    return lines.unpacked(edited)


@bind(
    LINES_SQL
    + """
, f AS (
  SELECT doc_id, min(pos) AS f FROM l WHERE contains(line, 'The') GROUP BY 1
), e AS (
  SELECT l.doc_id, min(pos) AS e FROM l JOIN f ON l.doc_id = f.doc_id AND pos > f
  WHERE contains(line, 'And') GROUP BY 1
), s AS (
  SELECT l.doc_id, any_value(e) AS e, max(pos) AS s FROM l JOIN e ON l.doc_id = e.doc_id AND pos < e
  WHERE contains(line, 'The') GROUP BY 1
), k AS (
  SELECT l.doc_id, CAST(pos AS DOUBLE) AS o, line FROM l LEFT JOIN s ON l.doc_id = s.doc_id
  WHERE e IS NULL OR pos <= s OR pos >= e
  UNION ALL SELECT doc_id, s + 0.5, '# cut' FROM s
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, line
FROM k"""
)
def cut_between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_edits.cut_between_markers(
        doc_arrays(spark, sf_dir), "The", "And", ["# cut"]
    )
    return lines.unpacked(edited)


@bind(
    LINES_SQL
    + """
, k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS no
  FROM l WHERE contains(line, 'token')
)
SELECT source, doc_id, pos, line FROM k WHERE no = 1"""
)
def kth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ordering.kth_match(
        lines.line_scan(documents, ["source", "doc_id"], holding="token"),
        ["source"],
        ["doc_id", "pos"],
        "token",
        0,
        literal=True,
    )


# --- the same edits on line rows ---------------------------------------------------


def _same_as(name: str) -> Callable[[Query], Query]:
    """Bind to the SQL of another query; row operators have bigint positions."""
    sql = BINDINGS[name][1]
    assert sql is not None
    return bind(sql.replace("CAST(row_number()", "(row_number()").replace("- 1 AS INTEGER)", "- 1)"))


@bind(
    LINES_SQL
    + """
, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l)
SELECT doc_id, pos, line FROM k WHERE prev IS DISTINCT FROM line"""
)
def collapse_repeats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.collapse_repeats(
        doc_lines(spark, sf_dir), ["doc_id"], lambda a, b: a == b, chunk=20
    )


@_same_as("grep_context")
def grep_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.grep_context(doc_lines(spark, sf_dir), ["doc_id"], "@", literal=True)


@_same_as("rewrite_lines")
def rewrite_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.rewrite_first(doc_lines(spark, sf_dir), ["doc_id"], "the", "THE")


@_same_as("insert_before_marker")
def insert_before_marker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.insert_before_marker(
        doc_lines(spark, sf_dir),
        ["doc_id"],
        "Licens",
        ["# before"],
        docs=table(spark, sf_dir, "documents"),
    )


@_same_as("cut_between_markers")
def cut_between_markers_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.cut_between_markers(
        doc_lines(spark, sf_dir), ["doc_id"], "The", "And", ["# cut"]
    )


@_same_as("block_upsert_broad")
def block_upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows.block_upsert(
        doc_lines(spark, sf_dir),
        ["doc_id"],
        "License",
        ["# License"],
        broad=True,
        docs=table(spark, sf_dir, "documents"),
    )


# --- sort and limit --------------------------------------------------------------


@bind(
    LINES_SQL
    + " SELECT doc_id, pos, line, row_number() OVER (ORDER BY line, doc_id, pos) AS rank FROM l"
)
def sort_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sort_lines(doc_lines(spark, sf_dir), ties=["doc_id", "pos"], rank="rank")


@bind(
    LINES_SQL
    + """
, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS no FROM l)
SELECT doc_id, pos, line FROM k WHERE no <= 2"""
)
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edits.tail_lines(doc_arrays(spark, sf_dir), 2)


@bind(
    LINES_SQL
    + """
, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM l)
SELECT doc_id, pos, line FROM k WHERE no <= 2"""
)
def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edits.head_lines(doc_arrays(spark, sf_dir), 2)


@bind(
    """
SELECT event_id, ts, user_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events)
WHERE rank <= 2
"""
)
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ordering.head_tail(events, ["user_id"], ["ts", "event_id"], 2, end="tail")


# --- streaming -------------------------------------------------------------------


@bind(CHANGES_SQL)
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in three slices of time; the stream resumes after each."""
    events = table(spark, sf_dir, "events").select(*CHANGE_COLUMNS)
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) / 3
    cuts = [ends["lo"] + step, ends["lo"] + 2 * step]
    ts = F.col("ts")
    # Rows without a time come first, as in the batch operator.
    slices = [ts.isNull() | (ts < cuts[0]), (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]]

    inbox = scratch_path(spark, "inbox")
    out, mark = (scratch_path(spark, f"changes-{x}") for x in ("out", "mark"))
    for part in slices:
        sinks.append_table(inbox, events.filter(part))
        stream = follow.follow_files(spark, inbox, events.schema)
        live.change_stream(stream, ["user_id"], ["ts", "event_id"], "event_type", out, mark).awaitTermination()
    return live.read_changes(spark, out)
