"""Quality rules whose cutoffs are risk-controlled.

Each rule rejects documents whose measure is above a cutoff. Labelled documents are the
holdout: in every stratum (language) a rule's cutoffs are tried from the loosest to the
tightest, and an exact binomial test must show, for each, that it rejects less than RISK /
rules of the good documents. The first that fails ends the sequence, so cutoffs within a rule need no
correction; the confidence is divided among all strata and rules (Bonferroni). A stratum
with too few good documents to show anything keeps everything the base rules keep.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped
from linewright.llm.exact import BLANKS
from linewright.llm.words import words_of
from linewright.plans.scratch import written

SYMBOLS = "#*$%&|<>"
RISK = 0.02  # share of a stratum's good documents that the rules may reject, at most
CONFIDENCE = 0.95  # that this holds in all strata at once
STEPS = 300  # a rule's cutoffs are 0 to STEPS - 1
FEW = 100_000  # strata whose cutoffs are broadcast; more are joined by a shuffle

MEASURED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    window = ids[:n]
    for i in range(1, width):  # numbered anew each time, so products stay in 64 bits
        _, window = np.unique(window * len(known) + ids[i : i + n], return_inverse=True)
    often = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + n] |= often
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measure(t.as_py()) for t in batch.column(2)))) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "_stratum", *(c.split()[0] for c in MEASURED.split(", "))],
            )

    strata = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum")
    return mapped(docs.select("doc_id", strata, "text"), run, f"doc_id bigint, _stratum string, {MEASURED}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Measures in whole steps, rounded up; a rule rejects what lies above its cutoff."""
    words = F.greatest("n_words", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    per = {
        "symbols": 100 * F.col("n_symbols") / words,
        "repeated_lines": 100 * F.col("n_dup_lines") / lines,
        "repeated_words": 100 * F.col("n_repeat_words") / words,
        "long_words": 10 * F.col("word_chars") / words,
        "short_words": 150 - 10 * F.col("word_chars") / words,
    }
    return {
        name: F.least(F.greatest(F.ceil(value), F.lit(0)), F.lit(STEPS)).cast("int")
        for name, value in per.items()
    }


def at_most(k: int, n: int, p: float) -> float:
    """Exact probability of k or fewer of n when each has probability p; for k below n * p."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = total = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    while k > 0 and term > total * 1e-17:
        term *= k / (n - k + 1) * (1 - p) / p
        total += term
        k -= 1
    return min(1.0, total)


def cutoffs(good: dict[tuple[str, str], dict[int, int]], n_rules: int) -> dict[str, dict[str, int]]:
    """Tightest certified cutoff by stratum and rule; ``good`` counts good documents by step."""
    risk = RISK / n_rules
    chance = (1 - CONFIDENCE) / max(1, len(good))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for (stratum, rule), steps in good.items():
        n, rejected = sum(steps.values()), 0
        for cutoff in range(STEPS - 1, -1, -1):
            rejected += steps.get(cutoff + 1, 0)
            if rejected >= n * risk or at_most(rejected, n, risk) > chance:
                break
            out[stratum][rule] = cutoff
    return dict(out)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Verdict on every whole text of ``docs`` (doc_id, text, stratum column, anything else).

    ``labels`` has doc_id and quality (1 good, 0 not); only good ones count here. Returns
    ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, and ``failed_rules`` (names, joined by commas).

    A null text has no words and fails the base. Null strata are one stratum. Null ids get a
    row and no label; repeated rows each get a row. Other columns are ignored; an empty table
    gives no rows.
    """
    table = written(measured(docs, stratum), "op6-measured").withColumn("base_failed", base_failed())
    named = rules()
    labelled = labels.filter("quality = 1").select("doc_id").distinct()
    steps = table.filter(~F.col("base_failed")).join(labelled, "doc_id").select(
        "_stratum",
        F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values()))).alias("rule", "step"),
    )
    good: dict[tuple[str, str], Counter] = defaultdict(Counter)
    # At most STEPS + 1 rows per stratum and rule.
    for row in steps.groupBy("_stratum", "rule", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        good[row["_stratum"], row["rule"]][row["step"]] = row["n"]
    found = cutoffs(good, len(named))

    schema = ", ".join(["_at string", *(f"_{name} int" for name in named)])
    certified = docs.sparkSession.createDataFrame(
        [(s, *(by.get(name) for name in named)) for s, by in sorted(found.items())], schema
    )
    certified = F.broadcast(certified) if len(found) <= FEW else certified
    above = [F.when(value > F.col(f"_{name}"), F.lit(name)) for name, value in named.items()]
    judged = table.join(certified, F.col("_stratum") == F.col("_at"), "left")
    judged = judged.withColumn("failed_rules", F.concat_ws(",", *above))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"),
        "failed_rules",
    )
