"""Language by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A document is parsed against
each one into phrases, every phrase the longest match with the language's text. The fewer
phrases, normalised by the text's length and the size of the reference, the closer the
language: phrases * log2(reference) / characters estimates the bits per character that the
language's text needs to describe the document.

The automata are one table of transitions, and a batch of documents is parsed in step, one
lane per document and language.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm.arrow import mapped

DOCUMENTS = 48  # labelled documents per language that the model is fitted on, at most
CHARACTERS = 600  # letters and spaces that each of them gives, at most
LANGUAGES = 256  # labels that are learned: those with the most labelled documents
UNDECIDED = "und"
LANES = 2048  # documents parsed in step
FEW = 12  # below this many a plain loop is faster than a step of numpy
SHARPNESS = 16.0
ENOUGH = 64  # letters and spaces from which the cost of a text tells a foreign one
MARGIN = 2.0  # a text may cost so many times as much as the dearest labelled one

SPACE = 0x20


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> lower-case letter, or space for everything that is no letter."""
    table = np.full(0x110000, SPACE, dtype=np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = ord(chr(i).lower()[0])
    return table


def letters_of(text: str | None) -> np.ndarray:
    """Folded letters with one space wherever something else stands; empty without letters."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = folded()[raw]
    blank = out == SPACE
    if blank.all():
        return out[:0]
    return out[~blank | np.r_[False, ~blank[:-1]]]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class Parser:
    """Phrase counts of documents against the automata of all languages.

    A cell of the table holds, for a state and a character, four times the next state's row
    plus the phrases that end there: one where the match breaks (the character then starts the
    next phrase), two where that character is unknown as well and is a phrase of its own.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        texts = {lang: letters_of(sample) for lang, sample in samples}
        self.languages = sorted(lang for lang, t in texts.items() if len(t))
        known = sorted({int(c) for lang in self.languages for c in np.unique(texts[lang])})
        self.code = np.zeros(0x110000, dtype=np.int16 if len(known) < 2**15 else np.int32)  # 0: never seen
        self.code[known] = np.arange(1, len(known) + 1)
        width = len(known) + 1
        rows, self.starts, self.bits = [], [], []
        for lang in self.languages:
            moves = suffix_automaton(self.code[texts[lang]].tolist())
            base = sum(map(len, rows))
            start = np.full(width, 4 * base * width + 1, dtype=np.int64)
            for c, to in moves[0].items():
                start[c] = 4 * (base + to) * width
            table = np.tile(start + 1, (len(moves), 1))  # a match breaks: one phrase more
            table[0] = start
            for state, to in enumerate(moves):
                for c, target in to.items():
                    table[state, c] = 4 * (base + target) * width
            rows.append(table.astype(np.int32) if table.max(initial=0) < 2**31 else table)
            self.starts.append(base * width)
            self.bits.append(math.log2(max(2, len(texts[lang]))))
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, dtype=np.int32)
        self.plain = memoryview(self.table)

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (a column) in each language (a row), and letters and spaces of each."""
        lanes = [self.code[letters_of(t)] for t in texts]
        order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        out = np.zeros((len(self.languages), len(lanes)), dtype=np.int64)
        if self.languages:
            out[:, order] = self._parse([lanes[i] for i in order])
        return out, np.array([len(x) for x in lanes])

    def _parse(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Lanes from the longest to the shortest."""
        lengths = np.array([len(x) for x in lanes])
        flat = np.concatenate(lanes)
        first = np.cumsum(lengths) - lengths
        starts = np.array(self.starts, dtype=self.table.dtype)[:, None]
        state = np.repeat(starts, len(lanes), axis=1)
        count = np.zeros(state.shape, dtype=np.int64)
        steps = int(lengths[FEW - 1]) if len(lanes) >= FEW else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left") if steps else ()
        for t in range(steps):
            k = active[t]
            cell = self.table[state[:, :k] + flat[first[:k] + t]]
            count[:, :k] += cell & 3
            state[:, :k] = cell >> 2
        for i in range(min(len(lanes), FEW)):  # what is left of the longest
            rest, plain = lanes[i][steps:].tolist(), self.plain
            for row in range(len(self.languages)):
                at, n = int(state[row, i]), 0
                for c in rest:
                    cell = plain[at + c]
                    n += cell & 3
                    at = cell >> 2
                state[row, i] = at
                count[row, i] += n
        return count + (state != starts)  # the last phrase


@lru_cache(maxsize=1)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The Python worker's parser; workers serve several tasks."""
    return Parser(samples)


def learned_sample(docs: DataFrame, label: str = "lang") -> tuple[tuple[tuple[str, str], ...], list[str]]:
    """(language, text) from at most DOCUMENTS labelled documents per language, by hash of the id, and
    the texts of at most as many further ones.

    The ids are picked among all labelled rows. Each id gives one text, of its letters the first
    CHARACTERS, with one space wherever something else stands; so LANGUAGES * DOCUMENTS * 2 short
    texts are all that is broadcast or collected.
    """
    labelled = docs.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    turn = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    rows = labelled.select("doc_id", F.col(label).alias("_lang"))
    common = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_lang").limit(LANGUAGES)
    picked = rows.join(F.broadcast(common.select("_lang")), "_lang", "left_semi").distinct()
    picked = picked.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= 2 * DOCUMENTS)
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "_lang", "_turn"))
    plain = F.trim(F.regexp_replace("text", r"\P{L}+", " "))
    texts = labelled.join(picked, (labelled["doc_id"] == picked["_id"]) & (labelled[label] == picked["_lang"]))
    texts = texts.select("_lang", "doc_id", "_turn", F.substr(plain, F.lit(1), F.lit(CHARACTERS)).alias("_text"))
    texts = texts.groupBy("_lang", "doc_id", "_turn").agg(F.min("_text").alias("_text"))
    by_language: dict[str, list[str]] = {}
    others = []
    for lang, _, place, text in sorted(texts.collect()):
        part = "".join(map(chr, letters_of(text)))
        if place <= DOCUMENTS:
            by_language.setdefault(lang, []).append(part)
        else:
            others.append(part)
    return tuple((lang, " ".join(parts)) for lang, parts in sorted(by_language.items())), others


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the crc32 of its id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted(
    samples: tuple[tuple[str, str], ...], rows: DataFrame, text_of: Callable[[pa.RecordBatch], pa.Array]
) -> DataFrame:
    """First column of ``rows`` with ``_lang_pred`` and ``_score`` of the text that ``text_of`` finds in a
    batch of them, ``_size`` (its letters and spaces) and ``_bits`` (its phrase cost for each of them)."""
    first = rows.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            column = text_of(batch)
            names, scores = [UNDECIDED] * len(column), [0.0] * len(column)
            lengths, least = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
            for at in range(0, len(column), LANES):
                found, sizes = parser.phrases(column[at : at + LANES].to_pylist())
                found = found * np.array(parser.bits)[:, None]
                lengths[at : at + LANES] = sizes
                for i in np.flatnonzero(sizes if parser.languages else ()):
                    bits = found[:, i] / found[:, i].min()
                    names[at + i] = parser.languages[int(bits.argmin())]
                    scores[at + i] = float(1 / np.exp2(-SHARPNESS * (bits - 1)).sum())
                    least[at + i] = found[:, i].min() / sizes[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(lengths), pa.array(least)],
                names=[first.name, "_lang_pred", "_score", "_size", "_bits"],
            )

    schema = T.StructType([first]).add("_lang_pred", "string").add("_score", "double")
    return mapped(rows, run, schema.add("_size", T.LongType()).add("_bits", "double"))


def learned(docs: DataFrame) -> tuple[tuple[tuple[str, str], ...], list[str]]:
    """``learned_sample`` of the documents that are not held out."""
    return learned_sample(docs.filter(~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text of ``docs`` (doc_id, text, lang, anything else).

    Learns from rows with a label that are not held out: of each of the LANGUAGES commonest labels
    at most DOCUMENTS documents, of each of these at most CHARACTERS letters. Predicts from the whole
    text alone. Returns ``doc_id``, ``held_out``, ``lang_pred`` (``und`` if the text is null or has no
    letter, or if there is no labelled text) and ``score``: 0 when undecided, else the share of the winner
    when languages weigh less the more bits they need. Equal languages: the first by name.

    A null doc_id is not held out and not learned from; repeated rows each get a row; of several texts
    under one learned id and label one is learned. Other columns are ignored; an empty table gives no rows.
    """
    samples, _ = learned(docs)
    found = predicted(samples, docs.select("doc_id", "text"), lambda batch: batch.column(1))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def dearest(samples: tuple[tuple[str, str], ...], others: list[str]) -> float | None:
    """Most bits a character that a text may cost: MARGIN times those of the dearest of ``others``,
    labelled texts that were not learned; None without one of ENOUGH letters."""
    parser = Parser(samples)
    texts = [t for t in others if len(t) >= ENOUGH]
    if not texts or not parser.languages:
        return None
    found, sizes = parser.phrases(texts)
    return MARGIN * float(((found * np.array(parser.bits)[:, None]).min(axis=0) / sizes).max())


def decided(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is none of the learned ones; all columns stay.

    A text goes without letters, and when it has at least ENOUGH letters and its cheapest phrases
    cost more than ``dearest`` allows. Shorter texts stay, and so does every text with letters when no
    label, or too few labelled documents, say what texts of a language cost.
    """
    place = docs.columns.index("text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    samples, others = learned(docs)
    limit = dearest(samples, others)
    found = predicted(samples, rows, lambda batch: batch.column(0).field(place))
    stays = F.col("_size") > 0
    if limit is not None:
        stays &= (F.col("_size") < ENOUGH) | (F.col("_bits") <= limit)
    return found.filter(stays).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
