"""Fill-in-the-middle: a text cut at two line ends, its parts marked and put in another order.

The cuts come from succinct rank and select over the UTF-8 bytes. A batch of texts is viewed as
64-bit words. A few arithmetic steps mark, in every word at once, the bytes that end a line;
``bitwise_count`` counts the marks of each word, and running counts over the words say how many
lines end before any byte. The k-th line end is found the other way round: a search in the
running counts finds its word, and clearing marks inside that word finds its byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 8 << 20  # bytes of text looked at in one step, unless one text is longer

_EACH = 0x0101010101010101
_HIGH = np.uint64(0x80 * _EACH)
_REST = np.uint64(0x7F * _EACH)
_LINE_FEED = np.uint64(0x0A * _EACH)
_ONE = np.uint64(1)


def line_feeds(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is a line feed. Sums stay below 256, so no byte carries into the next."""
    x = words ^ _LINE_FEED
    return ~(((x & _REST) + _REST) | x) & _HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that goes on with a character (10xxxxxx)."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Rank and select over the marked bytes of a padded buffer."""

    def __init__(self, words: np.ndarray, mark: Callable[[np.ndarray], np.ndarray]):
        self.marked = np.append(mark(words), np.uint64(0))
        self.before = np.zeros(len(self.marked) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.marked), dtype=np.int64, out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        low = (_ONE << (byte * np.uint64(8))) - _ONE
        return self.before[word] + np.bitwise_count(self.marked[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th marked byte, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        inside, turn = self.marked[word], k - self.before[word]
        for passed in range(1, 8):  # a word has eight bytes
            inside = np.where(turn > passed, inside & (inside - _ONE), inside)
        lowest = inside & (~inside + _ONE)
        return 8 * word + (np.bitwise_count(lowest - _ONE) >> 3).astype(np.int64) + 1


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned numbers of a document: the first four 8-digit groups of the hex sha256 of
    ``seed:doc_id``; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most SLICE bytes, or of one text."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        yield start, end
        start = end


def _cut(raw: np.ndarray, offsets: np.ndarray, drawn: np.ndarray):
    """Lines of each text, the places of its two cuts, and the code points of prefix and middle."""
    words = np.zeros(-(-len(raw) // 8), dtype="<u8")
    words.view(np.uint8)[: len(raw)] = raw
    first, last = offsets[:-1], offsets[1:]
    lines = Marks(words, line_feeds)
    earlier = lines.rank(first)
    n = lines.rank(last) - earlier
    open_end = last > first
    open_end[open_end] = raw[last[open_end] - 1] != 0x0A
    n += open_end
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    places = []
    for units in cuts.T:
        place = np.where(units == 0, first, last)
        inner = (units > 0) & (units < n)
        place[inner] = lines.select(earlier[inner] + units[inner])
        places.append(place)
    more = Marks(words, continuations)
    bounds = [p - more.rank(p) for p in (first, *places)]  # code points before each place
    return n, places, bounds[1] - bounds[0], bounds[2] - bounds[1]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Every whole text of ``docs`` (doc_id, text, anything else) as prefix, middle and suffix.

    Units are lines, line feeds included. Of the four numbers drawn for a document, the first
    two modulo the units plus one are the cuts. The form is ``plain`` when the text is empty or
    holds a marker already, or when the third modulo 100 is ``rate`` or more; else ``spm`` when the
    fourth modulo 100 is below ``spm``; else ``psm``. Returns ``doc_id``, ``n`` (units), ``form``,
    ``prefix_chars`` and ``middle_chars`` (code points, null if plain) and ``output``.

    A null text is empty. A null id is drawn for as an empty string; rows of one id are cut by the same
    draws, each by its own lines. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The slices are views; 64-bit offsets whatever the session sends.
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            _, place, data = texts.buffers()
            offsets = np.frombuffer(place, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if place else np.zeros(1, np.int64)
            held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
            for start, end in _slices(offsets):
                yield one(batch.slice(start, end - start), offsets[start : end + 1], held)

    def one(batch: pa.RecordBatch, offsets: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        raw, offsets = held[offsets[0] : offsets[-1]], offsets - offsets[0]
        ids = batch.column(0).to_pylist()
        drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
        n, (a, b), prefix, middle = _cut(raw, offsets, drawn)
        plain = (drawn[:, 2] % 100 >= rate) | (offsets[1:] == offsets[:-1])
        for marker in (PREFIX, SUFFIX, MIDDLE):
            found = pc.fill_null(pc.match_substring(batch.column(1), marker), False)
            plain |= found.to_numpy(zero_copy_only=False)
        swapped = drawn[:, 3] % 100 < spm
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        view, forms, out = raw.tobytes(), [], []
        for i in range(len(ids)):
            start, low, high, end = offsets[i], a[i], b[i], offsets[i + 1]
            if plain[i]:
                forms.append("plain")
                out.append(view[start:end])
            elif swapped[i]:
                forms.append("spm")
                out.append(b"".join((s, view[high:end], p, view[start:low], m, view[low:high])))
            else:
                forms.append("psm")
                out.append(b"".join((p, view[start:low], s, view[high:end], m, view[low:high])))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(prefix, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain),
                pa.array(out, pa.binary()).view(pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return mapped(
        docs.select("doc_id", "text"),
        run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; no marker can begin before its own place, as the text has none."""

    def part(text: Column, marker: str, which: int) -> Column:
        return F.split_part(text, F.lit(marker), F.lit(which))

    def opened(text: Column, marker: str) -> tuple[Column, Column, Column]:
        """What stands between the first marker and ``marker``, before the last one, and after it."""
        rest = part(text, marker, 2)
        return F.substr(part(text, marker, 1), F.lit(4)), part(rest, MIDDLE, 1), part(rest, MIDDLE, 2)

    prefix, suffix, middle = opened(output, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = opened(output, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
