"""Near duplicates by SimHash, found at the anchors of a covering code.

Two fingerprints of 64 bits that differ in at most ``threshold`` bits differ in at most half of that
in one of two blocks of 31 bits. In a block, the words of the Hamming code of length 31 are the
anchors: a perfect code, so that every block lies within its covering radius, 1, of just one
anchor, its home. A fingerprint goes to every anchor within the covering radius plus what the
block may differ by. If x and y are linked by a block, y is at most that far from the home of x, so
both are there; what meets at an anchor is compared on all 64 bits.

An anchor gives a spanning forest of the links among its fingerprints, not the pairs: from
each one reached, all that are not yet reached are compared at once. A group of near copies is
so used up in a few steps, whatever its size. Equal fingerprints are one from the start.
Anchors with more than BLOCK fingerprints are cut into blocks, and every two blocks meet in a
task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.arrow import mapped
from linewright.llm.components import components
from linewright.plans.scratch import discard, written

SEED = 42
BITS = 31  # length of the code
CHECKS = 5  # its check bits; 2 ** 26 anchors a block
STEP = 1 << 16  # shingles whose bits are counted at once
PART = 1 << 20  # bytes of a long text that are split at once
BLOCK = 16_384  # fingerprints of an anchor that one task compares
CROWDED = 64  # mean fingerprints an anchor from which anchors are refined by other bits


def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text part by part; a long text is cut between words only."""
    at = 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):  # up to the next blank
            while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":
                end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if over half of the hashes of all ``width``-word shingles, repeats too, have it.

    Words are runs of characters other than space and tab to carriage return, A-Z in lower case.
    With fewer words the whole sequence is the one shingle; without words the fingerprint is 0.
    """
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(words: list[bytes], width: int) -> None:
        nonlocal total
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        spans = zip(starts, ends[width - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), "<u8")
        for i in range(0, len(hashes), STEP):
            bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for words in _word_lists((text or "").encode().lower()):
        words = tail + words
        if len(words) >= width:
            add(words, width)
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not total and tail:
        add(tail, len(tail))
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; the 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            found = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def syndrome(block: np.ndarray) -> np.ndarray:
    """0 for a word of the code, else the number (from 1) of the bit that is wrong."""
    out = np.zeros(block.shape, dtype=np.uint64)
    for i in range(CHECKS):
        mask = sum(1 << (n - 1) for n in range(1, BITS + 1) if n >> i & 1)
        out |= (np.bitwise_count(block & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(i)
    return out


def anchors(block: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``block``, anchor): the words of the code within 1 + ``more`` of each, ``more`` 0 or 1."""
    one, s = np.uint64(1), syndrome(block)
    home = np.where(s > 0, block ^ (one << (np.maximum(s, one) - one)), block)
    places, found = [np.arange(len(block))], [home]
    if more:
        # From outside the code, two bits whose numbers add up to the syndrome lead to a word of it.
        for n in range(1, BITS + 1):
            other = s ^ np.uint64(n)
            good = np.flatnonzero((s > 0) & (other > np.uint64(n)))
            places.append(good)
            found.append(block[good] ^ (one << np.uint64(n - 1)) ^ (one << (other[good] - one)))
    return np.concatenate(places), np.concatenate(found)


def anchored(distinct: DataFrame, threshold: int, refined: bool) -> DataFrame:
    """(key, fp): each fingerprint of ``distinct`` (fp) at its anchors in both blocks.

    ``refined`` adds to the key one of ``threshold`` + 1 parts of the bits outside the block, one key for
    each; of these parts a link leaves one untouched.
    """
    block, parts = (np.uint64((1 << BITS) - 1), threshold + 1)
    size = (64 - BITS) // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for which in (0, 1):
                shift = np.uint64(BITS * which)
                places, found = anchors((fp >> shift) & block, threshold // 2)
                key = (found << np.uint64(1) | np.uint64(which)).astype(np.int64)
                chosen = fp[places]
                rest = (chosen >> np.uint64(BITS)) if which == 0 else (chosen & block) | (chosen >> np.uint64(2 * BITS) << np.uint64(BITS))
                for part in range(parts if refined else 1):
                    extra = (rest >> np.uint64(part * size)) & np.uint64((1 << size) - 1)
                    extra = (extra * np.uint64(parts) + np.uint64(part)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(extra if refined else np.zeros_like(extra)), pa.array(chosen.view(np.int64))],
                        names=["key", "part", "fp"],
                    )

    return mapped(distinct, run, "key bigint, part bigint, fp bigint")


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (places in ``fps``) that connect what all links among distinct fingerprints connect."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= threshold
            if near.any():
                found = left[near].tolist()
                links += [(at, x) for x in found]
                reached += found
                left = left[~near]
    return links


def _links(cells: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of the fingerprints of each cell; rows of a cell lie together and in order."""
    keys = ["key", "part", "row", "col"]
    sorted_cells = cells.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fps: np.ndarray) -> tuple[list[int], list[int]]:
            signed = fps.view(np.int64)
            found = forest(fps, threshold)
            return [int(signed[a]) for a, _ in found], [int(signed[b]) for _, b in found]

        open_cell, open_fps = None, []
        for batch in batches:
            cell = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            a, b = [], []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                if start == end:
                    continue
                name = tuple(cell[start].tolist())
                if name != open_cell:
                    if len(open_fps):
                        for out, new in zip((a, b), linked(np.concatenate(open_fps))):
                            out += new
                    open_cell, open_fps = name, []
                open_fps.append(fps[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if open_fps:
            a, b = linked(np.concatenate(open_fps))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return mapped(sorted_cells.select(*keys, "fp"), run, "a bigint, b bigint")


def near_fingerprints(
    docs: DataFrame, width: int = 3, threshold: int = 3, seed: int = SEED, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, anything else): its fingerprint and component.

    Texts whose fingerprints differ in at most ``threshold`` bits (0 to 3) are linked. Returns ``doc_id``,
    ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest doc_id reachable).

    A null or empty text has the fingerprint 0, which is linked like any other. Repeated rows and rows
    that share a doc_id are each linked by their own text. A null doc_id takes the smallest id of its
    component, null if there is none. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two blocks of the code cover thresholds up to 3")
    rows = written(fingerprints(docs, width, seed), "op13-fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "op13-distinct")
    refined = distinct.count() * 2**4 > CROWDED * 2 ** (BITS - CHECKS)
    found = written(anchored(distinct.select("fp"), threshold, refined), "op13-anchored")
    sizes = found.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = found.join(sizes, ["key", "part"])
    # A crowded anchor: its rows are dealt into blocks, and each goes wherever its block meets another.
    n = F.when(F.col("size") > block, F.ceil(F.col("size") * 2 / block)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    cells = shared.withColumn("n", n).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = cells.select(
        "key", "part", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "fp"
    )
    links = written(_links(cells, threshold).distinct(), "op13-links")
    roots = components(links, "op13").withColumnsRenamed({"node": "fp"})
    rooted = written(
        distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "op13-rooted"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = written(rooted.join(least, "root").select("fp", "component_id"), "op13-labelled")
    for table in (found, links, rooted, distinct):
        discard(table)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labelled, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
