"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoder. A piece's bytes are read left to right. For every position the transducer knows the
last token that the merge list gives to the bytes up to there; that token leads back to an
earlier position, so the positions form a tree. Its state is what the next bytes depend on:
of every position from which a token may still grow, the node of the vocabulary's tree that
the bytes behind it lead to, and the token before it. Different beginnings come to the same
states, whose steps are remembered, so new words mostly take known steps. Tokens are stable,
and are emitted, once all positions that later bytes can still lead back to (the last
``longest`` ones) descend from their end. ``lookahead`` computes from the merge list within
how many bytes that happens, so a piece of any length needs memory for one such stretch.
Texts are cut into pieces window by window, and ids go on to their use as they come: beside
the text itself, what is held does not grow with it.

Decoder. A state machine takes ids and gives text as soon as its bytes are whole characters;
broken sequences become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linewright.llm.arrow import mapped

#: The public splitting pattern of this family of vocabularies (fixed value).
#: Its first two parts stand in front here, as nothing else can match where they do.
PIECES = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# What a Python worker remembers, so that it need not work it out again; full tables start anew.
REMEMBERED = 300_000  # tokens of pieces; the last full table is kept beside the new one
SHORT = 48  # only of pieces up to this many characters
BORDERS = 200_000  # whether two tokens fit side by side
PREFIXES = 300_000  # states that the first bytes of pieces lead to
ENTRIES = 2_500_000  # open positions of all these states, and steps between them

WINDOW = 1 << 16  # characters of a text that are cut into pieces at a time
SEEN = 3  # characters from its start on which the end of a piece can depend, beyond its own


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: visible Latin-1 characters
    are themselves, the other bytes are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in model["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in plain.items()}
        self.merges: dict[tuple[int, int], int] = {}  # neighbours -> rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.bytes_of, -1)  # of a token's last merge
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            self.merges[pair] = rank
            if new not in self.parts:
                self.parts[new], self.rank[new] = pair, rank
        self.longest = max(map(len, self.bytes_of.values()))

    @cached_property
    def tree(self) -> dict[int, tuple[int, int | None]]:
        """Tokens byte by byte: node + byte -> (node, the token that ends there).

        Nodes are multiples of 256; the root is 0, and so is a node that no token goes on from.
        """
        inner: dict[bytes, int] = {b"": 0}
        for raw in self.bytes_of.values():
            for n in range(len(raw) - 1, 0, -1):
                if raw[:n] in inner:
                    break
                inner[raw[:n]] = 256 * len(inner)
        token_of = {raw: token for token, raw in self.bytes_of.items()}
        return {
            inner[raw[:-1]] + raw[-1]: (inner.get(raw, 0), token_of.get(raw))
            for raw in {**inner, **token_of}
            if raw
        }

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge list leaves these two tokens side by side.

        Undoes the merges of both, latest first. A merge across the border that would have
        come before the one just undone rules the pair out; of equal merges the one further
        left comes first.
        """
        before = len(self.merges)
        while self.merges.get((left, right), before) >= before:
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]
        return False

    @cached_property
    def lookahead(self) -> int:
        """Bytes behind a token's end on which that token can hang, at most.

        Later bytes change a token only by an earlier merge of one of its ends with what
        follows. What follows may be changed in turn, by a still earlier merge, and so on: a
        chain of falling ranks. Taken in the order of their ranks, each merge reaches as far as
        its right part and the farthest earlier merge that starts with an end of that part.
        """
        farthest: dict[int, int] = {}
        for left, right in self.merges:  # in the order of ranks
            reach, end = farthest.get(right, 0), right
            while end in self.parts:
                end = self.parts[end][1]
                reach = max(reach, farthest.get(end, 0))
            reach += len(self.bytes_of[right])
            farthest[left] = max(farthest.get(left, 0), reach)
        return max(farthest.values(), default=0)


class State(dict):
    """Where some bytes lead to. As a dict it remembers the states that one more byte leads to.

    ``open`` lists the open positions from left to right, each as the node that the bytes behind
    it lead to and the token before it; the last one is where the bytes end. ``last`` is the token
    that ends there, ``width`` how many bytes it has.
    """

    __slots__ = ("last", "open", "width")

    def __init__(self, open_positions: tuple[int | None, ...], width: int):
        self.open, self.last, self.width = open_positions, open_positions[-1], width


class Memory:
    """What transducers of one model have found out so far."""

    def __init__(self):
        self.borders: dict[tuple[int, int], bool] = {}
        self.start = State((0, None), 0)
        self.last: dict[tuple[int | None, ...], State] = {}  # states by what the last bytes leave open
        self.entries = 0  # their open positions, and the steps between them

    def trim(self) -> None:
        if len(self.borders) >= BORDERS:
            self.borders.clear()
        if len(self.last) >= PREFIXES or self.entries >= ENTRIES:
            self.start.clear()
            for state in self.last.values():  # they lead to each other
                state.clear()
            self.last.clear()
            self.entries = 0


class Transducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, model: MergeList, memory: Memory):
        self.model, self.memory = model, memory
        self.state = memory.start
        self.held: list[State] = []  # of each position after the last emitted token
        self.most = 2 * (model.lookahead + model.longest)

    def _step(self, state: State, byte: int) -> State:
        """The state behind the next byte.

        Just one of the tokens that end there fits the one it follows; the longest is the
        likeliest, and that of one byte needs no check.
        """
        model, memory = self.model, self.memory
        memory.trim()
        tree, borders = model.tree, memory.borders
        going_on, last = [], None
        ways = iter(state.open)
        for node, left in zip(ways, ways):
            found = tree.get(node + byte)
            if found is None:
                continue
            inner, token = found
            if last is None and token is not None:
                good = left is None or not node or borders.get((left, token))
                if good is None:
                    good = borders[left, token] = model.fits(left, token)
                if good:
                    last = token
            if inner:
                going_on += (inner, left)
        key = (*going_on, 0, last)
        after = memory.last.get(key)
        if after is None:
            after = memory.last[key] = State(key, len(model.bytes_of[last]))
            memory.entries += len(key) // 2
        state[byte] = after
        memory.entries += 1
        return after

    def _path(self, position: int) -> list[int]:
        """Tokens from the first held byte up to ``position``."""
        tokens, held = [], self.held
        while position:
            state = held[position - 1]
            tokens.append(state.last)
            position -= state.width
        return tokens[::-1]

    def _stable(self) -> int:
        """The last position that every position later bytes can lead back to descends from."""
        n = len(self.held)
        open_ends = set(range(max(0, n - self.model.longest), n + 1))
        while len(open_ends) > 1:
            latest = max(open_ends)
            open_ends.remove(latest)
            open_ends.add(latest - self.held[latest - 1].width)
        return open_ends.pop()

    def feed(self, raw: bytes) -> list[int]:
        """Read bytes; the tokens that have become stable."""
        held, state = self.held, self.state
        out: list[int] = []
        at = 0
        while at < len(raw):
            part = raw[at : at + max(1, self.most - len(held))]
            at += len(part)
            for byte in part:
                try:
                    state = state[byte]
                except KeyError:
                    state = self._step(state, byte)
                held.append(state)
            if len(held) >= self.most:
                position = self._stable()
                out += self._path(position)
                del held[:position]
        self.state = state
        return out

    def finish(self) -> list[int]:
        return self._path(len(self.held))


class Encoder(dict):
    """Ids of whole texts. As a dict it remembers the ids of short pieces."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        self.model = MergeList(path)
        self.memory = Memory()
        self.pieces = regex.compile(PIECES)
        names = sorted(map(regex.escape, self.model.special), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(names)})") if names else None

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            transducer = Transducer(self.model, self.memory)
            ids = (*transducer.feed(piece.encode()), *transducer.finish())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def stream(self, text: str) -> Iterator[Sequence[int]]:
        """Ids of a text, some at a time; holds those of one window."""
        start = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, start, found.start())
            yield (self.model.special[found[0]],)
            start = found.end()
        yield from self._plain(text, start, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[Sequence[int]]:
        """Ids of a stretch without special tokens."""
        while at < end:
            stop = min(at + WINDOW, end)
            found = self.pieces.findall(text, at, stop)
            if stop < end:  # what ends too near to the window's end may look different with the rest
                while found and stop + SEEN > at + WINDOW:
                    stop -= len(found.pop())
                if not found:
                    stop = self.pieces.match(text, at, end).end()
                    transducer = Transducer(self.model, self.memory)
                    for k in range(at, stop, WINDOW):
                        yield transducer.feed(text[k : min(k + WINDOW, stop)].encode())
                    yield transducer.finish()
            if found:
                yield list(chain.from_iterable(map(self.__getitem__, found)))
            at = stop

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The Python worker's encoder; workers serve several tasks."""
    return Encoder(path)


class Decoder:
    """Ids in, text out as soon as its characters are whole."""

    def __init__(self, model: MergeList):
        self.bytes_of = model.bytes_of | {i: t.encode() for t, i in model.special.items()}
        self._bytes = self.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self._bytes, ids)))

    def finish(self) -> str:
        rest = self.state.decode(b"", final=True)
        self.state.reset()
        return rest


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text, anything else).

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (lowercase hex of the decimal ids joined by
    commas) and ``decoded_sha256`` (of the decoded text in UTF-8). A null text is empty. Null
    ids and repeated rows go through as they are; an empty table gives no rows. ``path`` has
    to be readable on every executor, as installed files are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        decoder = Decoder(encoder.model)
        decimal = {i: str(i) for i in decoder.bytes_of}.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, listed, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.stream(text.as_py() or ""):
                    if not ids:
                        continue
                    if n:
                        listed.update(b",")
                    n += len(ids)
                    listed.update(",".join(map(decimal, ids)).encode())
                    back.update(decoder.feed(ids).encode())
                back.update(decoder.finish().encode())
                rows.append((n, listed.hexdigest(), back.hexdigest()))
            n, listed, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return mapped(
        docs.select("doc_id", "text"),
        run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
