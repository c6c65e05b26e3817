"""Byte-level BPE encoding and decoding with a vectorised pre-tokenisation.

No regular expression looks at a text. Every code point gets a class from an array; what the pattern of the vocabulary looks
ahead for (is white space followed by white space, is an apostrophe followed by the end of a contraction) is a shift of
that array. The pattern is then an automaton of eight states, a code point is a function from state to state, and functions
compose. The automaton's functions are few, so they are numbered and composition is a table: an associative scan over these numbers
gives the state in front of every code point of a whole slice of texts at once, and with it where each piece begins. The first code point of a
text is a constant function, so texts do not see each other.

Equal pieces of a slice are merged once and are kept for the next slice. Each token keeps the byte at which it ends in the text;
decoding puts every token's bytes where they belong and can do so for any part of a text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.arrays import distinct_spans, slices, spread, text_bytes

#: Bytes of text that are handled at once; a longer text is a slice of its own. The arrays take some 40 times as much.
SLICE = 2 << 20
#: Pieces that a worker remembers with their ids; beyond that it starts anew.
REMEMBERED = 200_000
#: Pieces with more bytes are merged one by one with a heap, as the rounds of a common merge grow with the longest piece.
LONG_PIECE = 256

NONE = np.int32(np.iinfo(np.int32).max)

LETTER, NUMBER, OTHER, BLANK, WHITE = range(5)

# Letters and numbers that Unicode 16.0 added. Python's own table is 15.1.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA))


@cache
def code_point_classes() -> np.ndarray:
    """The class of each code point: letter, number, other, blank (U+0020) or other white space."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    for ranges, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for low, high in ranges:
            kinds[low:high + 1] = kind
    kinds[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    kinds[0x20] = BLANK
    return kinds


# States: nothing that goes on, a run of letters, of numbers, of others, a blank that joins what follows, white space, and an
# apostrophe with one or two letters to come. Symbols: letter, number, other, blank before text, white space before text, white space before
# white space or the end, an apostrophe with one or two letters. Each symbol comes a second time as a text's first.
_FREE, _LETTERS, _NUMBERS, _OTHERS, _LEAD, _WHITES, _ONE, _TWO = range(8)
_BLANK_TEXT, _WHITE_TEXT, _WHITE_MORE, _SHORT, _LONG = range(3, 8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins with it."""
    if symbol == LETTER:
        if state in (_TWO, _ONE):
            return (_ONE if state == _TWO else _FREE), False
        return _LETTERS, state not in (_LETTERS, _LEAD)
    if symbol == NUMBER:
        return _NUMBERS, state not in (_NUMBERS, _LEAD)
    if symbol == OTHER or (symbol in (_SHORT, _LONG) and state in (_OTHERS, _LEAD)):
        return _OTHERS, state not in (_OTHERS, _LEAD)
    if symbol == _WHITE_MORE:
        return _WHITES, state != _WHITES
    return {_BLANK_TEXT: _LEAD, _WHITE_TEXT: _FREE, _SHORT: _ONE, _LONG: _TWO}[symbol], True


@dataclass(frozen=True)
class Automaton:
    """All functions that the symbols generate, by number: the table of their compositions, and what each makes of the free state."""

    of_symbol: np.ndarray
    then: np.ndarray  # flat: number of the first function * functions + number of the second
    functions: int
    from_free: np.ndarray
    begins: np.ndarray  # state * 16 + symbol


@cache
def automaton() -> Automaton:
    plain = [tuple(_step(state, symbol)[0] for state in range(8)) for symbol in range(8)]
    symbols = plain + [(f[_FREE],) * 8 for f in plain]
    whole = [tuple(range(8))]
    for f in whole:  # grows while it is read: every function followed by every symbol
        whole += [g for g in dict.fromkeys(tuple(s[x] for x in f) for s in symbols) if g not in whole]
    number = {f: i for i, f in enumerate(whole)}
    then = np.array([number[tuple(g[x] for x in f)] for f in whole for g in whole], np.uint8)
    begins = np.array([symbol >= 8 or _step(state, symbol)[1] for state in range(8) for symbol in range(16)])
    return Automaton(np.array([number[s] for s in symbols], np.uint8), then, len(whole), np.array([f[_FREE] for f in whole], np.uint8), begins)


def compose(functions: np.ndarray, then: np.ndarray, n: int, width: int = 256) -> np.ndarray:
    """For each place the composition of all functions up to and with it. Rows of ``width`` are composed side by side, then
    the rows' totals in the same way, and each row takes over what stands before it."""
    if not len(functions):
        return functions
    rows = -(-len(functions) // width)
    side = np.zeros(rows * width, np.uint8)  # number 0 is the identity
    side[:len(functions)] = functions
    side = side.reshape(rows, width).T.copy()
    for k in range(1, width):
        side[k] = then[side[k - 1].astype(np.int32) * n + side[k]]
    if rows > 1:
        before = np.append(np.uint8(0), compose(side[-1], then, n, width)[:-1])
        side = then[before.astype(np.int32)[None, :] * n + side]
    return side.T.ravel()[:len(functions)]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point. ``first`` marks each text's first code point."""
    if not len(points):
        return np.zeros(0, bool)
    kind = code_point_classes()[points]
    last = np.append(first[1:], True)
    text_next = np.append(kind[1:] < BLANK, False) & ~last
    symbol = kind.copy()
    white = kind >= BLANK
    symbol[white] = np.where(text_next[white], np.where(kind[white] == BLANK, _BLANK_TEXT, _WHITE_TEXT), _WHITE_MORE)
    marks = np.flatnonzero((points == 0x27) & ~last)
    if len(marks):
        one = points[marks + 1]
        more = ~last[marks + 1]
        two = np.where(more, points[np.minimum(marks + 2, len(points) - 1)], 0)
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
        symbol[marks[((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))]] = _LONG
    symbol = symbol + np.where(first, np.uint8(8), np.uint8(0))
    known = automaton()
    after = known.from_free[compose(known.of_symbol[symbol], known.then, known.functions)]
    before = np.append(np.uint8(_FREE), after[:-1]).astype(np.int32)
    return known.begins[before * 16 + symbol]


@dataclass(frozen=True)
class Ranks:
    """The vocabulary as arrays: the bytes of all tokens one after the other by id, and the pairs that merge."""

    pool: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    single: np.ndarray  # id of each byte
    pairs: np.ndarray  # sorted: left id * number of ids + right id
    merged: np.ndarray

    def whole(self) -> dict[bytes, int]:
        data = self.pool.tobytes()
        return {data[s:s + n]: i for i, (s, n) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=True)) if n}


@cache
def load_ranks(path: str) -> Ranks:
    """Read a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in file if line.strip()}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    sizes = np.array([len(t) for t in tokens], np.int64)
    found = [(ranks[t[:k]] * len(tokens) + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t))
             if t[:k] in ranks and t[k:] in ranks]
    found.sort()
    return Ranks(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes,
                 np.array([ranks[bytes([b])] for b in range(256)], np.int32), np.array([p for p, _ in found], np.int64),
                 np.array([i for _, i in found], np.int32))


class Merger:
    """Ids of pieces, remembered: a piece that is a token as it stands, else merged by the lowest rank first."""

    def __init__(self, ranks: Ranks):
        self.r = ranks
        self.tokens = ranks.whole()
        self.merges: dict[int, int] = {}
        both = ranks.single.astype(np.int64)
        self.first = self._becomes((both[:, None] * len(ranks.sizes) + both[None, :]).ravel())  # for every two bytes
        self._forget()

    def _forget(self) -> None:
        """What is known from the start: each token, which is its own id."""
        self.known = dict(self.tokens)
        self.pool = np.arange(len(self.r.sizes), dtype=np.int32)
        self.starts, self.counts = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In every round each piece merges its leftmost pair of lowest rank; only the pairs beside a merge are looked up anew."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        ids, owner = self.r.single[letters], np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        # What each token becomes with the next one, whose rank is the id; NONE at a piece's end and where nothing merges.
        to = np.append(self.first[letters[:-1].astype(np.int32) * 256 + letters[1:]], NONE)
        to[np.cumsum(sizes) - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(to, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            lowest = np.repeat(least, lengths)
            over = lowest == NONE
            if over.any():
                done.append((owner[over], ids[over]))
                if over.all():
                    break
            hits = np.flatnonzero((to == lowest) & ~over)
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]
            ids[hits] = to[hits]
            keep = ~over
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, to = ids[keep], owner[keep], to[keep]
            at = place[hits]
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near + 1 < len(ids)]
            near, ends = near[owner[near] == owner[near + 1]], at
            to[ends] = NONE
            to[near] = self._becomes(ids[near].astype(np.int64) * len(self.r.sizes) + ids[near + 1])
        owners, got = np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])
        return got[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(pieces))

    def _becomes(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.r.pairs):
            return np.full(len(pairs), NONE)
        at = np.minimum(np.searchsorted(self.r.pairs, pairs), len(self.r.pairs) - 1)
        return np.where(self.r.pairs[at] == pairs, self.r.merged[at], NONE)

    def _alone(self, piece: bytes) -> np.ndarray:
        """One long piece: a heap of ranks over a linked list of tokens."""
        ids = self.r.single[np.frombuffer(piece, np.uint8)].tolist()
        n, width = len(ids), len(self.r.sizes)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if not self.merges:
            self.merges = dict(zip(self.r.pairs.tolist(), self.r.merged.tolist(), strict=True))
        pairs = self.merges
        heap = [(to, i) for i in range(n - 1) if (to := pairs.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            to, i = heapq.heappop(heap)
            k = after[i] if ids[i] >= 0 else n
            if k >= n or pairs.get(ids[i] * width + ids[k]) != to:
                continue  # one of the two has been merged since
            ids[i], ids[k] = to, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
                if (more := pairs.get(to * width + ids[after[i]])) is not None:
                    heapq.heappush(heap, (more, i))
            if before[i] >= 0 and (more := pairs.get(ids[before[i]] * width + to)) is not None:
                heapq.heappush(heap, (more, before[i]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(counts) - counts)
        self.counts, self.pool = np.append(self.counts, counts), np.append(self.pool, ids)

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where distinct pieces are known: their ids are ``pool[starts[place]:][:counts[place]]``."""
        if len(self.known) > len(self.tokens) + REMEMBERED:
            self._forget()
        place = np.array([self.known.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(place < 0)
        short = [p for i in new.tolist() if len(p := pieces[i]) <= LONG_PIECE]
        if short:
            self._remember(short, *self._together(short))
        for i in new.tolist():
            if len(pieces[i]) > LONG_PIECE:
                ids = self._alone(pieces[i])
                self._remember([pieces[i]], ids, np.array([len(ids)]))
        place[new] = [self.known[pieces[i]] for i in new.tolist()]
        return place


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """The bytes as they are if they are UTF-8, else with U+FFFD in the wrong places, and their characters."""
    whole = data.tobytes()
    try:
        return data, offsets, whole.decode()
    except UnicodeDecodeError:
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        parts = [t.encode() for t in texts]
        return (np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64), "".join(texts))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts (mended if they are no UTF-8), the byte at which each piece begins, and the number of pieces of each text."""
    data, offsets, characters = _valid(data, offsets)
    points = np.frombuffer(characters.encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(points), bool)
    begins = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    first[begins] = True
    begin = lead[piece_starts(points, first)]
    return data, offsets, begin, np.diff(np.searchsorted(begin, offsets))


def encode_slice(merger: Merger, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the byte (within its text) at which each token ends, and the bounds of each text's tokens."""
    data, offsets, begin, pieces = cut(data, offsets)
    end = np.append(begin[1:], len(data))
    first, which = distinct_spans(data, begin, end)
    whole = data.tobytes()
    place = merger.places([whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
    starts, sizes = merger.starts[place][which], merger.counts[place][which]
    ids = merger.pool[spread(starts, sizes)]
    bounds = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(pieces))]
    stops = np.cumsum(merger.r.sizes[ids]) - np.repeat(offsets[:-1], np.diff(bounds))
    return ids, stops, bounds


def decode_slice(ranks: Ranks, ids: np.ndarray, stops: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each list of tokens, every token put in front of the place at which it ends."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(ranks.sizes)):
        raise ValueError(f"an id lies outside the vocabulary of {len(ranks.sizes)} tokens")
    sizes = ranks.sizes[ids]
    filled = np.diff(bounds) > 0
    lengths = np.zeros(len(bounds) - 1, np.int64)
    lengths[filled] = stops[bounds[1:][filled] - 1]
    base = np.append(0, np.cumsum(lengths))
    to = stops - sizes + np.repeat(base[:-1], np.diff(bounds))
    out = np.zeros(int(base[-1]), np.uint8)
    out[spread(to, sizes)] = ranks.pool[spread(ranks.starts[ids], sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(base.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _types(fields) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The ``keep`` columns (none of them called ``ids``, ``ends`` or ``decoded``), ``ids``, the tokens of the whole text, and
    ``ends``, the byte at which each ends. Nothing is shuffled; a lost task is run again.

    Null and empty texts have no tokens. A text's place, its neighbours and repeated rows make no difference; bytes that are no UTF-8 are read as
    U+FFFD. Special tokens have no meaning. A text of any length is encoded whole; memory is about 40 times the longest
    text or ``SLICE``. With ``decoded`` the ids are decoded in the same pass, as :func:`decode` does for stored ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the vocabulary's size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(shared.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, SLICE):
                ids, stops, bounds = encode_slice(merger, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                more = [decode_slice(shared.value, ids, stops, bounds)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(bounds, ids), _lists(bounds, stops), *more],
                                                 names=[*part.schema.names[:-1], "ids", "ends", *["decoded"] * decoded])

    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("\x00text"))  # no table can have this name twice
    return inner.mapInArrow(run, _types(inner.schema.fields[:-1]) + "ids array<int>, ends array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", ends_col: str = "ends") -> DataFrame:
    """All columns and ``decoded``, the bytes of the tokens. Null and empty lists give no bytes; an id that the vocabulary
    lacks is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                ids, ends = part.column(names.index(ids_col)), part.column(names.index(ends_col))
                bounds = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
                out = decode_slice(shared.value, ids.flatten().to_numpy(), ends.flatten().to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*names, "decoded"])

    return encoded.mapInArrow(run, _types(encoded.schema.fields) + "decoded binary")
