"""Language of a text by cross-parsing: each language's suffix automaton cuts the text into longest matches.

Per language a bounded sample of labelled rows is made one reference string and its suffix automaton: whole texts, as many as
``FIT_LETTERS`` letters take. A text is read once per language: a phrase goes on while the automaton has a way, so it
is the longest match with any part of the reference, and the next phrase begins where it ends. A phrase costs the bits
that name a place in the reference, so the count of phrases is normalised by the logarithm of its length, and the
language with the smallest cost wins.

Parsing is a walk from state to state, done for many texts in step. Long texts are walked in segments side by side; each segment
is then walked again from the state in which the one before it ended, until both walks meet, so the phrases counted are those of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.arrays import slices, text_bytes

#: Rows per language at most, and letters after which no further text is taken. Longer texts than LONGEST characters are not drawn.
FIT_TEXTS, FIT_LETTERS, LONGEST = 120, 30_000, 200_000
#: Letters of a text that are walked side by side; this does not affect the result.
SEGMENT = 512
UNKNOWN = "und"
#: A passage: some 50 characters of a line and sentence, and the word that begins there.
PASSAGE = r"[^\r\n.!?。！？]{1,50}[^\s.!?。！？]{0,20}"
#: Entries of a table of all ways; an automaton with more (an alphabet of thousands) keeps a sorted list of its ways.
TABLE = 4_000_000
_SLICE = 1 << 20


def _folded(code: int) -> str:
    low = chr(code).lower()
    return low if len(low) == 1 else chr(code)


@dataclass(frozen=True)
class Ways:
    """Where each state goes with each symbol: ``next state * 4 + phrases begun``.

    A way that the automaton lacks ends the phrase: the symbol begins the next one, or is a phrase by itself if the
    string does not hold it. Either a table, or the sorted numbers (state and symbol) of the ways that there are.
    """

    width: int
    first: np.ndarray  # of the root
    table: np.ndarray | None
    keys: np.ndarray
    targets: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.ravel()[state * np.int32(self.width) + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at] * np.int32(4), self.first[symbol])


def automaton(symbols: list[int], width: int) -> Ways:
    """The suffix automaton of a string."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in ways[p]:
            ways[p][s] = new
            p = link[p]
        if p >= 0:
            q = ways[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(ways)
                ways.append(dict(ways[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and ways[p].get(s) == q:
                    ways[p][s] = twin
                    p = link[p]
        last = new
    # From the root a known symbol begins a phrase, an unknown one is a phrase; elsewhere a missing way restarts there.
    first = np.ones(width, np.int32)
    for s, to in ways[0].items():
        first[s] = to * 4 + 1
    if len(ways) * width <= TABLE:
        table = np.tile(first, (len(ways), 1))
        for state in range(1, len(ways)):
            for s, to in ways[state].items():
                table[state, s] = to * 4
        return Ways(width, first, table, np.zeros(0, np.int64), np.zeros(0, np.int32))
    inner = sorted((state * width + s, to) for state in range(1, len(ways)) for s, to in ways[state].items())
    return Ways(width, first, None, np.array([k for k, _ in inner], np.int64), np.array([to for _, to in inner], np.int32))


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    tables: list[Ways]
    bits: list[float]
    symbol: np.ndarray  # of each code point: 0 between words
    letter: np.ndarray  # whether a code point is a letter


def _symbols(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with one gap for each run of other characters, how many each text has, and all code points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = symbol[codes]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != 0) | (got[:-1] != 0) | (owner[1:] != owner[:-1])
    return got[keep], np.bincount(owner[keep], minlength=len(texts)), codes


def build(references: dict[str, list[str]]) -> LanguageModel:
    """Every letter of a reference has a symbol of its own; one symbol stands for all letters that none holds."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kind])
    part = np.array([k in "LM" for k in kind])
    seen = Counter(_folded(ord(c)) for texts in references.values() for t in texts for c in t if part[ord(c)])
    known = {c: i + 1 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    width = len(known) + 2
    symbol = np.zeros(0x110000, np.min_scalar_type(width))
    for code in np.flatnonzero(part).tolist():
        symbol[code] = known.get(_folded(code), width - 1)
    names, tables, bits = [], [], []
    for name, texts in sorted(references.items()):
        got, counts, _ = _symbols(texts, symbol)
        ends = np.cumsum(counts)
        string = [s for e, n in zip(ends, counts, strict=True) for s in [*got[e - n:e].tolist(), 0]]
        if any(string):
            names.append(name)
            tables.append(automaton(string, width))
            bits.append(float(np.log2(len(string) + 1)))
    return LanguageModel(names, tables, bits, symbol, letter)


def fit(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        texts: int = FIT_TEXTS, letters: int = FIT_LETTERS) -> LanguageModel:
    """Learn from whole texts, those with the smallest md5 of their id: per language as many rows as it takes to have ``letters``
    letters, at most ``texts``. Rows without a letter or language, and texts of more than ``LONGEST`` characters, are not
    drawn; a repeated id or text is a row like any other.

    A passage (a sentence or line, cut where it is long) that several of a language's texts hold is read once.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.length(text_col) <= LONGEST)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("by"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("by", "text"))
    chosen = rows.withColumn("place", place).where(F.col("place") <= texts)
    passages = chosen.select("lang", "place", F.posexplode(F.expr(f"regexp_extract_all(text, r'{PASSAGE}', 0)")).alias("at", "passage")).select(
        "lang", "place", "at", F.trim("passage").alias("passage")).where(F.col("passage").rlike(r"\p{L}"))
    once = passages.groupBy("lang", "passage").agg(F.min(F.struct("place", "at")).alias("first")).select("lang", "passage", "first.*")
    size = F.length(F.regexp_replace("passage", r"[^\p{L}\p{M}]+", ""))
    whole = once.groupBy("lang", "place").agg(F.sum(size).alias("size"), F.array_sort(F.collect_list(F.struct("at", "passage"))).alias("parts"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    taken = whole.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < letters)
    references: dict[str, list[str]] = {}
    for row in taken.select("lang", "place", F.array_join("parts.passage", "\n").alias("text")).orderBy("lang", "place").collect():
        references.setdefault(row["lang"], []).append(row["text"])
    return build(references)


def phrases(got: np.ndarray, counts: np.ndarray, tables: list[Ways]) -> np.ndarray:
    """Phrases of each text (rows) under each automaton (columns)."""
    ends = np.cumsum(counts)
    pieces = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - counts)[owner] + number * SEGMENT
    size = np.minimum(ends[owner] - begin, SEGMENT)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
    out = np.zeros((len(counts), len(tables)))
    for column, ways in enumerate(tables):
        states, begun = np.zeros(len(got), np.int32), np.zeros(len(got), np.int8)
        state = np.zeros(len(order), np.int32)
        for step in range(longest):
            at = begin[order[:active[step]]] + step
            to = ways.step(state[:active[step]], got[at])
            begun[at] = to & 3
            state[:active[step]] = states[at] = to >> 2
        total = np.add.reduceat(begun, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
        out[:, column] = np.bincount(owner, weights=total + _corrections(got, begin, size, number, states, begun, ways), minlength=len(counts))
    return out


def _corrections(got: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray, states: np.ndarray, begun: np.ndarray, ways: Ways) -> np.ndarray:
    """What the phrases of each segment change by if it is walked from where the segment before it ends.

    Two walks that are in one state at one place are the same from there on, so a segment is left as soon as they meet. One in
    which they never meet ends elsewhere, and the next is looked at again.
    """
    change = np.zeros(len(begin), np.int64)
    last = states[begin + size - 1] if len(begin) else np.zeros(0, np.int32)
    todo = np.flatnonzero(number > 0)
    while len(todo):
        change[todo] = 0
        ended = states[begin + size - 1]
        open_, state, step = todo, last[todo - 1], 0
        while len(open_):
            at = begin[open_] + step
            to = ways.step(state, got[at])
            change[open_] += (to & 3) - begun[at]
            state, step = to >> 2, step + 1
            apart, over = state != states[at], size[open_] == step
            ended[open_[apart & over]] = state[apart & over]
            open_, state = open_[apart & ~over], state[apart & ~over]
        moved = todo[ended[todo] != last[todo]]
        last[moved] = ended[moved]
        todo = moved[moved + 1 < len(begin)] + 1
        todo = todo[number[todo] > 0]
    return change


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score``, the winner's share of ``2 ** -cost`` over all languages.

    ``und`` with score 0 for a text that is null or has no letter, and for all texts if nothing was learned. Equal costs
    go to the first name. Repeated ids and texts are rows like any other. The automata are broadcast: their size is that of the
    sample, at most a few MB for each language whatever the data; so it grows with the number of languages only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = text_col in keep  # a text that is kept is not sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(keep.index(text_col) if kept else len(keep))
            _, offsets = text_bytes(column)
            for i, j in slices(offsets, _SLICE):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                got, counts, codes = _symbols(texts, m.symbol)
                sums = np.concatenate([[0], np.cumsum(m.letter[codes])])
                ends = np.cumsum([len(t) for t in texts])
                lettered = sums[ends] > sums[ends - [len(t) for t in texts]]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m.names:
                    cost = phrases(got, counts, m.tables) * np.array(m.bits)
                    best = cost.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000)).sum(axis=1)
                    names = [m.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    scores = np.where(lettered, share, 0.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(names, pa.string()), pa.array(scores)],
                                                 names=[*keep, "lang_pred", "score"])

    inner = docs.select(*[F.col(c) for c in keep], *[] if kept else [F.col(text_col).alias("\x00text")])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:len(keep)])
    return inner.mapInArrow(run, f"{types}, lang_pred string, score double")
