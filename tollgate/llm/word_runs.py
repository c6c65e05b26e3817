"""Periodic runs of words, from Lyndon arrays.

A run is a stretch of words that repeats with a period and that no neighbour prolongs. Every run holds a Lyndon root, which is
the longest Lyndon word at its place under one of the two orders of words. The first phase of a grouping suffix sorter
yields the lengths of these: suffixes are grouped by their first word; groups are taken from the largest to the smallest, each
suffix of a group points to the nearest suffix on its left that lies in a smaller group, and the suffixes pointed to
equally often move together into a new group right above their own, their words prolonged by the group's as often as they were pointed
to. When a group is taken, its words are the longest Lyndon word of each of its suffixes. Under the opposite order the same is done with
the words numbered from the other end. Roots that repeat at once are extended to both sides by longest common extensions, which go
down through names of stretches of 1, 2, 4, ... words; equal names mean equal stretches, so nothing rests on hashes.

Only runs of at least ``REPEATS`` periods are wanted. A word of such a run occurs in it ``REPEATS`` times, so a
word that is rarer than that in its stretch cannot lie in one: texts are cut at rare words, and the stretches that remain again,
until nothing changes. What is left holds every such run whole, and its neighbours are words that do not prolong it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.arrays import distinct_spans, find_words, slices, spread, text_bytes

#: A run has at least so many words, and so many periods.
LEAST, REPEATS = 6, 4
_SLICE = 2 << 20
#: Texts are cut at rare words so many times at most; more rounds would only save work.
_ROUNDS = 40


def lyndon_lengths(words: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by groups. Words are numbers from 0 without gaps."""
    n, kinds = len(words), max(words, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, w in enumerate(words):
        members[w].append(i)
    group, length, stays = list(words), [1] * kinds, [len(m) for m in members]
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours among the suffixes that are not yet taken
    out, pointed = [0] * n, [0] * n
    g = kinds - 1
    while g >= 0:
        size, targets = length[g], []
        # From left to right, so that those of the group further left are gone when a suffix looks left.
        for i in members[g] if stays[g] else ():
            if group[i] == g:
                out[i] = size
                a, b = left[i], right[i]
                left[b], right[a] = a, b
                if a >= 0:
                    if not pointed[a]:
                        targets.append(a)
                    pointed[a] += 1
        moves: dict[tuple[int, int], list[int]] = {}
        for a in targets:
            moves.setdefault((-pointed[a], group[a]), []).append(a)
        # Each new group comes right above its old one, so those pointed to most often are first and end up highest.
        for (times, old), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
            new, up = len(length), above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            length.append(length[old] - times * size)
            members.append(moved)
            stays.append(len(moved))
            stays[old] -= len(moved)
            for a in moved:
                group[a], pointed[a] = new, 0
        g = below[g]
    return out


def stretches(names: np.ndarray, text: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the number of the stretch of each: stretches have at least ``least``
    words, and each word occurs at least ``repeats`` times in its stretch."""
    places, part = np.arange(len(names)), text.astype(np.int64)
    done_places, done_parts, given = [], [], 0
    kinds = int(names.max()) + 1 if len(names) else 1
    for turn in range(_ROUNDS):
        _, which, counts = np.unique(part * kinds + names[places], return_inverse=True, return_counts=True)
        keep = counts[which] >= repeats
        whole = np.ones(int(part.max()) + 1 if len(part) else 0, bool)
        whole[part[~keep]] = False
        over = whole[part] if turn < _ROUNDS - 1 else np.ones(len(part), bool)
        # A stretch that lost nothing is done; the others fall apart at the words they lost.
        stays = over if turn < _ROUNDS - 1 else keep
        left = keep & ~over
        for chosen, out in ((stays, True), (left, False)):
            at, of = places[chosen], part[chosen]
            new = np.append(True, (np.diff(at) > 1) | (np.diff(of) != 0))[:len(at)]
            label = np.cumsum(new) - 1
            sizes = np.bincount(label, minlength=1)
            good = sizes[label] >= least if len(at) else np.zeros(0, bool)
            if out:
                done_places.append(at[good])
                done_parts.append(given + label[good])
                given += len(sizes)
            else:
                next_places, next_part = at[good], label[good]
        places, part = next_places, next_part
        if not len(places):
            break
    place, part = np.concatenate(done_places), np.concatenate(done_parts)
    order = np.argsort(place, kind="stable")
    return place[order], part[order]


class Extensions:
    """Longest common extensions in a row of stretches, by names of all parts of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names = [np.unique(words, return_inverse=True)[1]]
        self.n = len(words)
        while 2 << len(self.names) - 1 <= longest:
            last, half = self.names[-1], 1 << len(self.names) - 1
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1])

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on are those from ``b`` on."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            x, y = a + found, b + found
            fits = np.maximum(x, y) < len(names)
            fits[fits] = names[x[fits]] == names[y[fits]]
            found += fits.astype(np.int64) << k
        return found

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to ``a`` are those up to ``b``."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            x, y = a - found - (1 << k) + 1, b - found - (1 << k) + 1
            fits = np.minimum(x, y) >= 0
            fits[fits] = names[x[fits]] == names[y[fits]]
            found += fits.astype(np.int64) << k
        return found


def find_runs(names: np.ndarray, text: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows ``place, length, period`` of all runs, by place and period. ``names`` are numbers of words, ``text`` the text of each."""
    none = np.zeros((0, 3), np.int64)
    places, part = stretches(names, text, least, repeats)
    if not len(places):
        return none
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(begins[1:], len(part))
    # Between stretches stands a word of its own, so that nothing extends over it.
    at = np.arange(len(places)) + np.cumsum(np.append(0, part[1:] != part[:-1]))
    words = np.zeros(int(at[-1]) + 1, np.int64)
    words[:] = int(names.max()) + 1 + np.arange(len(words))
    words[at] = names[places]
    lengths = [np.zeros(len(places), np.int64) for _ in range(2)]
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        kinds, own = np.unique(names[places[a:b]], return_inverse=True)
        lengths[0][a:b] = lyndon_lengths(own.tolist())
        lengths[1][a:b] = lyndon_lengths((len(kinds) - 1 - own).tolist())
    known = Extensions(words, int((ends - begins).max()))
    back = np.repeat(np.arange(len(places)), np.diff(np.append(at, len(words))))  # from the row of stretches to places
    found = []
    for period in lengths:
        root = np.flatnonzero(at + period < len(words))
        root = root[words[at[root]] == words[at[root] + period[root]]]
        a, p = at[root], period[root]
        right, left = known.right(a, a + p), known.left(a - 1, a + p - 1)
        good = left + p + right >= np.maximum(least, repeats * p)
        found.append(np.stack([places[back[(a - left)[good]]], (left + p + right)[good], p[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(begin: np.ndarray, end: np.ndarray, data: np.ndarray, text: np.ndarray, texts: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts without what runs repeat, words joined by one blank, and where each text begins."""
    marks = np.zeros(len(begin) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    sizes, of = (end - begin)[keep], text[keep]
    lead = np.append(False, of[1:] == of[:-1])[:len(keep)].astype(np.int64)  # a blank in front of all but a text's first word
    out = np.full(int((sizes + lead).sum()), 0x20, np.uint8)
    to = np.cumsum(sizes + lead) - sizes
    out[spread(to, sizes)] = data[spread(begin[keep], sizes)]
    return out, np.append(0, np.cumsum(np.bincount(of, weights=sizes + lead, minlength=texts))).astype(np.int64)


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST,
                  repeats: int = REPEATS) -> DataFrame:
    """The ``keep`` columns (none called ``runs`` or ``collapsed``), ``runs``, an array of (start, length, period) in words, by
    start and period, and ``collapsed``, the words that no run repeats, joined by one blank. Nothing is shuffled.

    Runs are maximal, with their smallest period and at least ``least`` words and ``repeats`` periods (2 or more). A
    repeated word is one beyond its run's first period. Null, empty and blank texts have no runs and collapse to the empty
    text. Case counts. Repeated rows and ids make no difference; a text of any length is handled whole, with memory in
    proportion to the longest text times the logarithm of its longest stretch of frequent words.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, _SLICE):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                begin, end, text = find_words(part, at)
                _, names = distinct_spans(part, begin, end)
                runs = find_runs(names, text, least, repeats)
                out, bounds = collapse(begin, end, part, text, j - i, runs)
                first = np.searchsorted(text, np.arange(j - i))  # the number of each text's first word
                of = text[runs[:, 0]]
                rows = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(j - i + 1)), pa.int32()), rows)
                texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], lists, texts.cast(pa.string())],
                                                 names=[*batch.schema.names[:-1], "runs", "collapsed"])

    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("\x00text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in inner.schema.fields[:-1])
    return inner.mapInArrow(run, types + "runs array<struct<start: long, length: long, period: long>>, collapsed string")
