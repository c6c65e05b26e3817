"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (between white space, counted over the whole corpus) are compiled with their ids into an automaton that
shares prefixes and suffixes. Each way carries a number; the numbers on a word's path add up to its place in the sorted
lexicon, where its ids are found. The file goes to every machine and is mapped into memory there, so all workers of a machine
share one copy. Words that the lexicon lacks are merged by rank, many at once, with the same result.

The tokenizer file is that of the tokenizers library: NFC, lower case, a split into letters, digits and other runs, bytes as
characters, merges with a mark at the end of a word. Its special tokens are ids wherever their text stands.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.arrays import find_words, hash_spans, slices, text_bytes
from tollgate.session import work_folder
from tollgate.sources.artifacts import materialize

#: Words of the lexicon: the most frequent ones, as many counts as fit. A word's bytes are at most WORD_BYTES.
LEXICON_WORDS = 50_000
WORD_BYTES = 48
_SLICE, _TALLY = 2 << 20, 4 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[str]  # by id
    inner: np.ndarray  # id of each byte inside a word
    final: np.ndarray  # id of each byte at a word's end
    pairs: np.ndarray  # sorted: left id * number of ids + right id
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    pattern: str


@cache
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, end = whole["model"], whole["model"]["end_of_word_suffix"]
    vocab = dict(model["vocab"])
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    tokens = [""] * (max(*vocab.values(), *special.values()) + 1)
    for token, i in (vocab | special).items():
        tokens[i] = token
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pairs = np.array([vocab[a] * len(tokens) + vocab[b] for a, b in merges], np.int64)
    # A pair that is listed twice has the rank of its last place.
    order = np.lexsort((-np.arange(len(pairs)), pairs))
    order = order[np.append(True, pairs[order][1:] != pairs[order][:-1])] if len(order) else order
    merged = np.array([vocab[a + b] for a, b in merges], np.int32)
    letters = byte_characters()
    return Vocabulary(tokens, np.array([vocab[c] for c in letters], np.int32), np.array([vocab[c + end] for c in letters], np.int32),
                      pairs[order], order.astype(np.int32), merged[order], special,
                      whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])


class Encoder:
    """Exact ids of words: normalised, split and merged by rank."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        # The same split for lower-case ASCII without white space or control characters.
        self.ascii_split = regex.compile(vocabulary.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").encode())
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def pieces(self, word: bytes) -> list[bytes | int]:
        """What is merged by itself, and ids of special tokens."""
        if word.isascii() and min(word, default=0) > 32 and b"<|" not in word:
            return [word.lower()] if word.isalpha() else self.ascii_split.findall(word.lower())
        text, out = word.decode("utf-8", "replace"), []
        # The lower case of a whole text is that of its characters, but for a sigma at its end.
        if text.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and (low := text.lower()).isalpha():
            return [low.encode()]
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.v.special[part])
            elif part:
                low = "".join(c.lower() for c in regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part)))
                out += [m.encode() for m in self.split.findall(low)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. In every round each piece merges its leftmost pair of lowest rank."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.v.inner[data]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.v.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        width, last, none = len(self.v.tokens), len(self.v.pairs) - 1, np.int32(1 << 30)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = None
        while len(ids) > 1 and last >= 0:
            pair = ids[:-1].astype(np.int64) * width + ids[1:]
            at = np.minimum(np.searchsorted(self.v.pairs, pair), last)
            good = (self.v.pairs[at] == pair) & (owner[:-1] == owner[1:])
            ranks = np.append(np.where(good, self.v.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(ids)))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            finished = lowest == none
            if finished.all():
                break
            hit = (ranks == lowest) & ~finished
            hits = np.flatnonzero(hit)
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]
            ids[hits] = self.v.merged[at[hits]]
            if finished.any():
                done.append((owner[finished], ids[finished]))
            keep = ~finished
            keep[hits + 1] = False
            ids, owner = ids[keep], owner[keep]
        done.append((owner, ids))
        owners, got = np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(owners, kind="stable")
        return got[order], np.bincount(owners, minlength=len(pieces))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        parts = [self.pieces(w) for w in words]
        texts = [p for ps in parts for p in ps if isinstance(p, bytes)]
        got, counts = self.merge(texts) if texts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        flat = [(w, p) for w, ps in enumerate(parts) for p in ps]
        if len(flat) > len(texts):  # some are special tokens: ids by themselves
            plain = np.array([isinstance(p, bytes) for _, p in flat])
            every = np.ones(len(flat), np.int64)
            every[plain] = counts
            ends = np.cumsum(every)
            out = np.zeros(int(ends[-1]), np.int32)
            out[ends[~plain] - 1] = [p for _, p in flat if not isinstance(p, bytes)]
            out[np.repeat(plain, every)] = got
            got, counts = out, every
        owner = np.array([w for w, _ in flat], np.int64)
        return got, np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64) if len(flat) else np.zeros(len(words), np.int64)


def compile_lexicon(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The automaton and the ids of sorted distinct words as one file of arrays."""
    nodes: dict[tuple, int] = {}
    below: list[int] = []
    final: list[int] = []
    keys: list[int] = []
    targets: list[int] = []
    numbers: list[int] = []

    def node(low: int, high: int, depth: int) -> int:
        ends = low < high and len(words[low]) == depth
        at, ways = low + ends, []
        while at < high:
            letter, first = words[at][depth], at
            while at < high and words[at][depth] == letter:
                at += 1
            ways.append((letter, node(first, at, depth + 1)))
        mark = (ends, tuple(ways))
        if mark not in nodes:  # equal endings are one state
            number = nodes[mark] = len(below)
            count = int(ends)
            for letter, to in ways:
                keys.append(number * 256 + letter)
                targets.append(to)
                numbers.append(count)
                count += below[to]
            below.append(count)
            final.append(int(ends))
        return nodes[mark]

    root = node(0, len(words), 0)
    head = np.array([len(keys), len(below), len(words), len(ids), root], np.int64)
    return b"".join([head.tobytes(), np.array(keys, np.int64).tobytes(), np.append(0, np.cumsum(counts)).astype(np.int64).tobytes(),
                     *[np.array(x, np.int32).tobytes() for x in (targets, numbers, final, ids)]])


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        arcs, states, words, ids, self.root = np.fromfile(path, np.int64, 5).tolist()
        at = 40

        def part(kind, n):
            nonlocal at
            got = np.memmap(path, kind, "r", at, n) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
            return got

        self.keys, self.starts = part(np.int64, arcs), part(np.int64, words + 1)
        self.targets, self.numbers, self.final, self.ids = part(np.int32, arcs), part(np.int32, arcs), part(np.int32, states), part(np.int32, ids)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for those it lacks: all words walk together, a letter at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return place
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        live = np.flatnonzero((sizes > 0) & (sizes <= WORD_BYTES))
        state, total, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            live, at = live[on], at[on]
            state, total, step = self.targets[at].astype(np.int64), total[on] + self.numbers[at], step + 1
            over = sizes[live] == step
            good = over & (self.final[state] == 1)
            place[live[good]] = total[good]
            live, state, total = live[~over], state[~over], total[~over]
        return place


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, which of them each word is, and the number of words of each text."""
    begin, end, text = find_words(data, offsets)
    _, first, which = np.unique(hash_spans(data, begin, end, fold=False), return_index=True, return_inverse=True)
    whole = data.tobytes()
    words = [whole[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    return words, which, np.bincount(text, minlength=len(offsets) - 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j in slices(offsets, _TALLY):
            words, which, _ = _distinct(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            counts = np.bincount(which, minlength=len(words))
            short = [k for k, w in enumerate(words) if len(w) <= WORD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in short], pa.binary()), pa.array(counts[short], pa.int64())],
                                             names=["word", "n"])


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Count the words of all texts, compile the frequent ones and send the file to every machine; returns its name.

    Frequent means: counted at least as often as the lowest number that no more than ``words`` words reach, so at most
    that many words come to the driver.
    """
    spark = docs.sparkSession
    tally = docs.select(text_col).mapInArrow(_tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tally = materialize(tally, "tally")
    levels = tally.groupBy("n").agg(F.count("*").alias("words"))
    cut, reached = None, 0
    # Numbers of words that occur equally often, from above: no more rows than words asked for.
    for row in levels.orderBy(F.desc("n")).limit(words + 1).collect():
        reached += row["words"]
        if reached > words:
            break
        cut = row["n"]
    frequent = sorted(bytes(r["word"]) for r in tally.where(F.col("n") >= cut).select("word").collect()) if cut is not None else []
    ids, counts = Encoder(load_vocabulary(path)).encode(frequent)
    return _send(spark, compile_lexicon(frequent, ids, counts))


def _send(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared folder and have every executor fetch its own copy."""
    folder = work_folder(spark, "lexicon")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{folder.rsplit('/', 1)[-1]}.bin")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(target, True)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(target).toString())
    return target.getName()


def _decode(tokens: list[str], bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.array([" ".join([tokens[i] for i in ids[a:b].tolist()]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, path: str, lexicon: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           decoded: bool = False) -> DataFrame:
    """The ``keep`` columns and ``ids``, the tokens of the whole text. Null and empty texts have none. Nothing is shuffled.

    With ``decoded`` the ids are decoded in the same pass, as :func:`decode` does for stored ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # the tokenizer's size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = Encoder(shared.value), Lexicon(SparkFiles.get(lexicon))
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, _SLICE):
                words, which, per_text = _distinct(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                place = known.find(words)
                unseen = np.flatnonzero(place < 0)
                more, counts = encoder.encode([words[k] for k in unseen.tolist()])
                pool = np.concatenate([known.ids, more])
                start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                seen = place >= 0
                start[seen], size[seen] = known.starts[place[seen]], np.diff(known.starts)[place[seen]]
                start[unseen], size[unseen] = len(known.ids) + np.cumsum(counts) - counts, counts
                sizes = size[which]
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                ids = pool[np.repeat(start[which] - (ends - sizes), sizes) + np.arange(total)]
                bounds = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                more = [_decode(shared.value.tokens, bounds, ids)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *more],
                                                 names=[*part.schema.names[:-1], "ids", *["decoded"] * decoded])

    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("\x00text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(run, f"{types}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the tokens' texts joined by a space, as the file names no decoder. No ids, empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids_col))
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for at in range(0, batch.num_rows, 256):
                n = min(256, batch.num_rows - at)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns, _decode(tokens, bounds[at:at + n + 1], values)], names=[*part.schema.names, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{types}, decoded string")
