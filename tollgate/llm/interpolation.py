"""Language-model scores by deleted interpolation of bigrams.

The probability of a token after a context mixes the bigram's and the token's maximum-likelihood estimates and a uniform share:
``w2 * c(h, t) / c(h) + w1 * c(t) / N + w0 / (V + 1)``. The weights depend on how often the context was seen (one set
per power of two). They are learned by expectation-maximisation on deleted documents: training documents that are left
out of the counts while the weights are learned. The final counts are those of all training documents.

Counting is a question and an answer between blocks of documents and ranges of token hashes. A block sends each range its
sorted distinct hashes with their counts as packed arrays; a range adds up what all blocks sent and answers each block with
the corpus counts in the order of its question. A very frequent bigram is one entry per block, so there is no hot key, and
the number of rows is that of blocks times ranges met, not of tokens. The answers turn each document into two arrays of
counts, which is all that scoring needs once the weights are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.arrays import mix, slices, text_bytes, word_hashes
from tollgate.sources.artifacts import materialize

RETAINED, DELETED, SCORED = 0, 1, 2
#: Text bytes of a block, and of the blocks' text for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: Bigram hashes have as many bits as the text's bytes need, and these.
SAFE = 18
#: Cells per doubling in the histogram that the weights are learned from.
FINE = 4
DOCUMENT, CELLS, TOTALS = 0, 1, 2

_END, _BEGIN, _FACTOR = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA24BAED4963EE407), np.uint64(0x9E6C63D0876A9A47)
_REQUEST = "range int, block int, pair boolean, hashes binary, retained binary, deleted binary"
_ANSWER = "block int, range int, pair boolean, retained binary, total binary, n long, v long, k long"
_COUNTED = "kind int, doc_id long, role int, first binary, second binary, n long, v long, k long"


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes: the upper planes of small numbers are zeros."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _tokens(column, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (64 bits) and bigram hashes (``bits``) of all texts, each with an end, and the tokens of each text."""
    data, offsets = text_bytes(column)
    parts = []
    for i, j in slices(offsets):
        words, counts = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        ends = np.cumsum(counts + 1)
        tokens = np.full(int(ends[-1]), _END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[ends - 1] = False
        tokens[inner] = words
        before = np.append(_BEGIN, tokens[:-1])
        before[ends[:-1]] = _BEGIN
        cut = np.uint64(64 - bits)
        parts.append((tokens, mix(before * _FACTOR + tokens) >> cut, counts + 1))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bounds(hashes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    edges = [(i << bits) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]]).astype(np.int64)


def _ask(ranges: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        tokens, pairs, counts = _tokens(table.column("text"), bits)
        block = table.column("block")[0].as_py()
        role = np.repeat(table.column("role").to_numpy(), counts)
        rows = []
        for pair, hashes in ((False, tokens), (True, pairs)):
            known, which = np.unique(hashes, return_inverse=True)
            numbers = [np.bincount(which[role == r], minlength=len(known)).astype(np.uint32) for r in (RETAINED, DELETED)]
            width = bits if pair else 64
            bounds = _bounds(known, ranges, width)
            for at in np.flatnonzero(np.diff(bounds)).tolist():
                i, j = bounds[at], bounds[at + 1]
                steps = np.diff(known[i:j], prepend=np.uint64((at << width) // ranges))
                rows.append((at, block, pair, pack(steps), *[pack(n[i:j]) for n in numbers]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        names=["range", "block", "pair", "hashes", "retained", "deleted"])
    return run


def _answer(ranges: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py()
        rows = table.to_pylist()
        out, n, v, k = [], 0, 0, 0
        for pair in (False, True):
            asked = [r for r in rows if r["pair"] == pair]
            if not asked:
                continue
            start = np.uint64((at << (bits if pair else 64)) // ranges)
            hashes = [np.cumsum(unpack(r["hashes"], np.uint64), dtype=np.uint64) + start for r in asked]
            known, which = np.unique(np.concatenate(hashes), return_inverse=True)
            retained = np.concatenate([unpack(r["retained"], np.uint32) for r in asked])
            deleted = np.concatenate([unpack(r["deleted"], np.uint32) for r in asked])
            kept = np.bincount(which, weights=retained, minlength=len(known)).astype(np.int64)
            total = kept + np.bincount(which, weights=deleted, minlength=len(known)).astype(np.int64)
            if not pair:
                n, v, k = int(total.sum()), int((total > 0).sum()), int(kept.sum())
            # Retained counts are needed where the block has deleted tokens only.
            kept = np.where(deleted > 0, kept[which], 0).astype(np.uint64)
            total = total[which].astype(np.uint64)
            ends = np.cumsum([len(h) for h in hashes])
            for r, h, e in zip(asked, hashes, ends.tolist(), strict=True):
                out.append((r["block"], at, pair, pack(kept[e - len(h):e]), pack(total[e - len(h):e]), None, None, None))
        out.append((-1 - at, at, False, None, None, n, v, k))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                        names=["block", "range", "pair", "retained", "total", "n", "v", "k"])
    return run


def _places(counts: np.ndarray) -> np.ndarray:
    """The set of weights of a context: 0 if it was never seen, else one more than the power of two below its count."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def _shift(counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The count of each token's context. A begin is followed by a token as often as texts end."""
    before = np.append(0, counts[:-1])
    before[np.append(0, ends[:-1])] = counts[ends - 1]
    return before


def _cells(kept: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Where each deleted token falls: set of weights, then the logarithms of what its two estimates' ratios depend on."""
    y = np.where(kept > 0, np.rint(FINE * np.log2(np.maximum(kept, 1))), -1).astype(np.int64) + 1
    ratio = np.maximum(both, 1) / (np.maximum(context, 1).astype(float) * np.maximum(kept, 1))
    x = np.where(both > 0, np.rint(-FINE * np.log2(ratio)), -1).astype(np.int64) + 1
    return _places(context) << 32 | x << 16 | y


def _count(bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = zip(*[(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]])
                             for f in _COUNTED.split(", ")], strict=True)
        out: list[tuple] = []
        rows = sorted(answers.to_pylist(), key=lambda r: r["range"])
        out += [(TOTALS, None, None, None, None, r["n"], r["v"], r["k"]) for r in rows if r["block"] < 0]
        if docs.num_rows:
            tokens, pairs, counts = _tokens(docs.column("text"), bits)
            ends = np.cumsum(counts)
            totals, keeps = [], []
            for pair, hashes in ((False, tokens), (True, pairs)):
                _, which = np.unique(hashes, return_inverse=True)
                mine = [r for r in rows if r["block"] >= 0 and r["pair"] == pair]
                totals.append(np.concatenate([unpack(r["total"], np.uint64) for r in mine])[which])
                keeps.append(np.concatenate([unpack(r["retained"], np.uint64) for r in mine])[which])
            ids, roles = docs.column("doc_id").to_pylist(), docs.column("role").to_numpy()
            deleted = np.repeat(roles == DELETED, counts)
            if deleted.any():
                # Deleted texts alone, so that every context's count is there.
                kept, both = keeps[0][deleted], keeps[1][deleted]
                cells, number = np.unique(_cells(kept, _shift(kept, np.cumsum(counts[roles == DELETED])), both), return_counts=True)
                out.append((CELLS, None, None, cells.tobytes(), number.tobytes(), None, None, None))
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                out.append((DOCUMENT, ids[i], int(roles[i]), pack(totals[0][end - n:end]), pack(totals[1][end - n:end]), None, None, None))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
    return run


def _list_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cells, np.int64)), pa.array(np.frombuffer(number, np.int64))],
                                             names=["cell", "n"])


@dataclass(frozen=True)
class Mixture:
    """Training tokens, distinct ones, and the weights (bigram, token, uniform) for each set."""
    tokens: int
    distinct: int
    weights: np.ndarray


def learn_weights(cells: np.ndarray, number: np.ndarray, kept: int, distinct: int, rounds: int = 80) -> np.ndarray:
    """Expectation-maximisation of the three weights of each set over a histogram of deleted tokens.

    A set starts from the weights of all sets together, and keeps them where it has no deleted token. No weight is zero, but that
    of bigrams in the set of contexts never seen.
    """
    place, x, y = cells >> 32, (cells >> 16 & 0xFFFF) - 1, (cells & 0xFFFF) - 1
    one = np.where(y >= 0, np.exp2(y / FINE) / max(kept, 1), 0.0)
    two = np.where(x >= 0, np.exp2(y / FINE - x / FINE), 0.0)
    estimates = np.stack([two, one, np.full(len(cells), 1 / (distinct + 1))], axis=1)

    def fit(groups: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            shares = estimates * weights[groups]
            shares *= (number / shares.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(groups, weights=s, minlength=len(weights)) for s in shares.T], axis=1)
            seen = sums.sum(axis=1) > 0
            weights[seen] = np.maximum(sums[seen] / sums[seen].sum(axis=1, keepdims=True), 1e-9)
        return weights / weights.sum(axis=1, keepdims=True)

    pooled = fit(np.zeros(len(cells), np.int64), np.full((1, 3), 1 / 3)) if len(cells) else np.full((1, 3), 1 / 3)
    weights = fit(place, np.repeat(pooled, 64, axis=0))
    # After a context that was never seen no bigram has a share, so its weight goes to the other two.
    weights[0] = [0.0, *weights[0, 1:] / weights[0, 1:].sum()]
    return weights


def _score(model: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v, weights = max(model.tokens, 1), model.distinct, model.weights
        for batch in batches:
            out = []
            for first, second in zip(batch.column(2), batch.column(3), strict=True):
                c, both = unpack(first.as_py(), np.uint64).astype(np.int64), unpack(second.as_py(), np.uint64)
                context = _shift(c, np.array([len(c)]))
                w = weights[_places(context)]
                p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * c / n + w[:, 2] / (v + 1)
                out.append((len(c), int((c > 0).sum()), float(np.log10((c + 0.5) / (model.tokens + 0.5 * (v + 1))).sum()),
                            float(np.log10(p).sum())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 2, strict=True)]],
                names=["doc_id", "role", "n_tokens", "n_known", "base_score", "score"])
    return run


def interpolated_scores(docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, role, n_tokens, n_known, train_tokens, base_score, score``.

    ``role`` says what a document is for: RETAINED and DELETED ones train, SCORED ones do not; all are scored, with all
    training documents' counts. A null or empty text is one token, the end. Without training documents every token has
    probability 1. Null and repeated ids are scored row by row; other columns are not looked at.

    Texts go through one shuffle (both uses of the blocks read the same one). Rows are dealt to blocks by their number
    in the file, so neither repeated ids nor equal texts make a large block.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       role.cast("int").alias("role"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks, ranges = size // BLOCK_BYTES + 1, size // RANGE_BYTES + 1
    # Bits for which a bigram shares its hash with another one with a probability of 2 ** -SAFE at most.
    bits = min(64, -(-(int(size).bit_length() - 1 + SAFE) // 8) * 8)
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    blocked = rows.select(block, "doc_id", "text", "role")
    asked = blocked.groupBy("block").applyInArrow(_ask(ranges, bits), _REQUEST)
    answers = asked.groupBy("range").applyInArrow(_answer(ranges, bits), _ANSWER)
    counted = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_count(bits), _COUNTED)
    counted = materialize(counted, "counted")

    n, v, k = (x or 0 for x in counted.where(F.col("kind") == TOTALS).agg(F.sum("n"), F.sum("v"), F.sum("k")).first())
    cells = counted.where(F.col("kind") == CELLS).select("first", "second").mapInArrow(_list_cells, "cell long, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()  # bounded by the cells there are
    weights = learn_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], float), k, v)
    if not n:  # nothing was learned: all tokens are unknown, and that is the one unknown token
        weights[:] = [0.0, 0.0, 1.0]
    scored = counted.where(F.col("kind") == DOCUMENT).select("doc_id", "role", "first", "second").mapInArrow(
        _score(Mixture(n, v, weights)), "doc_id long, role int, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
