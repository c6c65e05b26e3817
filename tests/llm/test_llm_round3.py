"""Byte-level tokens, word runs and whitening against the tokenizer's library, brute force and a dense eigensolver."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tollgate.llm import arrays, byte_bpe, queries, whitening, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, ids long, runs string, ends int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", "l", "e", " ", "  ", "\n", "\t", " ", "　", "\x85", "a", "B", "1", "23", "!",
         "--", "é", "日", "́", "½", "\U00013460", "\U000107bb", "\U0001f600", "<|endoftext|>"]


def odd_texts():
    r = random.Random(5)
    mixed = ["".join(r.choice(PARTS) for _ in range(r.randrange(30))) for _ in range(400)]
    return [*mixed, None, "", " ", "'s", "it's we're 'll' 's's ''s", "a" * 2000, " " * 900 + "x", "ab" * 500 + "!?" * 400, "word " * 20_000,
            "x y", "x y", "trailing \n "]


def test_tokens_equal_the_library(spark, ranks, library):
    docs = spark.createDataFrame([(i, t, 7, "r", 1) for i, t in enumerate(odd_texts())], DOCS)
    encoded = byte_bpe.encode(docs, ranks)
    rows = byte_bpe.decode(encoded, ranks).collect()
    assert len(rows) == len(odd_texts())
    for row in rows:
        text = odd_texts()[row["doc_id"]] or ""
        assert row["ids"] == library.encode_ordinary(text), text[:80]
        assert bytes(row["decoded"]) == text.encode()
        assert row["ends"] == np.cumsum([len(library.decode_single_token_bytes(i)) for i in row["ids"]]).tolist()


def test_tokens_of_one_pass_and_of_no_rows(spark, ranks):
    empty = spark.createDataFrame([], DOCS)
    assert byte_bpe.encode(empty, ranks, keep=("doc_id", "runs"), decoded=True).columns == ["doc_id", "runs", "ids", "ends", "decoded"]
    assert byte_bpe.encode(empty, ranks, decoded=True).count() == 0
    lists = spark.createDataFrame([(1, None, None), (2, [], []), (3, [262], [4])], "doc_id long, ids array<int>, ends array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(lists, ranks).collect()} == {1: b"", 2: b"", 3: b" the"}


def test_broken_bytes_are_read_as_replacements(spark, ranks, library):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61ff62') AS string) AS text UNION ALL SELECT 2L, 'fine'")
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, ranks).collect()}
    assert got == {1: library.encode_ordinary("a�b"), 2: library.encode_ordinary("fine")}


def test_scan_does_not_depend_on_its_width():
    known = byte_bpe.automaton()
    symbols = known.of_symbol[np.random.default_rng(0).integers(0, 16, 5000)]
    one = byte_bpe.compose(symbols, known.then, known.functions, 7)
    assert (one == byte_bpe.compose(symbols, known.then, known.functions, 5000)).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(arrays, "hash_spans", lambda data, begin, end, fold: np.zeros(len(begin), np.uint64))
    data = np.frombuffer(b"ab cd ab x", np.uint8)
    begin, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10])
    first, which = arrays.distinct_spans(data, begin, end)
    assert which.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_op13_on_the_given_table(spark, folder, library):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op13_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids))


def brute_runs(w, least=6, repeats=4):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, repeats * q) and not any(w[i:j + q - p] == w[i + p:j + q] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def test_grouping_yields_lyndon_arrays():
    r = random.Random(2)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(45))]
        names = sorted(set(w))
        w = [names.index(x) for x in w]
        assert word_runs.lyndon_lengths(w) == brute_lyndon(w)


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(least, repeats):
    r = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(r.randrange(1, 5)):
            w = []
            for _ in range(r.randrange(6)):
                w += [r.randrange(4) for _ in range(r.randrange(1, 5))] * r.randrange(1, 9) if r.random() < 0.5 else [
                    r.randrange(6) for _ in range(r.randrange(9))]
            texts.append(w)
        names = np.array([x for w in texts for x in w], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        first = np.searchsorted(text, np.arange(len(texts)))
        want = [(int(first[k]) + a, b, c) for k, w in enumerate(texts) for a, b, c in brute_runs(w, least, repeats)]
        assert [tuple(x) for x in word_runs.find_runs(names, text, least, repeats).tolist()] == want


def test_cutting_at_rare_words_may_stop_at_any_round(monkeypatch):
    r = random.Random(8)
    names = np.array([x for _ in range(60) for x in [r.randrange(9) for _ in range(5)] + [r.randrange(3), r.randrange(3)] * r.randrange(6)])
    text = np.zeros(len(names), np.int64)
    whole = word_runs.find_runs(names, text).tolist()
    assert whole
    for rounds in (1, 2, 3):
        monkeypatch.setattr(word_runs, "_ROUNDS", rounds)
        assert word_runs.find_runs(names, text).tolist() == whole


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_equals_brute_force(spark, folder, tmp_path):
    r = random.Random(4)
    made = [(None, "no id " * 9), (1, None), (2, ""), (3, " \n "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (6, "A a " * 5)]
    made += [(i, " ".join(r.choice(["x", "y", "z w", "u v u v u v u v"]) for _ in range(r.randrange(60)))) for i in range(100, 400)]
    made.append((77, "one " * 5000 + "end " + "p q r " * 3000))
    given = [(d["doc_id"], d["text"]) for d in queries.table(spark, folder, "documents").collect() if len(d["text"] or "") < 6000]
    spark.createDataFrame(made + given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(x) for x in queries.op12_word_runs(spark, str(tmp_path)).collect()]
    want = [(i, *expected_runs(i, t)) for i, t in made + given]
    key = lambda x: str(x)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert sum(x[1] > 0 for x in want) > 50


def test_runs_of_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert word_runs.collapse_runs(empty, keep=("doc_id", "ids")).collect() == []
    with pytest.raises(ValueError):
        word_runs.collapse_runs(empty, repeats=1)


def matrices():
    r = np.random.default_rng(0)
    q = np.linalg.qr(r.standard_normal((48, 48)))[0]
    return {
        "random": np.cov(r.standard_normal((500, 64)).T), "identity": np.eye(30), "two": np.array([[2.0, 1], [1, 2]]), "one": np.array([[3.0]]),
        "multiple": (q * np.append(np.full(30, 5.0), np.full(18, 1e-9))) @ q.T, "ones": np.ones((20, 20)), "diagonal": np.diag(np.arange(12.0)),
        "close": np.diag(abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), "zero": np.zeros((4, 4)),
        "tiny": 1e-12 * np.cov(r.standard_normal((300, 80)).T)}


@pytest.mark.parametrize("name", matrices())
def test_leading_pairs(name):
    a = matrices()[name]
    values, rows = whitening.leading_pairs(a, 32)
    size = abs(a).max() or 1.0
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], atol=1e-13 * size, rtol=0)
    assert abs(a @ rows.T - rows.T * values).max() < 1e-13 * size
    assert abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-12


def expected_whitening(rows):
    rows = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(rows), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1).tolist()
    centred = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in rows], n, deviation, centred @ vectors / np.sqrt(np.abs(values) + 1e-300), values / values.sum()


def check_whitening(got, rows, k):
    ids, n, deviation, white, explained = expected_whitening(rows)
    parts = defaultdict(list)
    for r in got:
        parts[r["component"]].append(r)
    assert sorted(parts) == list(range(1, k + 1))
    for c, part in parts.items():
        assert len(part) == n and all(r["n"] == n and r["identity_error"] <= 1e-9 for r in part)
        assert all(abs(r["explained"] / explained[c - 1] - 1) < 1e-9 for r in part)
        have = sorted((r["id"], r["deviation"], r["whitened"]) for r in part)
        want = sorted(zip(ids, deviation, white[:, c - 1].tolist(), strict=True))
        assert [x[:2] for x in have] == [x[:2] for x in want]
        a, b = np.array([x[2] for x in have]), np.array([x[2] for x in want])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8


def test_whitening_equals_a_dense_solver(spark):
    r = np.random.default_rng(1)
    base = (r.standard_normal((400, 5)) @ np.diag([9, 5, 3, 2, 1.0]) @ r.standard_normal((5, 5))).tolist()
    rows = list(enumerate(base)) + [(3, base[3]), (900, [0.0] * 5)]
    bad = [(901, None), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] + [0.0] * 4), (904, [float("inf")] * 5), (905, [])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + bad], "vec_id long, embedding array<double>, component int, n string")
    for parts in (1, 7):
        check_whitening(whitening.whiten(table.repartition(parts)).collect(), rows, 5)


def test_whitening_of_widths_constants_and_nothing(spark):
    schema = "vec_id long, embedding array<double>"
    r = np.random.default_rng(2)
    two, three = [(i, v) for i, v in enumerate(r.standard_normal((50, 2)).tolist())], [(i, [*v, 4.0]) for i, v in enumerate(r.standard_normal((40, 2)).tolist(), 100)]
    got = whitening.whiten(spark.createDataFrame(two + three, schema)).collect()
    check_whitening([x for x in got if x["id"] < 100], two, 2)
    check_whitening([x for x in got if x["id"] >= 100], three, 2)  # the constant entry has no variance to scale
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = [(i, [v * 1e9, -v]) for i, v in enumerate(range(30))]
    assert {x["deviation"] for x in whitening.whiten(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in far], schema)).collect()} >= {None}


def test_op11_on_the_given_table(spark, folder):
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    got = queries.op11_whitening(spark, folder).withColumnRenamed("vec_id", "id").collect()
    ids, n, deviation, white, explained = expected_whitening(rows)
    check_whitening(got, rows, min(32, len(rows) - 1))
