"""Near duplicates, interpolation, tokens, language, quality and licences against brute force on small tables."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tollgate.llm import arrays, bpe, components, interpolation, language, licences, near_text, quality_text, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, id int, key string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, odd white space and letters."""
    r = random.Random(3)
    base = [r.choice("the of and Word other x1 Ünder 日本 a,b").strip() + str(r.randrange(40)) for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    far = base[:60] + [f"new{i}" for i in range(60)]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, "\t".join(base).upper()), (4, " ".join(near)), (5, " ".join(far)),
        (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One  two"), (11, "x"), (12, "   nb"), (13, "long " * 40_000),
        (None, " ".join(base)), (14, " ".join(far)), (14, "one two"), (15, "İstanbul ΣΑΣ é"), (15, "İstanbul ΣΑΣ é")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 0, "k") for i, t in odd_texts()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes_do_not_depend_on_their_neighbours():
    texts = [t for _, t in odd_texts()]
    data, offsets = arrays.text_bytes(pa.array(texts))
    begin, end, owner = arrays.find_words(data, offsets)
    got = [[] for _ in texts]
    for b, e, o in zip(begin, end, owner):
        got[o].append(data[b:e].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    hashes, counts = arrays.word_hashes(data, offsets)
    seen = {}
    for text, n, stop in zip(texts, counts, np.cumsum(counts)):
        for w, h in zip(words(text), hashes[stop - n:stop].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in arrays.shingle_sets(data, offsets)] == [len(shingles(t)) for t in texts]


def test_runs_cross_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in ([1, 1, 2], [], [2, 2], [2, 3])]
    assert [t.column("v").to_pylist() for t in arrays.runs_of(iter(batches), ["k"])] == [[1, 1], [2, 2, 2, 2], [3]]


def united(nodes, links):
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 3), (3, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    want = united({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark, odd, none):
    got = near_text.near_duplicates(odd)
    rows = [(i, shingles(t)) for i, t in odd_texts()]
    known = [(i, s) for i, s in rows if i is not None]
    links = [(i, j) for i, a in known for j, b in known if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    want = united({i for i, _ in known}, links)
    expected = Counter((i, len(s), want.get(i), i is not None and want[i] == i) for i, s in rows)
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert near_text.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [512, 8])
def test_families_with_chains_and_unlinked_members(spark, tile, monkeypatch):
    """Mutated copies: most link with the base, some only with another copy, some with none; groups larger than a tile."""
    monkeypatch.setattr(near_text, "TILE", tile)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(60):
        copy = base.copy()
        for _ in range(r.choice([0, 2, 4, 6, 9])):
            copy[r.randrange(150)] = f"m{r.randrange(10 ** 6)}"
        texts.append((i, " ".join(copy)))
    got = near_text.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    sets = {i: shingles(t) for i, t in texts}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert {x.id: x.component_id for x in got.collect()} == united(set(sets), links)


def test_signature_keys_meet_within_the_distance():
    """Any two signatures at the guaranteed distance share one of their keys."""
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 16, near_text.VALUES, dtype=np.uint16)
        b = a.copy()
        b[r.permutation(near_text.VALUES)[:near_text.DISTANCE]] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["rep", "signature"])
        keys = [x.column(0).to_pylist() for x in near_text._file(iter([batch]))]
        shared = [x[0] & 63 for x in keys if x[0] == x[1]]
        assert shared and min(shared) == near_text.first_shared(a, b[None, :])[0]


def role_of(i):
    fold = zlib.crc32(str(i if i is not None else "").encode()) % 5
    return interpolation.SCORED if fold == 1 else interpolation.DELETED if fold == 0 else interpolation.RETAINED


def test_interpolation_equals_brute_force(spark, none):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice("a b c d e f g h i j".split()) for _ in range(r.randrange(60)))) for i in range(80)] + odd_texts()
    df = spark.createDataFrame([(i, t, role_of(i)) for i, t in texts], "doc_id long, text string, role int")
    got = interpolation.interpolated_scores(df, F.col("role")).collect()
    tokens = [(role_of(i), [None, *words(t), "</s>"]) for i, t in texts]
    count = lambda keep, n: Counter(tuple(w[k:k + n]) for x, w in tokens if x in keep for k in range(2 - n, len(w) - n + 1) if k + n > 1)
    kept, total = [{n: count(keep, n) for n in (1, 2)} for keep in ((0,), (0, 1))]
    n, v, k = sum(total[1].values()), len(total[1]), sum(kept[1].values())
    end = ("</s>",)
    context = lambda counts, w: counts[1][end if w is None else (w,)]
    place = lambda c: int(math.log2(c)) + 1 if c else 0
    # The weights from the histogram of deleted tokens, built anew.
    cells = Counter()
    for x, w in tokens:
        if x == interpolation.DELETED:
            for a, b in zip(w, w[1:]):
                h, c, both = context(kept, a), kept[1][(b,)], kept[2][(a, b)]
                y = round(interpolation.FINE * math.log2(c)) + 1 if c else 0
                z = round(-interpolation.FINE * math.log2(both / (h * c))) + 1 if both else 0
                cells[place(h) << 32 | z << 16 | y] += 1
    keys = sorted(cells)
    weights = interpolation.learn_weights(np.array(keys), np.array([cells[c] for c in keys], float), k, v)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[1:] > 0).all() and weights[0, 0] == 0
    want = []
    for (i, _), (x, w) in zip(texts, tokens):
        base = sum(math.log10((total[1][(b,)] + 0.5) / (n + 0.5 * (v + 1))) for b in w[1:])
        score = 0.0
        for a, b in zip(w, w[1:]):
            h = context(total, a)
            q = weights[place(h)]
            score += math.log10(q[0] * total[2][(a, b)] / max(h, 1) + q[1] * total[1][(b,)] / n + q[2] / (v + 1))
        want.append((i, x, len(w) - 1, sum(total[1][(b,)] > 0 for b in w[1:]), n, base, score))
    order = lambda rows: sorted(rows, key=lambda t: (t[0] is None, t[0] or 0, t[2], t[5]))
    mine = order([(g.doc_id, g.role, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got])
    for a, b in zip(mine, order(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert interpolation.interpolated_scores(none, F.lit(0)).count() == 0
    # The probabilities after any context add up to one, with one unknown token.
    for a in [None, "a", "never seen"]:
        h = context(total, a)
        q = weights[place(h)]
        p = sum(q[0] * total[2][(a, b)] / max(h, 1) + q[1] * c / n + q[2] / (v + 1) for (b,), c in total[1].items()) + q[2] / (v + 1)
        assert p == pytest.approx(1)
    untrained = interpolation.interpolated_scores(df, F.lit(interpolation.SCORED)).collect()
    assert all(x.score == 0 and x.train_tokens == 0 and x.n_known == 0 for x in untrained)


def test_packed_numbers_round_trip():
    for kind in (np.uint32, np.uint64):
        x = np.array([0, 1, 255, 256, 2 ** 31, 7], kind)
        assert (interpolation.unpack(interpolation.pack(x), kind) == x).all()
    assert len(interpolation.unpack(interpolation.pack(np.zeros(0, np.uint64)), np.uint64)) == 0


HARD = ["It's a <|endoftext|>b<|startoftext|>", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "naïve 123 ½ ٣ '' ''s 're", "😀😀 👩‍👩‍👧", "日本語テキスト", "á́ ́x", "<|endoftext",
        "x" * 100, "aaaaabababab" * 20, "'S 'T don'T", "\x00\x01a\x85b\x1cc", "Ⅷ ǆ", "క్షి ffiﬃ", "a b　c"]


def test_tokens_equal_the_library(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = odd_texts() + [(100 + i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (0, 5, bpe.LEXICON_WORDS):  # all merged, a small lexicon, and the usual one
        got = bpe.decode(bpe.encode(df, path, bpe.build_lexicon(df, path, words=size)), path).collect()
        mine = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got)
        once = bpe.encode(df, path, bpe.build_lexicon(df, path, words=size), decoded=True).collect()
        assert mine == Counter((r.doc_id, tuple(r.ids), r.decoded) for r in once)
        want = Counter()
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[(i, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
        assert mine == want
    assert bpe.encode(none, path, bpe.build_lexicon(none, path)).count() == 0


def test_lexicon_is_minimal_and_finds_its_words(tmp_path):
    vocabulary = bpe.load_vocabulary(queries.tokenizer_path())
    entries = sorted({f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz"} | {b"a", b"ab", "é".encode()})
    ids, counts = bpe.Encoder(vocabulary).encode(entries)
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe.compile_lexicon(entries, ids, counts))
    lexicon = bpe.Lexicon(str(file))
    assert lexicon.find(entries).tolist() == list(range(len(entries)))
    assert (lexicon.find([b"", b"ax", b"axin", b"axings", b"z", b"a" * 500]) == -1).all()
    assert len(lexicon.final) < sum(map(len, entries)) / 3  # "ing" is stored once
    place = entries.index(b"axing")
    assert lexicon.ids[lexicon.starts[place]:lexicon.starts[place + 1]].tolist() == bpe.Encoder(vocabulary).encode([b"axing"])[0].tolist()


@pytest.mark.parametrize("segment, table", [(512, 4_000_000), (7, 4_000_000), (3, 0)])
def test_cross_parsing_equals_a_greedy_parse(monkeypatch, segment, table):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "TABLE", table)
    r = random.Random(2)
    text = "".join(r.choice("ab c") for _ in range(300))
    reference = [r.randrange(1, 5) for _ in range(200)]
    table = language.automaton(reference, 7)
    joined = bytes(reference)
    for k in range(60):
        # Some repeat the reference, so that walks from different states stay apart for long.
        probe = [r.randrange(1, 7) for _ in range(r.randrange(1, 100))] if k % 2 else [6, *reference[3:150], *reference[:60]] * 2
        at = count = 0
        while at < len(probe):
            n = 1
            while at + n < len(probe) and bytes(probe[at:at + n + 1]) in joined:
                n += 1
            if bytes(probe[at:at + 1]) not in joined:
                n = 1
            at, count = at + n, count + 1
        got = language.phrases(np.array(probe, np.uint8), np.array([len(probe)]), [table])
        assert got[0, 0] == count
    assert text


def test_language_of_odd_texts_and_learning(spark, odd, none):
    r = random.Random(4)
    say = {"aa": "kamo teli sura nabi".split(), "bb": "schrund pfelk wirtz".split()}
    rows = [(i, " ".join(r.choice(say[lang]) for _ in range(r.randrange(3, 80))), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    model = language.fit(spark.createDataFrame(rows + [(900, None, "aa"), (901, "kamo", None)], "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(1, "Teli! SURA kamo"), (2, "wirtz pfelk."), (3, None), (4, ""), (5, "12 34 !"), (6, "日本"), (7, "sura " * 30_000), (7, "sura " * 30_000)],
                                  "doc_id long, text string")
    got = sorted(tuple(x) for x in language.identify(probe, model).collect())
    assert [x[1] for x in got] == ["aa", "bb", "und", "und", "und", "aa", "aa", "aa"]
    assert all(0 <= x[2] <= 1 for x in got) and got[2][2] == 0
    assert language.identify(none, model).count() == 0
    untaught = language.fit(none.withColumn("lang", F.lit("x")))
    assert {x.lang_pred for x in language.identify(odd, untaught).collect()} == {"und"}


def test_language_is_learned_behind_a_shared_header(spark):
    r = random.Random(14)
    say = {"aa": "kamo teli sura nabi".split(), "bb": "schrund pfelk wirtz".split()}
    header = "".join(f"Clause {i} of the terms holds for every reader of page {i * i}.\n" for i in range(60)) + "1234567890 " * 300 + "\n"
    body = lambda lang: " ".join(r.choice(say[lang]) for _ in range(60))
    rows = [(i, header + body(lang), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(i, body(lang), lang) for i, lang in enumerate(["aa", "bb"] * 10)], "doc_id long, text string, lang string")
    assert all(x.lang == x.lang_pred for x in language.identify(probe, model, keep=("doc_id", "lang")).collect())


def test_letters_of_any_alphabet_and_whole_texts_count(spark):
    """Two thousand letters in each language, which the texts share only by their order; and what tells them apart stands last."""
    r = random.Random(15)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    steps = {"aa": 7, "bb": 11}

    def write(lang, n):
        at = r.randrange(2000)
        return "".join(letters[(at + k * steps[lang]) % 2000] for k in range(n))

    rows = [(i, write(lang, 900), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(model.symbol.tolist())) > 2000
    probe = [(100 + i, "12 " * 5000 + write(lang, 300), lang) for i, lang in enumerate(["aa", "bb"] * 10)]
    got = language.identify(spark.createDataFrame(probe, "doc_id long, text string, lang string"), model, keep=("doc_id", "lang")).collect()
    assert all(x.lang == x.lang_pred for x in got)


def test_scores_follow_from_phrases_and_bits(spark):
    """The whole score by a plain reading: fold, greedy phrases over the reference, bits, shares."""
    texts = {"aa": ["kamo teli sura nabi", "teli kamo"], "bb": ["schrund pfelk wirtz", "pfelk"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    order = {lang: sorted((hashlib.md5(str(i).encode()).hexdigest(), t) for i, t, x in rows if x == lang) for lang in texts}
    plain = lambda t: re.sub(r"[^a-z]+", " ", t.lower())
    reference = {lang: "".join(plain(t) + " " for _, t in found) for lang, found in order.items()}

    def cost(text, lang):
        at = n = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at:end] in reference[lang] and text[at:end + 1] in reference[lang]:
                end += 1
            at, n = end, n + 1
        return n * math.log2(len(reference[lang]) + 1)

    for probe in ("Kamo, PFELK sura!", "wirtz", "zzz", "nabi teli"):
        costs = {lang: cost(plain(probe), lang) for lang in texts}
        got = language.identify(spark.createDataFrame([(1, probe)], "doc_id long, text string"), model).first()
        best = min(costs.values())
        assert abs(got.score - 1 / sum(2 ** (best - c) for c in costs.values())) < 1e-9
        assert costs[got.lang_pred] == best


def test_language_held_out_accuracy(spark, folder):
    got = queries.QUERIES["op8_language"](spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first()
    assert row.x > 0.95


def test_quality_on_odd_texts_and_one_class(spark, odd, none):
    labelled = odd.withColumn("label", F.lit(1))
    model = quality_text.fit(labelled)
    got = quality_text.score(odd, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= x.quality <= 1 for x in got)
    assert quality_text.score(none, quality_text.fit(none.withColumn("label", F.lit(0)))).count() == 0


def test_quality_scores_by_a_plain_reading(spark):
    """Words, pairs of words and runs of bytes counted one by one; the score is the softmax of the mean of their numbers."""
    r = np.random.default_rng(12)
    products = r.normal(size=quality_text.BUCKETS).astype(np.float32)
    mask = (1 << 32) - 1
    texts = ["one two two  three", "", "a", "Ünder\tone", "x" * 40, "two two"]

    def span(word, fold):
        data = np.frombuffer(word, np.uint8)
        return int(arrays.hash_spans(data, np.array([0]), np.array([len(data)]), fold=fold)[0])

    def numbers(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        top = 64 - quality_text.BITS
        out = [span(w, False) >> top for w in words]
        out += [int(arrays.mix(np.array([span(b, True) ^ span(a, True)], np.uint64))[0]) >> top for a, b in zip(words, words[1:])]
        stream = b" " + text.encode() + b" "
        for n in quality_text.LENGTHS:
            for at in range(len(stream) - n + 1):
                gram = stream[at:at + n]
                if not any(c in b" \t\n\v\f\r" for c in gram[1:-1]):
                    total = 0
                    for k, c in enumerate(gram):
                        total += (2654435761 if c in b" \t\n\v\f\r" else int(quality_text._LETTERS[c])) * int(quality_text._PLACES[k])
                    total &= mask
                    total ^= total >> 15
                    total = total * ((0x85EBCA6B | 1) + 2 * n) & mask
                    out.append(total >> (32 - quality_text.BITS))
        return out

    data, offsets = arrays.text_bytes(pa.array(texts))
    got = quality_text.score_slice(data, offsets, products, 0.25)
    for text, score in zip(texts, got.tolist(), strict=True):
        found = numbers(text)
        mean = sum(float(products[b]) for b in found) / max(1, len(found))
        assert score == pytest.approx(1 / (1 + math.exp(-(mean + 0.25))), abs=1e-6), text


def test_quality_learns_both_sides(spark):
    """Held-out texts of both labels: each is predicted, and the order is far from chance."""
    r = random.Random(16)
    good, bad = "river stone window garden paper morning".split(), "buy click win free cash now".split()
    write = lambda label: " ".join(r.choice((good if label else bad) + ["the", "of", "and"]) for _ in range(r.randrange(8, 40)))
    rows = [(i, write(i % 2), i % 2) for i in range(300)]
    train, test = (spark.createDataFrame(x, "doc_id long, text string, label int") for x in (rows[:200], rows[200:]))
    got = quality_text.score(test, quality_text.fit(train), keep=("doc_id", "label")).collect()
    ones, zeros = ([x.quality for x in got if x.label == label] for label in (1, 0))
    assert sum(x >= 0.3 for x in ones) >= 0.95 * len(ones) and sum(x < 0.3 for x in zeros) >= 0.95 * len(zeros)
    assert sum(a > b for a in ones for b in zeros) >= 0.99 * len(ones) * len(zeros)


def test_quality_learns_and_repeats(spark):
    r = random.Random(6)
    good = [" ".join(r.choice("river stone light over under walked home".split()) for _ in range(60)) for _ in range(60)]
    junk = ["BUY!!! $$$ " * r.randrange(5, 30) if i % 2 else f"{r.choice('xyz')}q " * 50 for i in range(60)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    train, test = df.where("doc_id % 3 != 0"), df.where("doc_id % 3 = 0")
    one, two = quality_text.fit(train), quality_text.fit(train)
    assert (one.products == two.products).all()
    got = quality_text.score(test, one, keep=("doc_id", "label")).collect()
    assert all((x.quality >= 0.5) == (x.label == 1) for x in got)
    # A text's score depends on nothing else in its slice.
    data, offsets = arrays.text_bytes(pa.array(good))
    alone = quality_text.score_slice(data[:offsets[1]], offsets[:2], one.products.astype(np.float32), 0.0)[0]
    assert alone == quality_text.score_slice(data, offsets, one.products.astype(np.float32), 0.0)[0]


def test_quality_held_out(spark, folder):
    got = queries.QUERIES["op9_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    clean = got.where("held_out and quality = 1").agg(F.avg("predicted").alias("x")).first()
    assert clean.x > 0.95


MIT = """Copyright (c) 2001 Someone. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software"""


def full(name):
    return next(s for s, i in licences.SENTENCES.items() if i == name).capitalize() + "."


def test_licence_sentences_and_rules(spark, none):
    texts = [
        (1, f"{full('mit-grant')} \n{full('mit-notice')}\nunrelated line\r\n{full('mit-warranty')} All rights reserved."),
        (2, "Licensed under CC BY-NC 4.0.\nThis work is licenced under the GNU General Public License, version 3."),
        (3, full("apache-copy")), (4, "Licensed under the Apache License, Version 2.0. " + full("apache-comply") + " " + full("apache-copy")),
        (5, None), (6, ""), (7, "under the bridge " * 50_000), (8, MIT)]
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan_licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == (4, "mit-grant mit-notice mit-warranty all-rights", "All-Rights-Reserved MIT", 0)
    assert got[2][2] == "CC-BY-NC-4.0 GPL-3.0" and got[3] == (1, "apache-copy", "", 1) and got[4][2:] == ("Apache-2.0", 0)
    assert all(got[i] == (0, "", "", 0) for i in (5, 6, 7, 8))
    assert licences.scan_licences(none).count() == 0
    cue = re.compile(licences.CUES)
    assert all(cue.search(s) for s in licences.SENTENCES)


def test_licences_in_wrapped_texts_and_usual_headers(spark):
    def wrap(text, mark="", width=72):
        return "\n".join(mark + line for line in textwrap.wrap(text, width))

    mit = "\n\n".join(wrap(x) for x in (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."))
    bsd = wrap("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
               "conditions are met:") + "\n\n" + wrap(
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.") + "\n" + wrap(
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.")
    gpl = wrap("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "// ")
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law")
    mpl = wrap("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", " * ")
    texts = [mit, bsd, gpl, apache, wrap(apache, "# "), mpl, "This work is licensed under a Creative Commons Attribution 4.0 International License.",
             mit.replace("\n", "\r\n"), "Some words\n" + gpl, "This is free and unencumbered software released into the public\ndomain."]
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licences for r in sorted(got, key=lambda r: r.doc_id)] == [
        "MIT", "BSD-2-Clause", "GPL-3.0-or-later", "Apache-2.0", "Apache-2.0", "MPL-2.0", "CC-BY-4.0", "MIT", "GPL-3.0-or-later", "Unlicense"]


def test_licence_families_tags_headings_and_holders(spark):
    grant, source, binary = full("bsd-grant"), full("bsd-source"), full("bsd-binary")
    names = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    probes = {
        "BSD-3-Clause": [f"{grant}\n{source}\n{binary}\n{names.format('the University')}", f"{grant} {source} {binary} {names.format('Example Corp., Inc.')}",
                         textwrap.fill(f"{grant} {source} {binary}") + "\n" + textwrap.fill(names.format("the Regents of the University of Somewhere"))],
        "BSD-2-Clause": [f"{grant}\n{source}\n{binary}"], "AGPL-3.0-or-later": [full("agpl3-later") + " " + full("gpl-hope") + " " + full("agpl-see")],
        "LGPL-2.1-or-later": [full("lgpl21-later")], "LGPL-3.0-or-later": [textwrap.fill(full("lgpl3-later"))],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", full("boost-grant")], "Zlib": [full("zlib-warranty") + "\n" + full("zlib-grant")],
        "MIT": ["// SPDX-License-Identifier: MIT", "Licensed under the MIT license, see LICENSE for details.", "The MIT License (MIT)", "MIT License"],
        "GPL-2.0-or-later": ["# SPDX-License-Identifier: GPL-2.0-or-later"], "": ["We talked about the MIT license and licences at large.", "rights of way"]}
    rows = [(text, want) for want, texts in probes.items() for text in texts]
    got = licences.scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_unmatched) for r in got} == {i: (w, 0) for i, (_, w) in enumerate(rows)}
    # The same in SQL, where a sentence stands in one line.
    import duckdb
    con = duckdb.connect()
    plain = [(i, t) for i, (t, _) in enumerate(rows) if "\n" not in t.replace(".\n", ". ").replace(":\n", ": ") and "Inc. " not in t]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", plain)
    found = {x[0]: x[3] for x in con.execute(licences.oracle_sql()).fetchall()}
    assert found == {i: rows[i][1] for i, _ in plain}


def test_digests_are_those_of_the_tokens(spark, folder):
    path = queries.tokenizer_path()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20").select("doc_id", "text")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path, bpe.build_lexicon(docs, path)).collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op5_bpe"](spark, folder).where("doc_id < 20").collect()}
    for i, x in ids.items():
        assert got[i].n_tokens == len(x) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
