"""Spelling variants, whitening and repeated byte strings against brute force, and on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import common, parsing, queries, spelling, whitening


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    of = {w: [x for n in (len(w) - 1, len(w), len(w) + 1) for x in by_size[n] if near(w, x)] for w in words}
    best = {w: min(of[w], key=lambda x: (-words[x], x)) for w in words if of[w]}
    form = {w: f for w, f in best.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(of[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.fixture(scope="module")
def odd_words(spark):
    rng = random.Random(3)
    letters = "abcdeéß÷ÿ"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 7))) for _ in range(60)]
    words += [w[:2] + rng.choice(letters) + w[3:] for w in words] + [w[:-1] for w in words] + ["aaaaa", "aaaaaa", "z" * 3_000, "z" * 3_001, "z" * 2_999 + "y"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + " " + " ".join(words[-5:]), "x", 1) for i in range(60)]
    rows += [(None, "Straße ÉTÉÉÉ été2été " * 5, "x", None), (7, None, None, 2), (8, "", "y", 3), (9, "Aaaaa AAAAAĀaaaaa", "y", 3), (9, "Aaaaa AAAAAĀaaaaa", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int").withColumns({"form": F.lit("f"), "root": F.lit(1), "__of": F.lit(2), "other": F.lit(3)})


def test_spelling_variants(spark, odd_words):
    want = brute_variants([(r.doc_id, r.text) for r in odd_words.collect()])
    assert {tuple(r) for r in spelling.variants(odd_words).collect()} == want and len(want) > 100
    assert max(len(w[0]) for w in want) == 3_001
    # Many shards, a few in a pass, give the same.
    few = spelling.variants(odd_words.where("doc_id < 20 and length(text) > 5"), pass_blocks=3, shard_blocks=1)
    assert {tuple(r) for r in few.collect()} == brute_variants([(r.doc_id, r.text) for r in odd_words.where("doc_id < 20").collect()])
    assert spelling.variants(odd_words.limit(0)).count() == 0 and spelling.variants(odd_words.where("text is null or text = ''")).count() == 0


def test_spelling_variants_of_the_tables(spark, small):
    docs = common.read(spark, small, "documents")
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, small).collect()}
    assert got == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_filters_miss_no_word():
    words = [f"word{i}" for i in range(1_000, 3_000)]
    hashes = spelling.word_hashes(words)
    bits = np.zeros((64, 8), np.uint64)
    for p in range(spelling.PROBES):
        bit = spelling._bit(hashes, p)
        np.bitwise_or.at(bits, (spelling._places(hashes, 64), (bit >> np.uint64(6)).astype(int)), np.uint64(1) << (bit & np.uint64(63)))
    known = spelling.Filters({8: 64}, {(8, 0): bits.tobytes()})
    assert len(known.maybe(hashes, 8)) == 2_000 and not len(known.maybe(hashes, 9))
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert len(known.maybe(others, 8)) < 2_000
    alphabet = np.array(sorted(map(ord, "abdorw0123é")), np.uint32)
    pair = ["woord0", "aaébbw"]
    (rows, c), = spelling.by_length(pair, 1_000)
    made = defaultdict(list)
    for hashes, is_edit, letter, length in spelling.edits(c, alphabet):
        for i, place in zip(*np.nonzero(is_edit)):
            word = spelling.edited(pair[rows[i]], int(place), letter)
            assert len(word) == length and spelling.word_hashes([word])[0] == hashes[i, place]
            made[pair[rows[i]]].append(word)
    for word in pair:
        want = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + chr(a) + word[i + 1 :] for i in range(6) for a in alphabet if a > ord(word[i])}
        assert sorted(made[word]) == sorted(want)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w40") for i in range(40)}


def dense_whitening(x, k):
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order], c, values.sum(), [int(v) for v in ((n * x - s) ** 2).sum(1)]


def check_whitening(rows, got, k):
    """``rows``: (id, fixed-point vector), ids unlike."""
    x = np.array([v for _, v in rows])
    values, vectors, c, trace, deviation = dense_whitening(x, k)
    of = {i: at for at, (i, _) in enumerate(rows)}
    table = np.full((len(rows), k), np.nan)
    for r in got:
        table[of[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviation[of[r.vec_id]] and r.identity_error <= 1e-9
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) <= 1e-9
    assert len(got) == k * len(rows)
    want = c @ vectors / np.sqrt(values)
    for j in range(k):
        assert min(np.abs(table[:, j] - want[:, j]).max(), np.abs(table[:, j] + want[:, j]).max()) < 1e-7


def test_whitening_of_the_tables(spark, small):
    rows = [(r.vec_id, np.floor(1024 * np.array(r.embedding)).astype(np.int64) + 100_000) for r in common.read(spark, small, "embeddings").collect()]
    check_whitening(rows, queries.op12_whitening(spark, small).collect(), 8)


def test_whitening_filters_a_flat_spectrum(spark):
    """Two strong directions, then 58 nearly equal ones, some equal: residuals certify the first components."""
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((3_000, 60)) * np.append([8, 4], np.linspace(1.3, 1, 58)) * 1024) / 1024
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    found = whitening.fit(df, k=4)
    assert found.residual <= whitening.CERTIFIED and found.passes > 2 + whitening.DEGREE
    rows = [(i, np.floor(1024 * v).astype(np.int64) + 100_000) for i, v in enumerate(x)]
    check_whitening(rows, whitening.whiten(df, k=4).collect(), 4)


def test_whitening_of_odd_tables(spark):
    good = [[0.5, 1.0, -2.0], [1.5, 1.0, 2.0], [-0.25, 3.0, 1.0], [7.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (1, good[1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, whitened string, n int").withColumn("__at", F.lit(1))
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 6 and {r.n for r in got} == {6} and {r.vec_id for r in got} == {0, 1, 2, 3, None}
    assert max(r.identity_error for r in got) < 1e-9 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    assert Counter(r.deviation for r in got if r.component == 1) == Counter(((6 * x - x.sum(0)) ** 2).sum(1).tolist())
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 90")).where("n > 1").count() == 0
    huge = spark.createDataFrame([(i, [2.0**30 * i, 1.0 + i % 2]) for i in range(4)], "vec_id long, embedding array<double>")
    exact = {i: (4 * (2**40 * i + 100_000) - sum(2**40 * j + 100_000 for j in range(4))) ** 2 + (4 * (1024 * (1 + i % 2)) - sum(1024 * (1 + j % 2) for j in range(4))) ** 2 for i in range(4)}
    assert {r.vec_id: r.deviation for r in whitening.whiten(huge).collect()} == {i: v if v < 1 << 63 else None for i, v in exact.items()}


def brute_repeats(rows, length):
    """``rows``: (id, text), each of them once."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(data), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out


def found_repeats(df):
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()}


@pytest.fixture(scope="module")
def repeats(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijé", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(25)
    rows = [(i, f"{prose(rng.randint(0, 40))} {line if i % 2 else shared[i : 150 + i]} {prose(rng.randint(0, 40))}") for i in range(80)]
    rows += [(100, shared), (101, shared), (102, shared[1:]), (103, "x" + shared[:-1]), (104, "a" * 5_000), (105, "ab" * 3_000 + "c" * 99), (106, None), (107, ""), (108, "a" * 100), (109, "b" * 99), (None, f"{line} {line}")]
    rows += [(110, prose(4_000)), (111, rows[-1][1] * 3)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, n_bytes int").withColumns({"id": F.lit(1), "at": F.lit(2), "__spans": F.lit(3)}).repartition(7)


@pytest.mark.parametrize("length, gram", [(100, 32), (20, 8), (9, 32)])
def test_repeated_strings(spark, repeats, length, gram):
    got = parsing.dedup(repeats, length, gram)
    assert set(got.columns) == {*repeats.columns, "spans"} and got.count() == repeats.count()
    assert found_repeats(got) == brute_repeats([(r.doc_id, r.text) for r in repeats.collect()], length)


@pytest.mark.parametrize("more", [{}, {"sorted_phrases": 2}, {"crowd": 3, "crowd_share": 1 << 30}])
def test_repeated_strings_in_small_pieces_and_crowds(spark, repeats, more):
    """Texts in parts, tasks that hold little, small sorts, and frequent triggers by digests: the same result."""
    want = brute_repeats([(r.doc_id, r.text) for r in repeats.collect()], 100)
    limits = parsing.Limits(piece=500, held=50, sorted_bytes=2_000, **more)
    assert found_repeats(parsing.dedup(repeats, limits=limits)) == want


def test_repeated_rows_ids_and_empty_tables(spark, repeats):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefgh", k=150)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a + b), (None, b), (None, b)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, len(r.kept)) for r in parsing.dedup(df).collect())
    assert got == Counter({(1, 150, 150): 2, (1, 150, 0): 1, (2, 300, 0): 1, (None, 150, 150): 2}) or got == Counter({(1, 150, 150): 2, (1, 150, 0): 1, (2, 300, 2): 1, (None, 150, 150): 2})
    assert parsing.dedup(repeats.limit(0)).count() == 0
    assert parsing.dedup(repeats.where("text is null")).first()["kept"] == b""


def test_repeated_strings_of_the_tables(spark, small):
    import hashlib

    want = brute_repeats([(r.doc_id, r.text) for r in common.read(spark, small, "documents").collect()], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op13_suffix_dedup(spark, small).collect()}
    assert got == {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, (n, spans, kept) in want.items()}


def test_suffix_ranks_are_lexicographic():
    data = bytes(random.Random(4).choices(b"ab", k=400))
    for length in (3, 8, 32, 33, 100):
        starts = np.arange(400 - length)
        ranks = parsing.suffix_ranks(np.frombuffer(data, np.uint8), starts, length)
        strings = [data[s : s + length] for s in starts]
        place = {x: i for i, x in enumerate(sorted(set(strings)))}
        assert [place[x] for x in strings] == ranks.tolist()
