"""The training-data operators against brute force, round trips, held-out labels, and odd tables."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import common, components, decontaminate, language, licenses, neardup, neighbours, packing, quality, queries, substring, tokens, toxicity

TEXT = "the quick brown fox jumps over the lazy dog and then it runs away from all of the other animals"
LINE = "one line that has rather more than ten words in it so that it counts as a unit"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and long texts, and columns whose names the operators use themselves."""
    rows = [
        (1, TEXT, "en", "a", 1), (1, TEXT, "en", "a", 1), (2, None, None, None, 2), (3, "", "en", "a", 3), (None, TEXT, "en", "b", 4), (4, "  \n\t ", "fr", "b", 5),
        (5, f"{LINE}\n{TEXT}", "en", "c", 6), (6, f"{LINE}\n\n{LINE.upper()}!", "fr", "c", 7), (7, "word " * 30_000, "en", "c", 8), (8, "été ça où " * 20 + "\x00 <|endoftext|>", "fr", None, None), (9, "12345 $$$", "en", "d", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n_words int").withColumns({"digest": F.lit("x"), "component_id": F.lit(1), "sequence_id": F.lit(2), "__id": F.lit(3)})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TEXT), (2, "short item"), (2, "short item"), (3, None), (4, ""), (None, "it runs away")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")


def docs_of(spark, sf):
    return common.read(spark, sf, "documents")


def test_odd_and_empty_tables(spark, odd, bench, labels):
    none = odd.limit(0)
    n = odd.count()
    assert decontaminate.contamination(odd, bench).count() == n and decontaminate.contamination(none, bench).count() == 0
    assert licenses.scan_licenses(odd).count() == n and licenses.scan_licenses(none).count() == 0
    assert neardup.near_duplicates(odd).count() == n and neardup.near_duplicates(none).count() == 0
    assert quality.quality(odd, labels).count() == n and quality.quality(none, labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).where("good").count() > 0
    assert language.identify(odd, odd).count() == n and language.identify(none, none).count() == 0
    assert toxicity.toxicity(odd, labels).count() == n and toxicity.toxicity(none, labels).count() == 0
    assert packing.pack(none).count() == 0 and tokens.token_counts(none).count() == 0
    assert substring.drop_repeated(odd).columns == odd.columns and substring.drop_repeated(odd).count() == n
    assert substring.drop_repeated(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == n


def test_decontamination(spark, odd, bench):
    rows = decontaminate.contamination(odd, bench)
    by = {(r.doc_id, r.n_words): r for r in rows.collect()}
    hit = by[(1, 20)]
    assert (hit.n_hit, hit.n_items, hit.items_sha256) == (20, 1, hashlib.sha256(b"1").hexdigest()) and hit.contaminated
    assert not by[(2, 0)].contaminated and next(r for r in rows.collect() if r.doc_id == 5).n_hit == 20
    other = decontaminate.contamination(odd, bench, broadcast_bytes=0)
    assert rows.exceptAll(other).isEmpty() and other.exceptAll(rows).isEmpty()
    left = decontaminate.remove_spans(odd, bench).where("doc_id = 5").first()["text"]
    assert left == LINE + "\n"


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.default_vocabulary())
    rows = packing.pack(odd, size=64, with_ids=True).collect()
    got = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 64 and 0 <= r.offset <= 64 - r.length
        got[r.sequence_id].append((r.offset, r.length))
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    texts = {r.doc_id: r.text for r in odd.collect()}
    for doc in (2, 3, 4, 5, 8):
        ids = [i for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece) for i in r.ids]
        assert ids == [*exact.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
    total = sum(r.length for r in rows)
    assert len(got) <= -(-total // 64) + 2


def test_bpe_equals_tokenizers():
    from tokenizers import Tokenizer

    exact, own = Tokenizer.from_file(tokens.default_vocabulary()), tokens.ByteBpe(tokens.load_vocabulary(None))
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the ", " ", "\n", "é", "it's", "12", "!?", "\t", "漢", "<|endoftext|>", " x", " ", "🙂"]) for _ in range(rng.randint(0, 40)))
        assert own.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    tokens.CALL_CHARS, before = 50, tokens.CALL_CHARS
    try:
        assert own.ids(TEXT * 20).tolist() == exact.encode(TEXT * 20, add_special_tokens=False).ids
    finally:
        tokens.CALL_CHARS = before


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        taken = packing.fullest(counts, 40)
        sums, longest = {max(counts)}, max(counts)  # what can be reached with one of the longest length
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + (x != longest)) if s + k * x <= 40}
        assert longest in taken and sum(x * k for x, k in taken.items()) == max(sums)
        assert all(k <= counts[x] for x, k in taken.items())
    assert packing.fullest({7: 1, 5: 1, 3: 2}, 13) == {7: 1, 3: 2}


def test_token_counts(spark, odd):
    rows = tokens.token_counts(odd.where("doc_id != 1")).groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
    assert len(rows) == 8 and all(r.n == r.doc_tokens for r in rows)
    start, counts, crossing = tokens.section_counts(b"ab\ncd", np.array([0, 1]), np.array([2, 3]), "start")
    assert start.tolist() == [0, 3, 5] and counts.tolist() == [2, 0] and crossing.tolist() == [1, 0]
    assert tokens.section_counts(b"ab\ncd", np.array([0, 1]), np.array([2, 3]), "majority")[1].tolist() == [1, 1]
    assert tokens.section_counts(b"ab\ncd", np.array([0, 1]), np.array([2, 3]), "end")[1].tolist() == [1, 1]


def test_token_counts_against_the_tokenizers_offsets(spark, small):
    """Every token's characters, as the tokenizer itself gives them, put into lines one by one, under each rule."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.default_vocabulary())
    texts = [r.text for r in docs_of(spark, small).where("length(text) < 3000").limit(60).collect()]
    texts += ["a\n\n\nb\n", "\n", "x \n \n  y", "one\r\ntwo\n\n  three", "1\n22\n\n\n\n333", "été\nça\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    byte_of = {c: i for i, c in enumerate(_byte_letters())}
    for rule in tokens.RULES:
        got = defaultdict(list)
        for r in tokens.token_counts(docs, rule=rule).orderBy("doc_id", "section").collect():
            got[r.doc_id].append((r.start, r.end, r.n_tokens, r.n_crossing))
        for i, text in enumerate(texts):
            raw = text.encode()
            lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * (not text.endswith("\n"))
            line_of = [k for k, x in enumerate(lines) for _ in x.encode()]
            at, n, crossing = 0, [0] * len(lines), [0] * len(lines)
            for token in exact.encode(text, add_special_tokens=False).tokens:
                size = len(bytes(byte_of[c] for c in token))
                own = line_of[at : at + size]
                most = max(sorted(set(own)), key=own.count)
                n[{"start": own[0], "end": own[-1], "majority": most}[rule]] += 1
                crossing[own[0]] += own[0] != own[-1]
                at += size
            assert at == len(raw)
            begins = [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
            assert got[i] == list(zip(begins, begins[1:], n, crossing)), (rule, text)


def _byte_letters():
    """The letters by which a byte-level vocabulary writes the bytes 0 to 255: printable ones as themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def test_licenses_against_brute_force(spark, small):
    """Templates as regular expressions over the joined words, phrases by comparing every place."""
    import re

    rules = {}
    for label, markup in licenses.TEMPLATES.items():
        parts = []
        for opens, closes, most, word in re.findall(r"(\[\[)|(\]\])|\{\{(\d+)\}\}|([^\s\[\]{}]+)", markup):
            parts.append("(?:" if opens else ")?" if closes else f"(?:[^ ]+ ){{0,{most}}}" if most else re.escape(word) + " ")
        rules[label] = re.compile("(?<= )" + "".join(parts))
    rng = random.Random(9)
    texts = [r.text for r in docs_of(spark, small).collect()]
    for _ in range(150):
        markup = rng.choice(list(licenses.TEMPLATES.values()))
        text = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", markup)
        text = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(["zz"] * rng.randint(0, int(m[1]) + 1)), text)
        w = text.split()
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = rng.choice(["zz", "the", "software"])
        texts.append(" ".join(["so", *w, "mit"] + ["license"] * rng.randint(0, 2)).title())
    texts += ["mit license " * 20_000 + "end", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in licenses.scan_licenses(docs).collect():
        w = [x.decode() for x in common.words((texts[r.doc_id] or "").encode())]
        line = f" {' '.join(w)} "
        at = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in licenses.PHRASES}
        found = sorted(k for x in at.values() for k in x)
        base = sorted({licenses.PHRASES[p] for p, x in at.items() if x})
        more = {label for label, rule in rules.items() if rule.search(line)}
        want = (len(w), len(found), found[0] if found else None, found[-1] if found else None, ",".join(base), ",".join(sorted({*base, *more})), 1.0 if more else 0.5 if base else 0.0)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, texts[r.doc_id]


def test_licenses(spark):
    mit = licenses.TEMPLATES["text:mit"].replace("[[the software]]", "").replace("{{4}}", "3").replace("[[including the next paragraph]]", "")
    rows = [(1, "Released under the MIT License."), (2, mit.upper()), (3, mit.replace("granted", "given")), (4, "mit license mit license gnu general public license"), (5, None), (6, "limit license")]
    by = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert by[1].labels == "mit,notice:mit" and by[1].first_word == 3 and by[1].score == 1
    assert by[2].labels == "text:mit" and by[3].labels == "" and by[6].n_base == 0
    assert (by[4].n_base, by[4].first_word, by[4].last_word, by[4].base_labels) == (3, 0, 5, "gpl,mit")
    assert by[5].n_words == 0 and by[5].first_word is None and by[5].score == 0


def test_near_duplicates_against_brute_force(spark, small):
    for block, bucket in ((neardup.BLOCK_SHINGLES, neardup.BUCKET_ROWS), (2_000, 8)):
        old = neardup.BLOCK_SHINGLES, neardup.BUCKET_ROWS
        neardup.BLOCK_SHINGLES, neardup.BUCKET_ROWS = block, bucket
        try:
            rng = random.Random(1)
            base = [f"w{rng.randint(0, 500)}" for _ in range(60)]
            rows = [(r.doc_id, r.text) for r in docs_of(spark, small).select("doc_id", "text").collect()]
            for k in range(60):  # a group of near copies, chained
                copy = list(base)
                for _ in range(rng.randint(0, 3)):
                    copy[rng.randint(0, 59)] = f"x{rng.randint(0, 9)}"
                rows.append((10_000 + k, " ".join(copy)))
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
        finally:
            neardup.BLOCK_SHINGLES, neardup.BUCKET_ROWS = old
        sets = {}
        for i, t in rows:
            w = common.spaced_words(t.encode())
            sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        up = {i: i for i in sets}

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        ids = sorted(sets)
        for x, a in enumerate(ids):
            for b in ids[:x]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
        assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_apart_from_speakers(spark, monkeypatch):
    """Pairs alike to each other alone, in buckets that many unlike documents share: every block of a bucket is asked."""
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 8)
    monkeypatch.setattr(neardup, "SPEAKERS", 0)
    # A weak first band makes one bucket of all documents.
    monkeypatch.setattr(neardup, "band_keys", lambda minima: np.array([7], np.int64))
    rng = random.Random(2)
    rows = []
    for k in range(60):
        text = [f"p{k}_{rng.randint(0, 1 << 30)}" for _ in range(50)]
        rows += [(2 * k, " ".join(text)), (1_000 + 2 * k, " ".join([*text[:-1], "other"]))]
    rows.append((5_000, "nothing like the others at all here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = neardup.signatures(docs, 4, "doc_id", "text").select(F.lit(7).cast("long").alias("key"), F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "sig")
    links = {(min(r), max(r)) for r in neardup.similar_across_blocks(nodes, 0.65).collect()}
    # The one label left out is the largest: all others ask.
    assert links == {(2 * k, 1_000 + 2 * k) for k in range(60)}


def test_short_documents_in_one_group(spark):
    """Twenty thousand different short texts that all share most words: blocks are bounded by documents, too."""
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z x{i}") for i in range(20_000)]
    began = time.time()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).agg(F.max("component_id"), F.count_if("kept"), F.count("*")).first()
    assert tuple(got) == (0, 1, 20_000) and time.time() - began < 120


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 300: 300}
    star = spark.createDataFrame([(500, i) for i in range(501, 3_000)] + [(2_999, 1)], "a long, b long")
    assert components.components(star).where("component = 1").count() == 2_501


def test_signature_estimate():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))])
    est = neardup.estimate(neardup.packed(neardup.sketch(a)), neardup.packed(neardup.sketch(b))[None])[0]
    assert abs(est - 800 / 1200) < 0.15


def test_neighbours_recall(spark, small):
    rows = common.read(spark, small, "embeddings")
    odd_rows = spark.createDataFrame([(100_001, None, 0), (100_002, [0.0] * 64, 0), (100_003, [float("nan")] * 64, 0), (100_004, [None] * 64, 0), (100_005, [1.0], 0)], rows.schema)
    got = queries.neighbours.nearest(rows.unionByName(odd_rows), rows.where("vec_id % 20 = 0")).collect()
    p = rows.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    truth = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        truth |= {(ids[q], ids[j]) for j in np.lexsort((ids, -s))[:20]}
    assert len(truth & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(truth)
    by = {i: v for i, v in zip(ids, x, strict=True)}
    assert all(abs(r.score - by[r.query_id] @ by[r.vec_id]) < 1e-9 for r in got)
    assert neighbours.nearest(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-6, 3e-3])
def test_neighbours_recall_among_near_copies(spark, noise):
    """Thousands of slightly different copies, with equal codes and with codes that differ: their order is that of the exact scores."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4_000, 16))
    x[1_000:] = x[0] + noise * rng.standard_normal((3_000, 16))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(1_000, 4_000, 200))
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(rows, rows.where(F.col("vec_id").isin(asked))).collect()}
    truth = set()
    for q in asked:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        truth |= {(q, int(j)) for j in np.lexsort((np.arange(len(x)), -s))[:20]}
    assert len(truth & got) >= 0.95 * len(truth)


def test_neighbours_ties_and_repeated_ids(spark):
    """Equal scores go to smaller ids in any block; repeated ids are one candidate with the best score."""
    rows = [(i, [1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)] + [(50, [2.0, 0.0, 0.0, 0.0, 2.0]), (50, [3.0, 0.0, 0.0, 0.0, 3.0]), (50, [3.0, 0.0, 0.0, 0.0, 3.0]), (7, [1.0, 0.0, 0.0, 0.0, 0.5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string")
    for size in (neighbours.BLOCK_ROWS, 9):
        old, neighbours.BLOCK_ROWS = neighbours.BLOCK_ROWS, size
        try:
            got = neighbours.nearest(table, table.where("vec_id in (7, 50)"), k=5).orderBy("query_id", "rank").collect()
        finally:
            neighbours.BLOCK_ROWS = old
        # Row 7 asks with its smaller vector, (1, 0, 0, 0, 0.5).
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(7, 1, 50, 4.5), *[(7, k + 2, k, 1.5) for k in range(4)], *[(50, k + 1, k, 4.0) for k in range(5)]]


def test_codes_pack():
    rng = np.random.default_rng(1)
    for parts in (1, 6, 7):
        codes = rng.integers(0, 16, (20, parts)).astype(np.uint8)
        assert (neighbours.unpacked(neighbours.packed(codes), parts) == codes.T).all() and neighbours.packed(codes).shape == (20, -(-parts // 2))


def test_quality_prefers_trusted_text(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["the", "house", "stands", "on", "a", "hill"]) for _ in range(60)) + ".", "en") for i in range(60)]
    bad = [(100 + i, "".join(rng.choice("qzxj#%$@&*") for _ in range(300)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert sum(got[i].good for i in range(40, 60)) >= 17 and not any(got[100 + i].good for i in range(20))


def test_kneser_ney_against_brute_force(spark):
    """Perplexities by the textbook formula over plain dictionaries, and probabilities after each context that sum to one."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    new = ["ab cd zz ef", "zz", "", "kl kl kl", None, "?!"]
    n = defaultdict(int)
    for t in texts:
        w = ["<", *t.split(), ">"]
        for pair in zip(w, w[1:]):
            n[pair] += 1
    before = defaultdict(set)
    for a, b in n:
        before[b].add(a)
    lower = {b: len(x) for b, x in before.items()}
    hist = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    d2, d1 = quality._discounts(hist(n.values())), quality._discounts(hist(lower.values()))
    cut = lambda d, c: d[min(c, 3) - 1]
    all_lower, unk = sum(lower.values()), sum(cut(d1, c) for c in lower.values()) / sum(lower.values()) / (len(lower) + 1)
    p1 = lambda b: (lower[b] - cut(d1, lower[b])) / all_lower + unk if b in lower else unk

    def p2(a, b):
        own = {y: c for (x, y), c in n.items() if x == a}
        if not own:
            return p1(b)
        total = sum(own.values())
        return max(own.get(b, 0) - (cut(d2, own[b]) if b in own else 0), 0) / total + sum(cut(d2, c) for c in own.values()) / total * p1(b)

    for a in ("ab", "<", "zz"):
        assert abs(sum(p2(a, b) for b in [*lower, "zz"]) - 1) < 1e-9
    docs = spark.createDataFrame(list(enumerate(new + texts)), "doc_id int, text string")
    model = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, model, ("doc_id",)).collect()}
    assert len(got) == len(new + texts)
    for i, t in enumerate(new + texts):
        w = ["<", *(t or "").replace("?!", "").split(), ">"]
        if len(w) == 2:
            assert got[i] is None
        else:
            assert abs(got[i] / np.exp(-np.mean([np.log(p2(a, b)) for a, b in zip(w, w[1:])])) - 1) < 1e-5


def test_quality_without_frequent_grams(spark, monkeypatch):
    """All grams by the join of shards give what a lookup of the frequent ones gives."""
    docs = docs_of(spark, "/root/testdata/sf0.001")
    one = quality.perplexities(docs, docs.where("doc_id % 3 = 0"), ("doc_id",)).withColumn("perplexity", F.round("perplexity", 2))
    one = {r.doc_id: r.perplexity for r in one.collect()}
    monkeypatch.setattr(quality, "HOT", 2.5)
    two = {r.doc_id: r.perplexity for r in quality.perplexities(docs, docs.where("doc_id % 3 = 0"), ("doc_id",)).collect()}
    assert one.keys() == two.keys() and all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 0.02 + 1e-4 * one[k]) for k in one)


def test_language_held_out(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    p = language.identify(docs, docs.where(~language.held_out())).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd_rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$"), (4, "der und die")], "doc_id int, text string")
    assert [r.lang_pred == "und" for r in language.identify(odd_rows, docs).orderBy("doc_id").collect()] == [True, True, True, False]


def test_language_against_brute_force(spark, small):
    """Whole encodings of each piece with plain dictionaries, beside what the operator says of every text."""
    import zstandard

    docs = docs_of(spark, small)
    dicts = language.dictionaries(docs)
    sizes = lambda raw, lang, level, count: sum(
        len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[at : at + language.PIECE_BYTES]))
        for d in dicts[lang][:count] for at in range(0, len(raw), language.PIECE_BYTES)
    ) / count
    got = {r.doc_id: r for r in language.identify(docs, docs).collect()}
    some = docs.orderBy(F.length("text").desc()).limit(3).union(docs.where("length(text) < 2000").limit(30)).collect()
    for r in some:
        raw = language.letters(r.text)
        for level, count in ((language.LEVELS[0], 1), (language.LEVELS[1], None)):
            by = sorted((sizes(raw, lang, level, count or len(dicts[lang])), k, lang) for k, lang in enumerate(dicts))
            margin = (by[1][0] - by[0][0]) / by[1][0]
            if margin >= language.NARROW:
                break
        assert got[r.doc_id].lang_pred == by[0][2] and abs(got[r.doc_id].score - 1 / (1 + np.exp(-20 * margin))) < 1e-9


def test_all_languages_are_learned(spark):
    """Hundreds of languages share the bytes of the dictionaries; copies of one text don't crowd out others."""
    rng = random.Random(7)
    rows = []
    for k in range(150):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(f"l{k:03d}", " ".join(rng.choice(own) for _ in range(40)), 200 * k + j) for j in range(4)]
        rows += [(f"l{k:03d}", rows[-1][1], 200 * k + j) for j in range(10, 30)]
    train = spark.createDataFrame(rows, "lang string, text string, doc_id long")
    dicts = language.dictionaries(train)
    assert len(dicts) == 150 and sum(len(d) for x in dicts.values() for d in x) <= language.ALL_BYTES
    assert all(r[1].split()[0].encode() in b" ".join(dicts[r[0]]) for r in rows)
    found = language.identify(train.where("doc_id % 200 = 1"), train).join(train.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 145


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).where("held_out").join(common.read(spark, sf, "labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id").toPandas()
    assert got.toxic.sum() > 50 and (got.predicted == got.toxic).mean() > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.04


def test_remove_spans_by_join(spark, odd, bench):
    one = decontaminate.remove_spans(odd, bench).select("doc_id", "text")
    two = decontaminate.remove_spans(odd, bench, broadcast_bytes=0).select("doc_id", "text")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.where("text is null").count() == 1
    named = odd.withColumn("__digest0", F.lit("mine"))
    assert decontaminate.drop_contaminated(named, bench, broadcast_bytes=0).where("__digest0 = 'mine'").count() == decontaminate.drop_contaminated(odd, bench).count()


def test_toxicity_learns_marked_words(spark):
    rng = random.Random(6)
    make = lambda bad: [("w%d" % rng.randint(0, 400)).encode() for _ in range(70)] + ([b"nasty"] * 3 if bad else [b"plain"] * 3) + [b"end"] * 5
    y = [k % 2 for k in range(800)]
    p = toxicity.train([make(k) for k in y], y, epochs=14)
    test = [k % 2 for k in range(100)]
    s = toxicity.score_texts([make(k) for k in test], p)
    assert np.mean((s >= 0.5) == np.array(test)) > 0.9


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    v = toxicity.Vocabulary([[b"abc", b"de", b"xyz"], [b"q", b"abc", b"hello", b"a"]])
    p = {k: x.astype(np.float64) for k, x in toxicity.new_parameters(rng).items()}
    _, at, n = toxicity.windows_of(v)
    y = np.array([1.0, 0.0])
    _, g = toxicity.gradients(v, at, n, y, p)
    for k in ("word", "char", "wf", "bb", "wa", "wo"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = p[k][i]
        p[k][i] = old + 1e-2
        up = toxicity.gradients(v, at, n, y, p)[0]
        p[k][i] = old - 1e-2
        down = toxicity.gradients(v, at, n, y, p)[0]
        p[k][i] = old
        assert abs(g[k][i] - (up - down) / 2e-2) < 1e-4


def test_substring_ranks(spark, odd):
    rows = substring.dedup(odd.where("doc_id in (5, 6)")).orderBy("doc_id").collect()
    assert rows[0].removed == [] and rows[0].text == f"{LINE}\n{TEXT}"
    assert [(r.start, r.end, r.first_doc_id, r.first_unit) for r in rows[1].removed] == [(0, len(LINE), 5, 0), (len(LINE) + 2, 2 * len(LINE) + 3, 5, 0)]
    assert substring.drop_repeated(odd.where("doc_id in (5, 6)")).where("doc_id = 6").first()["text"] == ""
    clashing = odd.withColumn("removed", F.lit("mine"))
    assert substring.drop_repeated(clashing).columns == clashing.columns and substring.drop_repeated(clashing).where("removed = 'mine'").count() == odd.count()


def brute_substring(texts, min_words):
    """What is left of the texts, and of which the lines of ten words or more go, or the common ones."""
    parts = [substring.pieces_of((t or "").encode()) for t in texts]
    known = [[(k, tuple(w)) for k, p in enumerate(found) if (w := common.words(p))] for found in parts]
    lines = []
    for i, found in enumerate(parts):
        unit, line = 0, []
        for p in [*found, b"\n"]:
            if common.words(p):
                line.append(unit)
                unit += 1
            elif p == b"\n" and line:
                lines.append((i, line, tuple(w for u in line for w in known[i][u][1])))
                line = []
    count, seen_lines, seen, left = Counter(w for _, _, w in lines), set(), set(), {}
    whole = defaultdict(set)
    for i, line, w in lines:
        if w in seen_lines and (len(w) >= 10 or count[w] >= max(20, 0.05 * len(texts))):
            whole[i] |= set(line)
        seen_lines.add(w)
    for i, found in enumerate(parts):
        again = []
        for _, w in known[i]:
            again.append(w in seen)
            seen.add(w)
        going, u = set(whole[i]), 0
        while u < len(again):
            v = u
            while v < len(again) and again[v]:
                v += 1
            if sum(len(known[i][x][1]) for x in range(u, v)) >= min_words:
                going |= set(range(u, v))
            u = max(v, u + 1)
        out, u = set(), 0
        while u < len(again):
            v = u
            while v in going:
                v += 1
            if v > u:
                low, high = known[i][u][0], known[i][v][0] if v < len(again) else len(found)
                at_line = low == 0 or found[low - 1] == b"\n"
                out |= set(range(low, high if at_line else known[i][v - 1][0] + 1))
            u = max(v, u + 1)
        left[i] = None if texts[i] is None else b"".join(p for k, p in enumerate(found) if k not in out).decode()
    return left


@pytest.mark.parametrize("min_words", [30, 1])
def test_substring_against_brute_force(spark, min_words):
    """Passages that begin and end inside sentences, in other lines and cases, lone repeated sentences, and repeated lines of
    few and many words; with ``min_words`` 1 nothing repeats any more."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize().replace("É", "é")
    passage = [sentence(8) for _ in range(9)]
    lone, nine, ten, long, common_line = sentence(12), sentence(9), f"{sentence(4)}. {sentence(6)}", f"{sentence(20)}! {sentence(9)}", sentence(3)
    texts = [f"{sentence(5)}. {'. '.join(passage)}. {sentence(6)}.", f"{sentence(9)}!\n{word()} {'.\n'.join(passage)} {word()}. {sentence(3)}", f"{lone}. {sentence(9)}", f"{sentence(9)}. {lone}?", f"{sentence(4)}. {'! '.join(p.upper().replace('É', 'é') for p in passage[2:7])}! {sentence(4)}.", None, "", "tick tock. " * 60, "\n\n..."]
    texts += [". ".join(sentence(rng.randint(1, 12)) for _ in range(20)) for _ in range(20)]
    texts += [f"{sentence(5)}\n{x}\n{sentence(5)}\n{y}" for x in (nine, ten, long) for y in (x, ten.replace(".", ","), f"{x} {word()}")] + [f"{common_line}\n{sentence(4)}. {nine}" for _ in range(21)]
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    left = brute_substring(texts, min_words)
    for share in (common.HOT_SHARE, 1e-9):
        old, common.HOT_SHARE = common.HOT_SHARE, share
        try:
            got = {r.doc_id: r for r in substring.dedup(docs, min_words).collect()}
        finally:
            common.HOT_SHARE = old
        assert {i: r.text for i, r in got.items()} == left
        assert all(r.place == 2 * i for i, r in got.items())
        for i, r in got.items():
            for x in r.removed:
                kept = [w for p in substring.pieces_of(texts[x.first_doc_id].encode()) if (w := common.words(p))][x.first_unit :]
                assert b" ".join(common.words(texts[i][x.start : x.end].encode())) in b" ".join(sum(kept, []))
    lines = [w for t in left.values() for line in (t or "").split("\n") if len(w := tuple(common.words(line.encode()))) >= 10]
    assert len(lines) == len(set(lines))
    if min_words == 1:
        units = [w for t in left.values() for p in substring.pieces_of((t or "").encode()) if (w := tuple(common.words(p)))]
        assert len(units) == len(set(units))
    else:
        assert sum(t.count(common_line) for t in left.values() if t) == 1 and sum(t.count(nine) for t in left.values() if t) > 20
        assert left[7].split() == ["tick", "tock."]


def test_filters_judge_each_row_by_its_own_text(spark, bench):
    """Null and repeated ids: what is dropped or cut in one row leaves the others alone."""
    other = "some quite different words that nobody else uses stand on this line as its only text"
    rows = [(None, TEXT), (None, other), (7, TEXT), (7, f"{other} too"), (None, "12 34"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        kept = decontaminate.drop_contaminated(docs, bench.where("item_id = 1"), broadcast_bytes=limit)
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("text is null or text not like 'the quick%'").collect())), limit
    train = spark.createDataFrame([(1, TEXT, "en"), (2, "être où ça déjà " * 9, "fr")], "doc_id long, text string, lang string")
    found = language.identify(docs, train)
    kept = language.drop_rejected(docs, train)
    # The other texts compress alike in both languages: ties, which are rejected.
    assert found.where("not rejected").count() == 2 and [r.text for r in kept.collect()] == [TEXT, TEXT]
    assert neardup.drop_near_duplicates(docs).where("doc_id is null").count() == 3
    # Both texts of id 7 stand for themselves: one repeats a smaller id's text, the other doesn't.
    left = neardup.drop_near_duplicates(docs.where("doc_id is not null").union(spark.createDataFrame([(9, TEXT), (9, TEXT)], docs.schema)))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(7, TEXT), (7, f"{other} too"), (7, "")])
    twice = f"{LINE}\n{other}"
    lines = spark.createDataFrame([(None, f"a\n{twice}"), (None, f"b\n{TEXT}"), (1, f"{twice}\nc"), (1, f"{TEXT}\nd")], "doc_id long, text string")
    texts = {r.text for r in substring.drop_repeated(lines).collect()}
    assert texts == {f"a\n{twice}", f"b\n{TEXT}", "c", "d"}


def test_sql_twins(spark, small):
    import glob
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, small)
        cols = sorted(df.columns)
        got = sorted(repr([r[c] for c in cols]) for r in df.collect())
        ran = con.execute(sql)
        names = [d[0] for d in ran.description]
        assert got == sorted(repr([r[names.index(c)] for c in cols]) for r in ran.fetchall()), name


def test_pipeline_stages(spark, small):
    import corpus_pipeline as cp

    docs = docs_of(spark, small)
    one = common.materialise(cp.language_id(spark, docs, small))
    kept = {r.doc_id for r in language.identify(docs, docs.where(~language.held_out())).where("not rejected").collect()}
    assert {r.doc_id for r in one.select("doc_id").collect()} == kept and one.columns == docs.columns
    two = common.materialise(cp.near_dedup(spark, one, small))
    groups = neardup.near_duplicates(one).collect()
    assert {r.doc_id for r in two.select("doc_id").collect()} == {r.component_id for r in groups}
    three = common.materialise(cp.substring_dedup(spark, two, small))
    assert substring.dedup(three).where("size(removed) > 0").isEmpty() and three.count() == two.count()
    four = common.materialise(cp.decontamination(spark, three, small))
    assert decontaminate.contamination(four, common.read(spark, small, "benchmark")).where("contaminated").isEmpty()
    five = cp.best_fit_packing(spark, four, small)
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.select("doc_id").collect()}


def test_toxicity_scores_by_plain_loops(spark, labels):
    """The forward pass of whole texts, window by window and step by step, against the operator's scores."""
    docs = docs_of(spark, "/root/testdata/sf0.001")
    known = common.read(spark, "/root/testdata/sf0.001", "labels")
    p = toxicity.train(*toxicity.training_sample(docs, known, "doc_id", "text", "toxic"))
    again = toxicity.train(*toxicity.training_sample(docs.repartition(5), known, "doc_id", "text", "toxic"))
    assert all(np.array_equal(p[k], again[k]) for k in p)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    s = toxicity.STATE

    def word_input(w):
        padded = np.frombuffer(b"<" + w + b">", np.uint8).astype(np.int64)
        rows = [int((((a * 961 + b) * 961 + c) * 0x9E3779B1 & 0xFFFFFFFF) >> 7) % toxicity.CHAR_ROWS for a, b, c in zip(padded, padded[1:], padded[2:])]
        return np.concatenate([p["word"][zlib.crc32(w) % toxicity.WORD_ROWS], np.mean([p["char"][r] for r in rows], 0)])

    def states(xs, side):
        h, out = np.zeros(s), []
        for x in xs:
            g, a = x @ p[f"w{side}"] + p[f"b{side}"], h @ p[f"u{side}"]
            z, r = sigmoid(g[:s] + a[:s]), sigmoid(g[s : 2 * s] + a[s : 2 * s])
            cand = np.tanh(g[2 * s :] + r * a[2 * s :])
            h = (1 - z) * cand + z * h
            out.append(h)
        return out

    def score(text):
        w, best = common.words(text.encode()), -np.inf
        for at in range(0, max(len(w) - (toxicity.WINDOW - toxicity.STRIDE), 1), toxicity.STRIDE):
            xs = [word_input(x) for x in w[at : at + toxicity.WINDOW]]
            hidden = [np.concatenate(pair) for pair in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
            e = np.array([np.tanh(h @ p["wa"] + p["ba"]) @ p["va"] for h in hidden])
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            best = max(best, sum(x * h for x, h in zip(a, hidden)) @ p["wo"] + p["bo"][0])
        return sigmoid(best) if w else 0.0

    some = [r for r in docs.orderBy("doc_id").limit(40).collect() if r.text]
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()}
    assert max(abs(got[r.doc_id] - score(r.text)) for r in some) < 1e-4


def test_toxicity_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"vile words {i % 3}") for i in range(500)] + [(2, "kind words"), (3, "plain words")], "doc_id long, text string")
    found = toxicity.training_sample(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert sorted(zip(found[1], map(tuple, found[0]))) == [(0, (b"kind", b"words")), (0, (b"plain", b"words")), (1, (b"vile", b"words", b"0"))]


def test_toxicity_of_odd_rows(spark, labels):
    """Clashing columns, a null id, and a text of 40,000 words, whose worst window decides."""
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, ("rotten scum " if i % 2 else "sunny meadow ") * 20, 0.5, 9) for i in range(200)] + [(None, "rotten scum " * 20, 0.5, 9), (900, "sunny meadow " * 20_000 + "rotten scum " * 16 + "sunny meadow " * 20_000, 0.5, 9), (901, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(got) == 203 and got[None].predicted == 1 and got[901].score == 0
    assert got[900].predicted == 1 and all(got[i].predicted == i % 2 for i in range(200))


def test_near_duplicates_at_the_threshold(spark):
    """With a slack of 1 every pair that shares a band is compared on full sets: links of exactly 0.8 are all found."""
    base = [f"w{i}" for i in range(404)]
    rows = [(2 * g, " ".join(f"{w}g{g}" for w in base)) for g in range(60)]
    # 400 shingles of five words; eight changed words take 5 of them, one takes 4: 356 / 444 = 0.8018.
    for g in range(60):
        w = [f"{x}g{g}" for x in base]
        for at in (50, 130, 210, 290, 370, 398 - 6, 340, 20, 3):
            w[at] = f"x{at}g{g}"
        rows.append((2 * g + 1, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    same = {g for g in range(60) if 100 * len(sets[2 * g] & sets[2 * g + 1]) >= 80 * len(sets[2 * g] | sets[2 * g + 1])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, slack=1.0).collect()}
    assert same and got == {i: i - 1 if i % 2 and i // 2 in same else i for i, _ in rows}


def test_dropping_keeps_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 1, 2), (1, text, "a", 1, 2), (1, text + " more", "b", 1, 2), (2, "other words stand here", "c", 1, 2)], "doc_id long, text string, __vertex string, __of int, __unlike int")
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["__vertex"] for r in left.collect()} <= {"a", "b", "c"} and left.count() == 2


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, small):
    """Every stage keeps the columns, whatever their names, and takes nulls, empty texts and repeated rows."""
    import corpus_pipeline as cp

    docs = odd.withColumns({"n_chars": F.lit(7), "__later": F.lit(1), "__of": F.lit(2)})
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        kept[name] = [r.doc_id for r in out.collect()]
        assert stage(spark, docs.limit(0), small).count() == 0
    assert 2 not in kept["language ID"] and 9 not in kept["language ID"] and kept["language ID"].count(1) == 2
    assert kept["MinHash near-dedup"].count(1) == 1 and {None, 2, 3, 4} <= set(kept["MinHash near-dedup"])
    assert len(kept["substring dedup"]) == docs.count() == len(kept["benchmark decontamination"])
    assert cp.STAGES[-1][1](spark, docs, small).count() >= docs.count() and cp.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
