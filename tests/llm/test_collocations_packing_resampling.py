"""The operators over phrases, sequences and draws against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations, packing, resampling

# --- collocations -------------------------------------------------------------------------


def phrases(rows, least, covers, first):
    """The contract, phrase by phrase."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = {}
    for text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        able = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in able.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        found = []
        for g, a in able.items():
            if g in inside and 100 * inside[g] >= covers * a:
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:first], 1):
            out.add((lang, rank, g.decode(), -a, l, r, n, -s))
    return out


def spoken(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "sea", "größe", "词", "x\x1fy", "a b", "é", "ÀB"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]
    rows = [("".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(60))), r.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("one", "fr"), ("of the sea " * 400, "en"), ("of the sea of the sea " * 30, "fr")]


def run_phrases(spark, rows, **how):
    df = spark.createDataFrame([(t, x, "extra", 1) for t, x in rows], "text string, lang string, phrase string, n int").repartition(5)
    return {tuple(r) for r in collocations.collocations(df, **how).collect()}


@pytest.mark.parametrize("how", [{"least": 30, "first": 2000}, {"least": 3, "first": 15}, {"least": 300, "covers": 60, "first": 9}])
def test_collocations_equal_plain_counts(spark, how):
    rows = spoken(1)
    got = run_phrases(spark, rows, **how)
    assert got == phrases(rows, how["least"], how.get("covers", 80), how["first"])
    assert len(got) >= 3


def test_hot_pairs_small_batches_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = spoken(2)
    want = phrases(rows, 5, 80, 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run_phrases(spark, rows, least=5, first=50) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_growth_counts_ranges_that_cross_batches():
    import pyarrow as pa

    rows = sorted((w, x, y, z) for w, x, y, z in itertools.product("ab", "ab", ["", "c", "d"], ["", "e"]) if y or not z)
    for cut in (1, 3, 7, 100):
        parts = [rows[i : i + cut] for i in range(0, len(rows), cut)]
        runs = [[" ".join([*filter(None, r), ""]) for r in p] for p in parts]
        batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * len(p)), pa.array(p), pa.array([2] * len(p)), pa.array([0] * len(p))], names=["lang", "run", "n", "salt"]) for p in runs]
        got = Counter()
        for b in collocations._grow(4)(batches):
            for _, phrase, _, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[phrase] += n
        want = Counter()
        for r in rows:
            for k in range(2, 5):
                if all(r[:k]):
                    want[" ".join(r[:k])] += 2
        assert {g: n for g, n in got.items() if n >= 4} == {g: n for g, n in want.items() if n >= 4}


def test_no_documents_no_phrases(spark):
    assert run_phrases(spark, []) == set()


def test_a_hot_pair_is_dealt_by_what_follows():
    import pyarrow as pa

    class Value:
        def __init__(self, value):
            self.value = value

    texts = ["of the " + f"w{i} v{i}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(texts)], names=["lang_", "text_"])
    words = collocations.Words()
    ids = words.number([b"of the"])
    hot = words.bucket(ids[:1], ids[1:2], "en")
    full = np.full((1 << collocations.BITS) >> 3, 255, np.uint8)
    rows = [r for b in collocations._project(Value(full), Value(hot))([batch]) for r in b.to_pylist()]
    assert len({r["salt"] for r in rows if r["run"].startswith("of the ")}) > 40
    assert {r["salt"] for r in rows if not r["run"].startswith("of the ")} == {0}
    assert sum(r["n"] for r in rows) == 150


# --- packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    from ledgerline.llm.bpe import vocabulary_path

    return tokenizers.Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


ODD = ["", " ", "\n \t", "a", "It's  the SEA", "ΣΑΣ Σ", "é ́a", "<|startoftext|> a<|endoftext|>b", "x" * 3000, "12 345,6.7!?", "İı ǅ ﬁ", "a\x00b ​ c　d", "́", "don'T 'S 's", "<|end oftext|>", "ᄀ ᅡ", "ÀÉ×÷ ÿß", "DON'T'LL <|x", "a\x85b\xa0c", "²³¼ ªº µ", "z" * 100 + " " + "z" * 100]


def test_texts_encode_as_the_library_does(library):
    from ledgerline.llm.bpe import vocabulary_path

    r = random.Random(4)
    signs = "aZéÀß÷×ºµª²́ ̈ΣσßİK'stll,.<|>0१ \n\t  ‍词한가"
    texts = ODD + ["".join(r.choices(signs, k=r.randrange(40))) for _ in range(3000)]
    own = packing.TextEncoder(open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8").read())
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(map(own.encode, texts)) == want


def test_packed_documents(spark, library):
    r = random.Random(5)
    texts = [*ODD, None] + [" ".join(r.choices(["sea", "Größe", "unwritten", "of,"], k=int(1.35 ** r.randrange(26)))) for _ in range(300)] + ["sea of " * 5000] * 2
    rows = [(i // 2 if i > 5 else None, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(5)
    for cell in (packing.CELL, 100):
        got = packing.pack_documents(df, capacity=512, cell=cell).collect()
        want = Counter()
        for i, t, _ in rows:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            for p, at in enumerate(range(0, len(ids), 512)):
                part = np.array(ids[at : at + 512], "<u4")
                want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter(tuple(x[:5]) for x in got) == want
        bins = {}
        for x in got:
            bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 512
        assert len(bins) <= len(packing.best_fit([x.length for x in got], 512)) + (cell == 100)


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for f in sorted({f for f in free if f >= sizes[k]}):
            rest = list(free)
            rest.remove(f)
            place(k + 1, [*rest, f - sizes[k]])
        place(k + 1, [*free, capacity - sizes[k]])

    place(0, [])
    return best


def test_local_search_saves_bins_that_best_fit_needs():
    r = random.Random(6)
    saved = missed = 0
    for _ in range(150):
        sizes = sorted((r.randrange(15, 70) for _ in range(11)), reverse=True)
        start = packing.best_fit(sizes, 100)
        bins = packing.pack_sizes(sizes, 100)
        assert sorted(k for b in bins for k in b) == list(range(11))
        assert all(sum(sizes[k] for k in b) <= 100 for b in bins)
        least = fewest(sizes, 100)
        assert least <= len(bins) <= len(start)
        saved += len(start) - len(bins)
        missed += len(bins) - least
    assert saved >= missed
    assert saved > 0


@pytest.mark.parametrize("sizes, bins", [
    ([4, 4, 2, 7], [[0], [1], [2, 3]]),  # hand one over
    ([6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]]),  # one for one
    ([5, 3, 2, 6, 4], [[0], [1, 2], [3, 4]]),
])
def test_every_step_raises_the_squared_fill(sizes, bins):
    search = packing.Search(sizes, bins, 10)
    before = int((search.fill**2).sum())
    for a in range(len(bins)):
        while search.fill[a] and search._step(a):
            now = int((search.fill**2).sum())
            assert now > before
            assert (search.fill <= 10).all()
            before = now


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- resampling ---------------------------------------------------------------------------


def draws(rows, items, percent, least, seed, buckets):
    def features(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, itertools.pairwise(w))]], len(w)

    s, t = Counter(), Counter()
    for x in rows:
        s.update(features(x[1])[0])
    for x in items:
        t.update(features(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t.total() * 0 + s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        f, n = features(text)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    k = percent * len(able) // 100
    return Counter([(*x[:4], r) for r, x in enumerate(able[:k], 1)] + [(*x[:4], None) for x in [*able[k:], *(x for x in out if not x[4])]])


@pytest.mark.parametrize("percent, least, digit", [(25, 20, 12), (50, 0, 3), (100, 1, 12), (1, 20, 12)])
def test_draws_equal_plain_scores(spark, monkeypatch, percent, least, digit):
    monkeypatch.setattr(resampling, "DIGIT", digit)
    r = random.Random(8)
    words = ["sea", "The", "größe", "词", "of_the", "x1", "~", "a-b"]
    rows = [(i - 40, " ".join(r.choices(words, k=r.randrange(60)))) for i in range(150)]
    rows += [(5, rows[3][1])] * 40 + [(5, rows[4][1])] * 3 + [(None, None), (None, "sea " * 30), (2**62, ""), (-(2**62), "of the " * 5000)]
    items = ["the sea of größe", None, "", "sea sea"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(6)
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in items], "text string"), percent=percent, min_words=least, buckets=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == draws(rows, items, percent, least, 7, 50)


def test_selection_finds_every_place(spark):
    r = random.Random(9)
    keys = [(r.choice([-(2**63), -5, 0, 7, 2**63 - 1]), r.randrange(-3, 3)) for _ in range(60)]
    rows = spark.createDataFrame(keys, "a long, b long").repartition(3).cache()
    for k in (1, 2, 30, 59, 60):
        assert resampling.kth_key(rows, ["a", "b"], k) == sorted(keys)[k - 1]
    assert resampling.kth_key(rows, ["a", "b"], 61) is None


def test_no_target_no_documents_and_drawn_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
    docs = spark.createDataFrame([(i, "word " * 25, i) for i in range(8)], "doc_id int, text string, given int")
    drawn = resampling.draw(docs, none, percent=50)
    assert drawn.columns == docs.columns
    assert drawn.count() == 4
    with pytest.raises(TypeError):
        resampling.resample(docs.withColumn("doc_id", F.col("doc_id").cast("string")), none)
