import random

import pytest

from ledgerline.llm import linededup, minhash
from ledgerline.llm.common import drop_materialized, free_name, materialize

WORDS = [f"w{i}" for i in range(300)]


def corpus(seed=1):
    """Texts in families of copies, near copies and chains, with nulls, blanks and one long text."""
    r = random.Random(seed)
    out = []
    for _ in range(12):
        base = r.choices(WORDS, k=r.randrange(20, 120))
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            if r.random() < 0.3:
                base = copy  # a chain
            text = " ".join(copy)
            out.append(text.upper() if r.random() < 0.2 else text.replace(" ", "\n", 3))
    out += ["", None, "  \t\n", "one", "One", "one two", "a b c d", "a b c d e", " ".join(r.choices(WORDS, k=9000))]
    r.shuffle(out)
    return list(enumerate(out, 100))


def groups(rows, percent):
    sets = {i: minhash.shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 80)])
def test_groups_equal_brute_force(spark, seed, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()}
    want = groups(rows, percent)
    assert got == want and any(len([1 for v in want.values() if v[1] == c]) > 2 for _, c in want.values())


def test_kept_nulls_repeats_and_empty_tables(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([(5, text), (3, text), (3, text), (None, text), (9, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (8, 8, True), (9, 9, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_hashes_stand_for_shingles():
    for _, t in corpus(3):
        assert len(minhash.shingle_hashes(t)) == len(minhash.shingle_set(t))


def test_parity_bits_never_exceed_the_difference():
    r = random.Random(4)
    for _ in range(50):
        a = minhash.shingle_hashes(" ".join(r.choices(WORDS, k=200)))
        b = minhash.shingle_hashes(" ".join(r.choices(WORDS, k=r.randrange(1, 200))))
        bits = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view("uint64"))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_estimate_is_near_the_similarity(spark):
    r = random.Random(5)
    base = r.choices(WORDS, k=400)
    rows = []
    for k in range(12):
        other = list(base)
        for i in r.sample(range(400), 2 * k):
            other[i] = "zz"
        x, y = (minhash.shingle_hashes(" ".join(t)) for t in (base, other))
        exact = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
        rows.append((exact, *([int(v) for v in minhash.signature(minhash.minima(h))[1]] for h in (x, y))))
    df = spark.createDataFrame(rows, "s double, a array<bigint>, b array<bigint>").select("s", minhash.estimate("a", "b").alias("e"))
    assert all(abs(x.s - x.e) < 0.25 for x in df.collect()) and df.filter("s = 1").first().e == 1.0


@pytest.mark.parametrize("links, want", [([], {}), ([(1, 2), (2, 3), (5, 4), (9, 9)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(0, i) for i in range(1, 60)] + [(70, 59)], {**{i: 0 for i in range(60)}, 70: 0})])
def test_components(spark, links, want):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in minhash.components(df).collect()} == want


def lines_left(rows, percent=80, least=1):
    """Texts after the removal of every line that is similar to an earlier one."""
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out.append((i, None))
            continue
        left = []
        for line in t.split("\n"):
            s = {w for w in line.lower().replace("\t", " ").split(" ") if w}
            if len(s) >= least:
                gone = any(100 * len(s & o) >= percent * len(s | o) for o in seen)
                seen.append(s)
                if gone:
                    continue
            left.append(line)
        out.append((i, "\n".join(left)))
    return out


@pytest.mark.parametrize("seed, least, long_", [(1, 1, 256), (2, 5, 256), (1, 1, 10)])
def test_lines_equal_brute_force(spark, monkeypatch, seed, least, long_):
    monkeypatch.setattr(linededup, "LONG", long_)
    r = random.Random(seed)
    pool = [r.choices(WORDS[:80], k=r.randrange(3, 30)) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                line[r.randrange(len(line))] = r.choice(WORDS)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "The.\nThe."), (204, "long " * 3 + " ".join(WORDS))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, doc int, line_no string")
    out = linededup.dedup_lines(df, min_words=least)
    assert out.columns == df.columns
    assert sorted((x.doc_id, x.text) for x in out.collect()) == sorted(lines_left(rows, least=least), key=lambda x: x[0])


def test_lines_of_repeated_rows_null_ids_and_empty_tables(spark):
    line = " ".join(WORDS[:8])
    df = spark.createDataFrame([(None, line), (4, line), (4, line), (7, line + "\nshort")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, list(r.removed_lines), list(r.matched_docs)) for r in linededup.dedup_lines(df, details=True).collect()), key=str)
    first = None
    assert got == sorted([(None, line, 1, 0, [], []), (4, "", 1, 1, [0], [first]), (4, "", 1, 1, [0], [first]), (7, "short", 2, 1, [0], [first])], key=str)
    assert linededup.dedup_lines(df.limit(0), details=True).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(df.selectExpr("*", "1 AS n_lines"), details=True)


def test_a_family_of_near_copies(spark):
    r = random.Random(9)
    base = WORDS[:20]
    rows = [(i, " ".join(w if r.random() > 0.05 else r.choice(WORDS) for w in base)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in linededup.dedup_lines(df).collect()) == lines_left(rows)


def long_lines(seed, sizes):
    """Lines of frequent words around the sizes at which keys change, with up to a quarter of each replaced."""
    r = random.Random(seed)
    many = [f"f{i}" for i in range(1200)]
    rows = []
    for n in sizes:
        base = r.sample(many, n)
        for share in (0, 0.02, 0.09, 0.1, 0.11, 0.12, 0.25):
            line = list(base)
            for k in r.sample(range(n), int(share * n)):
                line[k] = r.choice(many)
            rows.append(line[: n - r.choice([0, 0, n // 9])])
    r.shuffle(rows)
    return [(i, " ".join(line)) for i, line in enumerate(rows)]


@pytest.mark.parametrize("rounds", [4, 0])
def test_long_lines_of_frequent_words(spark, monkeypatch, rounds):
    monkeypatch.setattr(linededup, "FREQUENT", 2)
    monkeypatch.setattr(linededup, "ROUNDS", rounds)
    rows = long_lines(11, [190, 230, 250, 256, 270, 300, 400, 900])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((x.doc_id, x.text) for x in linededup.dedup_lines(df).collect()) == lines_left(rows)


def test_keys_are_linear_in_a_lines_words(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FREQUENT", 1)
    words = [f"w{i}" for i in range(20_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:19_000] + ["x"])), (2, " ".join(words[:4_000])), (3, " ".join(words[:3_900]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x.doc_id, x.text) for x in linededup.dedup_lines(df).orderBy("doc_id").collect()] == lines_left(rows)
    plain = df.select(linededup.F.struct("doc_id").alias("doc"), linededup.F.xxhash64("text").alias("hash"), "text")
    made = linededup._sketches(plain, 80).select(linededup.F.xxhash64("d1", "d2").alias("id"), linededup.F.lit(0).alias("ord"), "n", "prefix", "whole", "q0", "q1")
    counts = {r["id"]: (r["n"], r["count"]) for r in linededup._keyed(made, 80).groupBy("id").count().join(made.select("id", "n"), "id").collect()}
    assert len(counts) == 4 and all(0 < c < n for n, c in counts.values())


def test_materialize_and_names(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and free_name(df, "ID") == "ID_"
    drop_materialized(df)
    with pytest.raises(Exception):
        df.count()


@pytest.mark.parametrize("family", [1, 6, 32])
def test_only_large_families_are_led(spark, monkeypatch, family):
    """Key rows are narrow, small families go to the join unled, and all sizes give the same result."""
    monkeypatch.setattr(linededup, "FAMILY", family)
    r = random.Random(5)
    rows = []
    for size in (2, 3, 12):
        base = [f"w{size}x{k}" for k in range(20)]
        rows += [" ".join([*base, f"own{size}x{i}"]) for i in range(size)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in linededup.dedup_lines(df).collect()) == lines_left(rows)
    plain = df.select(linededup.F.struct("doc_id").alias("doc"), linededup.F.xxhash64("text").alias("hash"), "text")
    made = linededup._sketches(plain, 80).select(linededup.F.xxhash64("d1", "d2").alias("id"), linededup.F.struct("doc").alias("at"), linededup.F.lit(0).alias("ord"), "n", "prefix", "whole", "q0", "q1")
    assert linededup._keyed(made, 80).columns == ["key", "id", "ord", "np", "q0", "q1"]
    led = linededup._families(made)
    assert (led is None) == (family == 32)
    if led is not None:
        assert led.groupBy("key").count().filter(linededup.F.col("count") <= family).isEmpty()
        drop_materialized(led)
