import itertools
import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerline.llm import chat, langid, quality, toxicity

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


def texts(alphabet, n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randrange(20, 200))) for _ in range(n)]


def slow_bits(grams, text, depth=langid.DEPTH):
    """Code length of a text by the definition, from one language's texts."""
    counts = {}
    for t in grams:
        b = bytes(depth) + t.encode()
        for i in range(depth, len(b)):
            for k in range(depth + 1):
                after = counts.setdefault(b[i - k : i], {})
                after[b[i]] = after.get(b[i], 0) + 1

    def p(context, byte):
        below = (lambda x: 1 / 256) if not context else (lambda x: p(context[1:], x))
        after = counts.get(context)
        if not after:
            return below(byte)
        total = sum(after.values()) + len(after)
        if byte in after:
            return after[byte] / total
        return len(after) / total * below(byte) / (1 - sum(below(x) for x in after))

    b = bytes(depth) + text.encode()
    return -sum(np.log2(p(b[i - depth : i], b[i])) for i in range(depth, len(b)))


def test_code_lengths_equal_the_definition(spark):
    train = {"x": texts("abc ", 6, 1), "y": texts("cdé ", 6, 2)}
    df = spark.createDataFrame([(i, t, lang) for lang, ts in train.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string")
    model = langid.train(df)
    probe = ["abca dé", "q", "", "ab" * 50]
    bits, sizes = langid.code_lengths(model, probe)
    for k, lang in enumerate(model.languages):
        assert np.allclose(bits[:, k], [slow_bits(train[lang], t) for t in probe], rtol=1e-5)
    assert sizes.tolist() == [len(t.encode()) for t in probe]


def test_every_distribution_sums_to_one(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts("abcdef ", 20, 3))], "doc_id long, text string, lang string")
    m = langid.train(df)
    heads = [0, *(int.from_bytes(x, "big") for x in (b"abc", b"a b", b"zzz", b"zab", b"f", b"   "))]
    grams = np.array([h << 8 | c for h in heads for c in range(256)])
    assert np.allclose(langid._chances(m.orders[0], grams).reshape(-1, 256).sum(axis=1), 1)


def test_fifty_languages_take_memory_by_their_samples(spark):
    """Each language has letters of its own; none loses nodes to others, and a repeated text keeps its rate."""
    rows = [(50 * k + i, "".join(random.Random(50 * k + i).choices([chr(0x4E00 + 40 * k + j) for j in range(20)], k=40)), f"l{k:02}") for k in range(50) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df)
    got = langid.predict(df, m).filter("lang_pred = lang").count()
    assert len(m.languages) == 50 and got == 200
    assert sum(o.grams.nbytes + o.chance.nbytes + o.nodes.nbytes + o.escape.nbytes for orders in m.orders for o in orders) < 50 * 4 * 120 * 4 * 32
    short = spark.createDataFrame([(1, "ж я"), (2, "ж я " * 500), (3, rows[0][1][:3]), (4, rows[0][1] * 50)], "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_identified(short, m).collect()) == [3, 4]


def test_language_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for lang, a in (("x", "abc "), ("y", "def ")) for i, t in enumerate(texts(a, 30, 4))], "doc_id long, text string, lang string")
    m = langid.train(train)
    df = spark.createDataFrame([(1, "abca bcab"), (2, None), (3, "12 !"), (4, ""), (5, "fed " * 30_000), (5, "fed " * 30_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(df, m).collect())
    assert got == [(1, "x"), (2, "und"), (3, "und"), (4, "und"), (5, "y"), (5, "y")]
    kept = langid.keep_identified(df.unionByName(spark.createDataFrame([(7, "ж" * 99)], df.schema)), m)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5] and kept.columns == df.columns
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), m).count() == 0


def test_quality_learns_and_handles_odd_texts(spark):
    r = random.Random(6)
    good = [" ".join(r.choices([f"w{i}" for i in range(40)], k=40)) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in t.split()) for t in good[:30]] + [" ".join([t.split()[0]] * 40) for t in good[30:]]
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.train(df)
    new = spark.createDataFrame([(1, "w90 w91 w92 w93 w94 w95 w96 w97"), (2, "v%%% u%%% z%%% y%%%"), (3, None), (4, ""), (5, "same " * 40_000), (5, "same " * 40_000)], "doc_id long, text string")
    s = {x.doc_id: x.score for x in quality.score(new, m).collect()}
    assert s[1] > 0.5 > s[2] and s[5] < 0.3 and s[3] == s[4] and all(0 <= v <= 1 for v in s.values())
    assert quality.score(new.limit(0), m).count() == 0
    alone = quality.train(df.filter("quality = 1"))
    assert all(x.score > 0.99 for x in quality.score(new, alone).collect())
    assert quality.train(df.limit(0)).score(quality.features("x")) == 0.5


def test_dual_descent_reaches_the_optimum(monkeypatch):
    """The hinge loss is within a thousandth of a lower bound from the dual, solved by projected gradients."""
    monkeypatch.setattr(quality, "EPOCHS", 400)
    r = np.random.default_rng(1)
    vectors = [np.unique(r.integers(0, 30, 6)).astype(np.int32) for _ in range(60)]
    labels = np.array([int((v < 15).mean() + r.normal(0, 0.2) > 0.5) for v in vectors])
    m = quality.fit(vectors, labels)
    y = np.where(labels == 1, 1.0, -1.0)
    cost = quality.COST * np.where(y > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    counts = [np.full(quality.N_FEATURES, quality.SMOOTHING) for _ in range(2)]
    for v, k in zip(vectors, labels, strict=True):
        counts[k][v] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((60, 31))
    for i, v in enumerate(vectors):
        x[i, v] = ratio[v] / np.sqrt((ratio[v] ** 2).sum())
    x[:, 30] = 1.0
    w = np.append(np.where(ratio[:30] != 0, m.weights[:30] / np.where(ratio[:30] != 0, ratio[:30], 1), 0), m.bias)
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha = np.zeros(60)
    top = np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / top, 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert dual <= primal + 1e-6
    assert primal - dual < 1e-3 * primal


def kinds(words):
    table = {"o": toxicity.OTHER, "i": toxicity.INSULT, "t": toxicity.THREAT, "y": toxicity.TARGET, "n": toxicity.NEGATION, "r": toxicity.REPORT}
    state, out = 0, []
    for w in words:
        state, weight = toxicity.MACHINE[state, table[w]]
        out.append(weight)
    return out


def by_rule(words):
    out = []
    for k, w in enumerate(words):
        reported = "r" in words[:k]
        negated = "n" in words[max(0, k - 3) : k]
        aimed = "y" in words[max(0, k - 4) : k]
        base = {"i": 1.5 if aimed else 1.0, "t": 1.0 if aimed else 0.0}.get(w)
        out.append(0.0 if base is None else 0.25 if reported else 0.1 if negated else base)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_grammar_equals_its_rules(n):
    for words in itertools.product("oityNr".lower(), repeat=n):
        assert kinds(words) == by_rule(words), words


def test_clauses_and_stems():
    lex = toxicity.Lexicon({"idiot": 2.0})
    assert toxicity.clause_weights("You are an IDIOT. He said idiots! Fine", lex) == ([3.0, 0.5], 8)
    assert toxicity.clause_weights("not an idiot", lex)[0] == [pytest.approx(0.2)]
    assert toxicity.clause_weights(None, lex) == ([], 0)


def test_toxicity_learns_stems(spark):
    r = random.Random(7)
    clean = lambda: [r.choice([f"word{i}" for i in range(60)]) for _ in range(30)]
    rows = [(i, " ".join(clean()), 0) for i in range(80)]
    for i in range(80, 140):
        w = clean()
        for _ in range(4):
            w[r.randrange(30)] = "grub" + r.choice(["a", "en", "ix", "", "os"])
        rows.append((i, " ".join(w), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df)
    assert any("grub".startswith(s) or s.startswith("grub") for s in m.stems)
    new = spark.createDataFrame([(1, "word1 grubzz grubix word2 grub word3"), (2, "word1 word2"), (3, None), (4, ""), (5, "word9 " * 30_000), (5, "word9 " * 30_000)], "doc_id long, text string")
    s = {x.doc_id: x.score for x in toxicity.score(new, m).collect()}
    assert s[1] > 0.7 and max(s[k] for k in (2, 3, 4, 5)) < 0.3
    assert toxicity.score(new.limit(0), m).count() == 0
    assert toxicity.train(df.filter("toxic = 0")).stems == {} and toxicity.train(df.limit(0)).stems == {}


def best_path(lines, model):
    start, step, emit = model.tables()
    seen = [emit[chat.marker(x)[0], chat.line_kind(x)] for x in lines]

    def score(path):
        return start[path[0]] + seen[0][path[0]] + sum(step[a][b] + e[b] for a, b, e in zip(path, path[1:], seen[1:], strict=False))

    return max(score(p) for p in itertools.product(range(6), repeat=len(lines))), score


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_all_paths(seed):
    r = random.Random(seed)
    lines = [r.choice(["User: hi", "Assistant: yes", "what?", "- item", "", "A: no", "x" * 250, "System: be"]) for _ in range(5)]
    d = chat.Decoder(chat.SpeakerModel())
    found = [x for line in lines for x in d.push(line)] + list(d.close())
    best, score = best_path(lines, chat.SpeakerModel())
    assert [x for x, _ in found] == lines and abs(score([s for _, s in found]) - best) < 1e-9


def test_online_decoding_hands_on_early_and_agrees():
    lines = [("User: q?" if k % 7 == 0 else "Assistant: a" if k % 7 == 1 else "more text") for k in range(700)]
    d = chat.Decoder(chat.SpeakerModel())
    out, most = [], 0
    for x in lines:
        out += d.push(x)
        most = max(most, len(d.lines))
    out += d.close()
    assert [x for x, _ in out] == lines and most < 200
    assert len(list(chat.turns(out))) == 200


@pytest.mark.parametrize("style", range(len(chat.STYLES)))
def test_transcripts_come_back(style):
    given = [("system", "Be brief."), ("user", "What is it?\nSay more."), ("assistant", "- one\n- two"), ("user", "Ok")]
    text = "\n".join(chat.mark(r, style) + t for r, t in given)
    assert chat.parse(text) == given


def test_transcripts_without_turns(spark):
    assert chat.parse(None) == [] and chat.parse("") == []
    df = spark.createDataFrame([(1, "User: hi\nBot: yo"), (2, None), (3, "")], "id int, transcript string")
    got = {r.id: r.rendered for r in chat.format_transcripts(df).collect()}
    assert got == {1: "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n", 2: "", 3: ""}
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.n_given for r in chat.reformat_conversations(conv).collect()}
    assert out == {1: 2, None: 1, 2: 2} and chat.reformat_conversations(conv.limit(0)).count() == 0


def test_fitted_speakers_equal_plain_counts(spark):
    rows = [(1, 0, "user", "why?\nuser: x"), (1, 1, "assistant", "- a\n- b\n"), (1, 2, "user", "ok"), (2, 0, "system", "be brief"), (2, 1, "user", "q: what?"), (None, 0, "user", "x"), (3, 0, None, "x"), (3, 1, "other", "y"), (1, 1, "assistant", None)]
    m = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), marked=0.5)
    assert m.follow[""] == pytest.approx((2 / 5, 2 / 5, 1 / 5)) and m.follow["user"] == pytest.approx((1 / 5, 1 / 5, 3 / 5)) and m.follow["system"] == pytest.approx((1 / 4, 2 / 4, 1 / 4))
    assert m.stay == pytest.approx(4 / 11) and m.later_marker == pytest.approx(2 / 5 / 3) and m.false_marker == pytest.approx(0.5 * 2 / 8 / 2)
    assert m.first_kinds["user"] == pytest.approx((3 / 8, 1 / 8, 1 / 8, 2 / 8, 1 / 8)) and m.kinds["assistant"] == pytest.approx((1 / 7, 2 / 7, 1 / 7, 1 / 7, 2 / 7))
    empty = chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert all(sum(w) == pytest.approx(1) for w in (*empty.follow.values(), *empty.kinds.values())) and chat.parse("User: hi\nBot: yo", empty) == [("user", "hi"), ("assistant", "yo")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="sample tables are not here")
def test_fitted_speakers_tell_unmarked_turns_of_held_out_conversations(spark):
    from ledgerline.llm.common import id_bucket

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held_out = turns.filter(id_bucket("conv_id", 5) == 0)
    share = {}
    for name, model in (("fitted", chat.fit(turns.filter(id_bucket("conv_id", 5) != 0), marked=0.75)), ("given", chat.SpeakerModel(own_marker=0.75))):
        r = chat.reformat_conversations(held_out, model=model, bare=4).agg({"lines_agreed": "sum", "n_lines": "sum"}).first()
        share[name] = r["sum(lines_agreed)"] / r["sum(n_lines)"]
    assert share["fitted"] > share["given"] and share["fitted"] > 0.8, share
    whole = chat.reformat_conversations(held_out, model=chat.SpeakerModel()).filter("lines_agreed <> n_lines OR agreed <> n_given").count()
    assert whole == 0


@here
def test_queries_have_their_columns(spark):
    q = entry.queries()
    want = {
        "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2": "page_id host path rule verdict",
        "op3": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4": "doc_id", "op5": "doc_id held_out score predicted", "op6": "conv_id",
        "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "doc_id n_shingles component_id kept", "op10": "doc_id held_out score predicted",
        "op11": "lang rank phrase a l r n score", "op12": "doc_id piece start length ids_crc32 sequence_id offset", "op13": "doc_id n_features weight score rank",
    }
    for n, columns in want.items():
        (name,) = [x for x in q if x.split("_")[0] == n]
        df = q[name](spark, SF)
        assert set(columns.split()) <= set(df.columns), name


@here
def test_held_out_accuracy(spark):
    q = entry.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = q["op7_language_id"](spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.95


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    for v in np.unique(scores):  # ties share their mean rank
        ranks[scores == v] = ranks[scores == v].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="sample tables are not here")
@pytest.mark.parametrize("name, label, least, accuracy", [("op5_quality_classifier", "quality", 0.99, 0.97), ("op10_toxicity", "toxic", 0.93, 0.9)])
def test_held_out_labels(spark, name, label, least, accuracy):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).dropna()
    got = entry.queries()[name](spark, sf).filter("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    assert len(got) > 500 and set(got[label]) == {0, 1}
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) > least
    assert (got["predicted"] == got[label]).mean() > accuracy


@here
def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage against the plain rule on its own input."""
    import corpus_pipeline as p
    from ledgerline.llm import decontam, minhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = dict(p.STAGES)["line_dedup"](spark, docs, SF)
    from tests.llm.test_near_duplicates import groups, lines_left

    plain = {i: t for i, t in lines_left([(r.doc_id, r.text) for r in docs.collect()]) if t and t.strip(" ")}
    assert {r.doc_id: r.text for r in after.collect()} == plain and after.columns == docs.columns
    kept = {r.doc_id for r in dict(p.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in groups([(r.doc_id, r.text) for r in docs.collect()], 80).items() if i == c}
    clean = {r.doc_id: r.text for r in dict(p.STAGES)["decontaminate"](spark, docs, SF).collect()}
    items = [(str(r.item_id), decontam.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = decontam.ItemAutomaton(items)
    for r in docs.collect():
        spans = automaton.scan(decontam.words(r.text))[0]
        n = sum(b - a for a, b in spans)
        if n <= p.MAX_COVERAGE * len(decontam.words(r.text)):
            assert clean[r.doc_id] == (decontam.without(r.text, spans) if spans else r.text)
        else:
            assert r.doc_id not in clean
    assert minhash.SHINGLE == 5


@here
def test_pipeline_runs(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
