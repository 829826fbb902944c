"""Cases in which an operator of this subpackage did less than its whole job."""

import random

import pytest

import corpus_pipeline
from ledgerline.llm import decontam, linededup, media, queries, toxicity

from .test_bpe_decontam_url_media import boxed, movie
from .test_near_duplicates import lines_left


@pytest.mark.parametrize("max_words", [decontam.MAX_WORDS, 3])
def test_a_window_over_several_spans_counts_each_word_once(spark, max_words):
    text = "a b c d a e f g h i"
    items = spark.createDataFrame([("1", "a"), ("2", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, text), (2, text + " z")], "doc_id long, text string")
    out = decontam.find_contamination(docs, items, max_words=max_words, cleaned=True, max_coverage=0.95)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items), r.covered, r.text.strip()) for r in out.collect()}
    assert got == {1: (10, 10, ["1", "2"], True, ""), 2: (11, 10, ["1", "2"], False, "z")}


@pytest.mark.parametrize("max_words", [25, 40, 10**6])
def test_blocks_of_the_benchmark_change_nothing(spark, max_words):
    r = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    long_ = [words[i % 200] for i in range(100)]
    items = [(f"i{k}", " ".join(r.choices(words, k=r.randrange(1, 40)))) for k in range(20)] + [("long", " ".join(long_)), ("none", None)]
    rows = [(k, " ".join(["x", *r.choice(items[:20])[1].split(" ")[:25], "y", *r.choices(words, k=9)])) for k in range(30)] + [(90, "a " + " ".join(long_) + " b"), (91, None), (90, "a " + " ".join(long_) + " b")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, spans string")
    got = decontam.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), max_words=max_words, cleaned=True)
    whole = decontam.ItemAutomaton([(i, decontam.words(t)) for i, t in items])
    want = []
    for i, t in rows:
        spans, found = whole.scan(decontam.words(t))
        spans = decontam.merge_spans(spans)
        want.append((i, "kept", len(decontam.words(t)), sum(b - a for a, b in spans), sorted(found), max((b - a for a, b in spans), default=0)))
    assert sorted(((x.doc_id, x.spans, x.n_words, x.n_hit, x.hit_items, x.longest_span) for x in got.collect()), key=str) == sorted(want, key=str)
    assert [x.longest_span for x in got.filter("doc_id = 90").collect()] == [100, 100]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Documents of lines of one to seven words, of few different words."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(7)]
    rows = [(i, "\n".join(" ".join(r.choices(words, k=r.randrange(8))) for _ in range(r.randrange(1, 6)))) for i in range(80)]
    rows += [(90, "All rights reserved.\n\n"), (91, "all  rights RESERVED.\nla la la la la la\n词词词词"), (92, "la la\n词词词词"), (93, "a b c d"), (94, "a b c d e")]
    folder = tmp_path_factory.mktemp("lines")
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    return rows, df, str(folder)


def test_short_lines_take_part_in_the_query(spark, lines):
    rows, _, folder = lines
    got = {r.doc_id: r.n_removed for r in queries.op4_line_dedup(spark, folder).collect()}
    left = dict(lines_left(rows, least=1))
    kept = {i: len(t.split("\n")) for i, t in rows}
    assert {i: n for i, n in got.items() if i >= 90} == {90: 0, 91: 1, 92: 2, 93: 0, 94: 1}
    assert all((left[i].count("\n") + 1 if kept[i] > got[i] else 0) == kept[i] - got[i] for i in got)


def test_short_lines_take_part_in_the_pipeline(spark, lines):
    rows, df, folder = lines
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, folder).collect()}
    assert got == {i: t for i, t in lines_left(rows, least=1) if t.strip(" ")}


@pytest.mark.parametrize("text, want", [
    ("I will kill you", [1.0]), ("we will destroy them", [1.0]), ("te voy a matar a ti", [1.0]), ("idiot, you", [3.0]), ("you idiot, you", [3.0]),
    ("killing you", [1.0]), ("they destroyed it", [1.0]), ("ich töte dich", [1.0]), ("kill the lights in this room, you", []), ("killer whales, you know", []), ("mathematics and you", []),
    ("I will not kill you", [0.1]), ("it said: kill you", [0.25]), ("kill. you", []),
])
def test_the_object_behind_the_verb_is_a_target(text, want):
    assert toxicity.clause_weights(text, toxicity.Lexicon({"idiot": 2.0}))[0] == pytest.approx(want)


def test_the_video_track_is_indexed_though_sound_comes_first():
    video = movie()
    mdat, moov = video[: 16 + 600], video[16 + 600 :]
    trak = moov[8:]
    sound = trak.replace(b"vide", b"soun").replace(b"avc1", b"mp4a")
    m = media.parse(mdat + boxed(b"moov", sound, trak))
    assert (m.handler, m.codec, m.key_ranges) == ("vide", "avc1", ((100, 10), (200, 30)))
    assert media.parse(mdat + boxed(b"moov", sound)).handler == "soun"


@pytest.mark.parametrize("parts", [(b"", boxed(b"moof")), (boxed(b"mvex"), b"")])
def test_fragmented_files_are_errors(parts):
    video = movie()
    mdat, trak = video[: 16 + 600], video[16 + 600 + 8 :]
    with pytest.raises(ValueError, match="fragmented"):
        media.parse(mdat + boxed(b"moov", trak, parts[0]) + parts[1])


def test_malformed_files_are_errors_in_bounded_time():
    deep = b""
    for _ in range(5000):
        deep = boxed(b"moov", deep)
    video = movie()
    at = video.index(b"stsc")
    no_chunk = video[: at + 12] + (0).to_bytes(4, "big") + video[at + 16 :]
    beyond = video[: at + 12] + (9999).to_bytes(4, "big") + video[at + 16 :]
    for file in (deep, no_chunk, beyond, b"", b"\x00" * 7):
        with pytest.raises(ValueError):
            media.parse(file)


def test_words_that_share_forty_hash_bits_stay_apart(spark):
    df = spark.createDataFrame([(1, "w1293928 red blue green grey"), (2, "w1943887 red blue green grey"), (3, "grey green blue red w1293928")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == {1: "w1293928 red blue green grey", 2: "w1943887 red blue green grey", 3: ""}


def test_string_ids_and_short_repeats(spark):
    df = spark.createDataFrame([("b", "all rights reserved\nx"), ("a", "All Rights  reserved"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == {"a": "All Rights  reserved", "b": "", None: "x"}


def test_stages_set_clashing_columns_aside(spark, tmp_path):
    items = spark.createDataFrame([("1", "one two three")], "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "one two three four five six seven", "en", 9, 8, 7.0), (2, None, "en", 1, 1, 1.0), (3, "\t\t", "en", 1, 1, 1.0)], "doc_id long, text string, lang string, n_words int, n_tokens int, bits_per_byte double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r.n_words for r in out.collect() if r.doc_id == 1} <= {9}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {"n_tokens", "n_tokens_given"} <= set(corpus_pipeline.encode(spark, docs, str(tmp_path)).columns)
