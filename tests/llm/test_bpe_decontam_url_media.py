import hashlib
import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import bpe, decontam, media, urlfilter

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def model():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        return bpe.load_model(f.read())


PARTS = ["a", "b", " ", "  ", "e", "th", "the", "in", "ing", "\n", "\t", "é", "日本", "🙂", "12", "3", "'s", "'re", "!", "?!", "<|endoftext|>", "<|end", "\u00a0", "aaaa", "--", "=", "\x00", "\r\n", "½", "\u0301", "\x1c", "\u3000"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_bpe_equals_the_library(library, model, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert model.encode(text) == ids
    assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_one_very_long_piece(library, model):
    text = "".join(random.Random(5).choice("abcdeinth") for _ in range(20_000))
    assert model.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_and_stays_right(library, model, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    texts = [f"word{i} other{i}" for i in range(30)]
    assert [model.encode(t) for t in texts] == [library.encode(t).ids for t in texts]


def test_bpe_columns(spark, library):
    rows = [(1, "the quick fox", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "日本 <|endoftext|>", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = bpe.decode_ids(bpe.encode_texts(df)).collect()
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == want and r.decoded == (r.text or "") and hasattr(r, "other")
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(i, len(library.encode(t or "").ids), sha(",".join(map(str, library.encode(t or "").ids))), sha(t or "")) for i, t, _ in rows}
    assert bpe.encode_digest(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_digest(df.withColumnRenamed("other", "n_tokens"))


# Decontamination


def brute(doc, items, window=10):
    hit, found = set(), set()
    for name, seq in items:
        n = min(window, len(seq))
        for i in range(len(seq) - n + 1) if n else ():
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == seq[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(name)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=9), max_size=4),
    st.lists(st.sampled_from(["a", "b", "c", "x"]), max_size=40),
    st.integers(1, 5),
)
def test_automaton_equals_brute_force(items, doc, window):
    named = [(str(k), [w.encode() for w in x]) for k, x in enumerate(items)]
    seq = [w.encode() for w in doc]
    spans, found = decontam.ItemAutomaton(named, window).scan(seq)
    hit, want = brute(seq, named, window)
    assert {i for a, b in decontam.merge_spans(spans) for i in range(a, b)} == hit
    assert sum(b - a for a, b in spans) == len(hit) and found == want


def test_words_and_cutting():
    assert decontam.words("Éa B_c-9 naïve\u00a0x") == ["Éa".encode(), b"b", b"c", b"9", "naïve\u00a0x".encode()]
    assert decontam.words(None) == []
    assert decontam.without("A, b c; d e.", [(1, 3)]) == "A, ; d e."
    assert decontam.without("a b", [(0, 2)]) == ""


@pytest.mark.parametrize("max_words", [decontam.MAX_WORDS, 12])
def test_contaminated_documents(spark, max_words):
    long = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(2, long), (10, "Short One"), (10, "short one"), (3, None), (None, "zz"), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {long.upper()}! y", "k"), (2, "a short, one b", "k"), (3, None, None), (4, "", None), (5, "zz " + "clean " * 5000, None), (6, "w0 w1 w2 w3", None), (6, "w0 w1 w2 w3", None)], "doc_id long, text string, item_id string")
    out = decontam.find_contamination(docs, items, max_words=max_words, cleaned=True, max_coverage=0.6).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items), r.covered) for r in out}
    assert got == {1: (16, 14, ["2"], True), 2: (4, 2, ["10"], False), 3: (0, 0, [], False), 4: (0, 0, [], False), 5: (5001, 0, [], False), 6: (4, 0, [], False)}
    assert {r.doc_id: r.text for r in out}[1] == "x ! y" and len(out) == 7
    assert decontam.find_contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.find_contamination(docs.limit(0), items).count() == 0


# URLs

RULES = [urlfilter.Rule("allow", "com", "/"), urlfilter.Rule("block", "example.com", "/en/"), urlfilter.Rule("allow", "www.example.com", "/en/"), urlfilter.Rule("block", "net", "/es/"), urlfilter.Rule("block", "a.net", "/es/de"), urlfilter.Rule("allow", "org", "")]


def plain(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["com", "net", "org", "example", "www", "a", "", "."]), min_size=1, max_size=4).map(".".join), st.lists(st.sampled_from(["/", "en", "es", "de", "x"]), max_size=6).map("".join))
def test_trie_equals_all_rules(host, path):
    assert urlfilter.UrlTrie(RULES).match(host, path) == plain(host, path)


@pytest.mark.parametrize("url, host, path", [("http://A.com/x?y#z", "a.com", "/x"), ("HTTPS://a.com", "a.com", ""), ("no scheme", "", ""), (None, "", ""), ("x://h?q", "h", ""), ("a://b://c/d", "b:", "//c/d"), ("", "", ""), ("://", "", "")])
def test_split(url, host, path):
    assert urlfilter.split_url(url) == (host, path)


def test_url_rows(spark):
    df = spark.createDataFrame([(1, "http://m.example.com/en/1"), (2, "http://www.example.com/en/1"), (3, None), (4, "http://x.net/es/" + "a" * 100_000), (4, "http://x.net/es/"), (5, "http://b.com/")], "page_id long, url string")
    for most in (urlfilter.MAX_RULES, 2):
        got = sorted(((r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(df, RULES, max_rules=most).collect()), key=str)
        assert got == sorted([(1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, None, "allow"), (4, "net/es/", "block"), (4, "net/es/", "block"), (5, "com/", "allow")], key=str)
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df.withColumnRenamed("page_id", "rule"), RULES)
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, [*RULES, urlfilter.Rule("block", "com", "/")])


# Media


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 16, 576 * 16 + 1, 576 * 40])
def test_payload_comes_back(size):
    raw = random.Random(size).randbytes(size)
    payload = media.pad(raw)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(raw) and set(payload[size:]) <= {255}
    file = media.store_payload(payload)
    index = media.parse(file)
    assert b"".join(file[o : o + s] for o, s in index.key_ranges) == payload
    assert (index.codec, index.handler, index.n_samples, index.duration_s) == ("raw ", "soun", len(payload) // 576, len(payload) / 8000)


def boxed(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, fmt, *values):
    return boxed(kind, bytes(4), struct.pack(">" + fmt, *values))


def movie(stss=(1, 3), offsets=(100, 200), chunk_runs=((1, 2, 1),), sizes=(10, 20, 30, 40)):
    """A video track of four samples of different sizes in two chunks, with a 64-bit box size."""
    tables = [
        boxed(b"stsd", bytes(4), struct.pack(">I", 1), boxed(b"avc1", bytes(78))), full(b"stts", "IIIII", 2, 3, 100, 1, 50),
        full(b"stsc", "I" + "III" * len(chunk_runs), len(chunk_runs), *(x for r in chunk_runs for x in r)),
        full(b"stsz", "II" + "I" * len(sizes), 0, len(sizes), *sizes), full(b"co64", "I" + "Q" * len(offsets), len(offsets), *offsets),
    ]
    if stss is not None:
        tables.append(full(b"stss", "I" + "I" * len(stss), len(stss), *stss))
    mdia = boxed(b"mdia", boxed(b"mdhd", b"\1" + bytes(3), struct.pack(">QQIQ", 0, 0, 1000, 0), bytes(4)), boxed(b"hdlr", bytes(8), b"vide", bytes(13)), boxed(b"minf", boxed(b"stbl", *tables)))
    data = bytes(600)
    return struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) + data + boxed(b"moov", boxed(b"trak", mdia))


def test_keyframes_by_sample_tables():
    m = media.parse(movie())
    assert (m.codec, m.handler, m.n_samples, m.n_sync, m.duration_s) == ("avc1", "vide", 4, 2, 0.35)
    assert m.key_ranges == ((100, 10), (200, 30))
    assert media.parse(movie(stss=None)).key_ranges == ((100, 30), (200, 70))
    assert media.parse(movie(chunk_runs=((1, 1, 1), (2, 3, 1)))).key_ranges == ((100, 10), (220, 30))


def test_bad_files_give_errors_not_exceptions(spark):
    good = movie()
    rows = [(1, good), (2, None), (3, b""), (4, good[:-30]), (5, b"garbage!" * 9), (6, movie(offsets=(100, 10**9)))]
    out = {r.id: r for r in media.index_media(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert out[1].codec == "avc1" and out[1].error is None and out[1].key_ranges[1].offset == 200
    assert out[2].codec is None and out[2].error is None
    assert all(out[k].error and out[k].codec is None for k in (3, 4, 5))
    assert out[6].error


def test_media_digest(spark):
    df = spark.createDataFrame([(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (5, "x" * 200_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in media.text_media_digest(df).collect()}
    assert out[1].n_bytes == 6 and out[1].payload_bytes == 576 and out[1].payload_sha256 == hashlib.sha256(media.pad("héllo".encode())).hexdigest()
    assert tuple(out[1])[1:] == tuple(out[4])[1:] and tuple(out[2])[1:] == tuple(out[3])[1:]
    assert out[5].payload_bytes == -(-200_000 // 576) * 576 and json.dumps(out[5].feature)
