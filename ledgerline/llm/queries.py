"""The operators of this subpackage applied to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontam, langid, linededup, media, minhash, packing, quality, resampling, toxicity, urlfilter
from .common import id_bucket, table

URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]

#: Of so many turns one has no marker in the transcripts of op6.
BARE = 8


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, URL_RULES).drop("url")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, details=True)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their whole texts, labels with a value); one label row an id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", label).filter(F.col(label).isNotNull())
    return docs, labels.groupBy("doc_id").agg(F.min(label).alias(label))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _labelled(spark, sf_dir, "quality")
    sampled = quality.bounded_sample(labels.filter(id_bucket("doc_id", 5) != 0), "doc_id", "quality", quality.SAMPLE)
    model = quality.train(docs.join(F.broadcast(sampled), "doc_id"))
    scored = quality.score(docs.select("doc_id", "text", (id_bucket("doc_id", 5) == 0).alias("held_out")), model, keep_text=False)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _labelled(spark, sf_dir, "toxic")
    sampled = quality.bounded_sample(labels.filter(id_bucket("doc_id", 3) != 1), "doc_id", "toxicity", toxicity.SAMPLE)
    model = toxicity.train(docs.join(F.broadcast(sampled), "doc_id"))
    scored = toxicity.score(docs.select("doc_id", "text", (id_bucket("doc_id", 3) == 1).alias("held_out")), model, keep_text=False)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    model = chat.fit(turns.filter(id_bucket("conv_id", 5) != 0), marked=1 - 1 / BARE)
    return chat.reformat_conversations(turns, model=model, bare=BARE)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_bucket("doc_id", 5) == 0
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep_text=False)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM parts p JOIN rules r
    ON ('.' || p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""

OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.joined, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line,
         list_sort(list_distinct(list_filter(regexp_split_to_array(lower(parts[i]), '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS t(i)),
classes AS (
  SELECT w, len(w) AS n, min({'d': doc_id, 'l': line_no}) AS place FROM l WHERE len(w) >= 1 GROUP BY w),
near AS (
  SELECT DISTINCT a.place
  FROM classes a JOIN classes b ON b.place < a.place AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  WHERE len(list_intersect(a.w, b.w)) * 180 >= (a.n + b.n) * 80),
gone AS (
  SELECT l.doc_id, l.line_no FROM l JOIN classes c ON l.w = c.w
  WHERE c.place IN (SELECT place FROM near) OR c.place <> {'d': l.doc_id, 'l': l.line_no})
SELECT d.doc_id, CAST(coalesce(max(k.n_lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(max(k.n_removed), 0) AS BIGINT) AS n_removed,
       coalesce(max(k.removed_lines), '') AS removed_lines, sha256(coalesce(max(k.kept), '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
         string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY l.line_no) AS removed_lines,
         string_agg(CASE WHEN g.line_no IS NULL THEN l.line END, chr(10) ORDER BY l.line_no) AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id) k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g
  FROM w, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE f >= 30 AND len(g) > 1),
cut AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM c, unnest(range(1, len(c.g))) AS s(k), f l, f r
  WHERE l.lang = c.lang AND l.g = c.g[1:k] AND r.lang = c.lang AND r.g = c.g[k + 1:]),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, g[i : i + k - 1] AS g, max(a) AS longer
  FROM c, unnest(range(2, len(c.g))) AS s(k), unnest(range(1, len(c.g) - k + 2)) AS t(i) GROUP BY ALL)
SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, array_to_string(x.g, ' ')) AS rank,
       array_to_string(x.g, ' ') AS phrase, a, l, r, n, score
FROM weakest x JOIN total USING (lang) LEFT JOIN inner_ i ON i.lang = x.lang AND i.g = x.g
WHERE i.longer IS NULL OR 100 * i.longer < 80 * a
QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH RECURSIVE bits(k, v) AS (
  SELECT 0, list_transform(range(256), lambda x: x::UINTEGER)
  UNION ALL SELECT k + 1, list_transform(v, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UINTEGER) ELSE x >> 1 END) FROM bits WHERE k < 8),
crc AS (SELECT v FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
df AS (SELECT doc_id, w[i] AS f FROM d, unnest(range(1, len(w) + 1)) AS t(i) UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM d, unnest(range(1, len(w))) AS t(i)),
bf AS (SELECT w[i] AS f FROM b, unnest(range(1, len(w) + 1)) AS t(i) UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM b, unnest(range(1, len(w))) AS t(i)),
bytes AS (SELECT f, list_transform(range(1, octet_length(encode(f)) * 2, 2), lambda i: ('0x' || hex(encode(f))[i : i + 1])::UINTEGER) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UINTEGER, x), lambda c, y: xor(c >> 8, crc.v[(xor(c, y) & 255)::INTEGER + 1])), 4294967295::UINTEGER) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN bucket USING (f) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t ON s.bucket = t.bucket),
weighed AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 39)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_url_filter, op3_decontamination, op4_line_dedup, op5_quality_classifier, op6_chat_formatting, op7_language_id,
        op8_bpe, op9_minhash_near_dedup, op10_toxicity, op11_phrase_collocations, op12_best_fit_packing, op13_importance_resampling,
    )
}

ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op11_phrase_collocations": OP11_SQL, "op13_importance_resampling": OP13_SQL}
