"""Near-duplicate line removal by an exact set-similarity join, in DataFrame functions only.

A line's set holds its different lower-cased words (runs without blanks). Lines of
``min_words`` different words and more take part; a line goes if an earlier line, by (id,
place in the text), has Jaccard similarity of ``percent`` or more. Whether that earlier line
goes itself doesn't matter, so the result doesn't depend on any order of work.

1. Word counts, gathered over all texts into a fixed number of hash buckets, order each
   line's words by rarity. The bucket table has a fixed size and is read as a scalar.
2. Lines with equal sets become one class, shown by its first line: later ones go. Sets are
   told apart by 128 bits made from 64 hash bits of each word.
3. Prefix filter: similar sets share one of their rarest n - ceil(t n) + 1 words, and two of
   one more. A rare word is a key by itself. A frequent one would gather a group that grows
   with the corpus, so frequent words of the longer prefix are keys in pairs: if the first
   word that two sets share is frequent, so is the second.
4. Leaders: lines that share two words, of three chosen by hash from the longer prefix, meet
   the first of them; those that verify are settled. The others meet other leaders, for a
   fixed number of rounds. So families of near copies are settled at a cost in proportion
   to them. Keys that at most ``FAMILY`` lines share need no leader; the join has few pairs there.
5. Join: open lines meet each other, and the settled ones before them. Settled lines meet
   none, so no pair is made within a settled family.
6. Length, positional and parity filters (bits in which parity sketches differ bound the
   words in which sets differ) drop pairs inside the join. None of the filters loses a
   pair, so the join is exact. What is left is verified on the words themselves.

Defined cases: a null text stays null and an empty text empty; a text whose lines all go
becomes empty; lines without words, or with fewer than ``min_words``, stay. Ids may be of any
type with an order; null ids come first in it. Rows that share id and text are treated
alike: neither is later than the other. Other columns pass through, whatever their names;
the columns of ``details`` may not be there already (ValueError). An empty table gives an
empty table. Very long texts are split into lines and words inside the JVM, one row at a
time; a line's row in the join holds 56 bytes a key, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from .common import drop_materialized, free_name, materialize, tidy

PERCENT = 80
#: Buckets of the word counts. A bucket holds a level, one for each doubling of the count.
BUCKETS = 1 << 19
#: Words whose bucket counts this often are frequent: keys in pairs only.
FREQUENT = 1 << 10
#: Sets of so many words have parts as keys instead of prefixes.
LONG = 256
#: Words whose pairs are a line's leader keys.
LEAST = 3
#: Rounds of leaders at most; what is open then is left to the join, which is exact by itself.
ROUNDS = 4
#: Of these, rounds in which the first open line leads.
FIRSTS = 2
#: Keys shared by more lines than this make a family, which leaders settle before the join.
FAMILY = 32
#: Up to so many words, one parity word tells sets apart as well as two.
SHORT = 64
#: Bits for each id in the table that tells which texts to read again, and most words of it.
FILTER_BITS, FILTER_WORDS = 16, 1 << 20
#: Blanks of a line other than the plain one.
_BLANKS = "[\\t\\x0B\\f\\r]"
_KEY_BITS = 58


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, hash, line_no, line) of the texts of (doc, hash, text)."""
    return docs.select("doc", "hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _plain(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with texts in lower case and plain blanks only; one plain blank splits fastest."""
    lower = F.lower(text)
    return docs.withColumn(text, F.when(F.col(text).rlike(_BLANKS), F.regexp_replace(lower, _BLANKS, " ")).otherwise(lower))


def _split(text: str | Column) -> Column:
    """Words of a plain text, with empty ones where blanks adjoin."""
    return F.split(text, " ", -1)


def _shift_left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, F.lit(by) if isinstance(by, int) else by)


def _one(place: Column) -> Column:
    """A long with one bit set."""
    return _shift_left(F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))


def _dense(sparse: DataFrame, size: int, value: Column) -> Column:
    """Array of ``size`` values from rows of (place, value), 0 where there is none, as a scalar."""
    every = sparse.sparkSession.range(0, size, 1, 1).select(F.col("id").alias("place"), F.lit(0).cast("bigint").alias("value"))
    dense = sparse.unionByName(every).groupBy("place").agg(value.alias("value"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])).scalar()


def _word_levels(docs: DataFrame) -> Column:
    """Rarity of the words of all plain texts by hash bucket, above the bits of a key: one array of fixed length."""
    words = docs.select(F.explode(_split(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
    seen = words.select(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("place"), F.lit(1).cast("bigint").alias("value"))
    return _dense(seen, BUCKETS, _shift_left(F.least(F.floor(F.log2(F.sum("value") + 1)), F.lit(31)).cast("bigint"), _KEY_BITS))


def _id_filter(ids: DataFrame, n: int) -> tuple[Column, int]:
    """Bit table of the ids in all columns (false positives only), and its number of bits."""
    size = min(FILTER_WORDS, 1 << max(10, (n * FILTER_BITS // 64).bit_length()))
    bit = F.xxhash64(*ids.columns).bitwiseAND(F.lit(size * 64 - 1))
    return _dense(ids.select(F.shiftright(bit, 6).alias("place"), _one(bit).alias("value")), size, F.bit_or("value")), size * 64


def _may_hold(table: tuple[Column, int], columns: list[str]) -> Column:
    bits, size = table
    bit = F.xxhash64(*columns).bitwiseAND(F.lit(size - 1))
    return F.get(bits, F.shiftright(bit, 6).cast("int")).bitwiseAND(_one(bit)) != 0


def _least_size(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100) in whole numbers."""
    return F.floor((n * percent + 99) / 100)


def _sketches(docs: DataFrame, percent: int) -> DataFrame:
    """For each line: two digests of its set, n, the keys of its rarest words, parity bits.

    A key holds the word's level above 58 bits of its hash, so that keys sort by rarity.
    Two words of a line may share a key; both stay, which keeps the counts of shared keys
    at least as high as those of shared words. The digests are of whole hashes. Short sets
    have one parity word, and 0. The optimizer moves the scalar table of levels into the one expression
    that reads it, as long as what it stands beside reads ``hashes`` more than once; as a
    column the table would be copied for every line.
    """
    docs = _plain(docs)
    key = lambda h: F.get("levels", h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(h.bitwiseAND(F.lit((1 << _KEY_BITS) - 1)))
    bit = lambda k: F.shiftright(k, 24).bitwiseAND(F.lit(63)).cast("int")

    def parity(of: Callable[[Column], Column]) -> Column:
        """Parity of the words by six bits of the key; ``of`` is 1 for those that count."""
        return F.aggregate("keys", F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(_shift_left(of(k), bit(k))))

    where = ["doc", "hash", "line_no"]
    hashes = F.array_distinct(F.transform(_split("line"), lambda w: F.xxhash64(w)))
    lines = _lines(docs).select(*where, F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit("")))).alias("hashes"))
    digests = [F.xxhash64("hashes").alias("d1"), F.xxhash64(F.lit(1), "hashes").alias("d2"), F.size("hashes").cast("bigint").alias("n")]
    lines = lines.select(*where, "hashes", *digests).withColumn("levels", _word_levels(docs))
    lines = lines.select(*where, "d1", "d2", "n", F.sort_array(F.transform("hashes", key)).alias("keys"))
    prefix = F.slice("keys", F.lit(1), F.least(F.col("n"), F.col("n") - _least_size(F.col("n"), percent) + 2).cast("int"))
    whole = F.when(F.col("n") >= _sizes(percent)[0], F.col("keys"))
    every = parity(lambda k: F.lit(1).cast("bigint"))
    half = F.when(F.col("n") < SHORT, F.lit(0).cast("bigint")).otherwise(parity(lambda k: F.shiftright(k, 20).bitwiseAND(F.lit(1).cast("bigint"))))
    lines = lines.select(*where, "d1", "d2", "n", prefix.alias("prefix"), whole.alias("whole"), every.alias("every"), half.alias("q1"))
    return lines.select(*where, "d1", "d2", "n", "prefix", "whole", F.col("every").bitwiseXOR(F.col("q1")).alias("q0"), "q1")


def _sizes(percent: int) -> list[int]:
    """First sizes of the classes of long sets: what is similar to a set lies in its class or next to it."""
    out = [-(-LONG * percent // 100)]
    while percent < 100 and out[-1] < 1 << 31:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _parted(classes: DataFrame, percent: int) -> DataFrame:
    """A row for each part of each long class, as :func:`_keyed` has them for prefixes.

    A set stands at the level of its size class and at the next, where it meets larger ones. At a
    level sets differ in at most K words, so of P parts at least P - K hold the same words;
    a set with fewer empty parts than that needs no keys for them.
    """
    sizes = _sizes(percent)
    most = [2 * (100 - percent) * (b - 1) // (100 + percent) for b in sizes[1:]]
    table = F.array(*(F.struct(F.lit(b).cast("bigint").alias("from"), F.lit(k).cast("bigint").alias("k"), F.lit(k + k // 4 + 4).cast("bigint").alias("p")) for b, k in zip(sizes, [*most, most[-1] if most else 0], strict=True)))
    long_ = classes.filter(F.col("n") >= sizes[0]).withColumn("level", (F.size(F.filter(table, lambda x: x["from"] <= F.col("n"))) - 1).cast("int"))
    both = long_.select("id", "whole", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level")).withColumn("at_level", F.get(table, F.col("level"))).filter("at_level is not null")
    words = both.select("id", "level", F.col("at_level.k").alias("k"), F.col("at_level.p").alias("p"), F.explode("whole").alias("word"))
    dealt = words.groupBy("id", "level", "k", "p", F.pmod(F.xxhash64("word"), F.col("p")).alias("part")).agg(F.bit_xor(F.xxhash64("word", F.lit(1))).alias("held"))
    sparse = dealt.groupBy("id", "level", "k", "p").agg(F.collect_set("part").alias("parts")).filter(F.size("parts") <= F.col("k"))
    empty = sparse.select("id", "level", F.explode(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1), "parts")).alias("part"), F.lit(0).cast("bigint").alias("held"))
    keys = dealt.select("id", "level", "part", "held").unionByName(empty).select("id", F.xxhash64("level", "part", "held").alias("key"))
    marks = [c for c in classes.columns if c == "done"]
    own = long_.select("id", "ord", F.shiftleft("n", 32).alias("np"), "q0", "q1", *marks)
    return keys.join(own, "id").select("key", "id", "ord", "np", "q0", "q1", *marks)


def _order(doc: str, kind: DataType) -> Column:
    """A long that never falls as the id in ``doc`` rises, nulls first."""
    value = F.col(f"{doc}.of")
    if isinstance(kind, IntegralType):
        value = value.cast("bigint")
    elif isinstance(kind, StringType):
        value = F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    else:
        value = F.lit(0).cast("bigint")
    return F.coalesce(value, F.lit(-(1 << 63)).cast("bigint"))


def _families(classes: DataFrame) -> DataFrame | None:
    """(key, id, at, np, q0, q1) of the classes whose leader key more than ``FAMILY`` share; None without such keys.

    Leader keys are the pairs among the three words of the prefix with the least hashes,
    so that near copies choose the same ones more often than not.
    """
    least = F.slice(F.sort_array(F.transform("prefix", lambda k: F.xxhash64(k))), 1, LEAST)
    two = lambda i, j: F.xxhash64(F.get("w", F.lit(i)), F.get("w", F.lit(j)))
    keys = F.array(*[two(i, j) for j in range(LEAST) for i in range(j)])
    some = F.slice(keys, F.lit(1), F.expr("int(size(w) * (size(w) - 1) / 2)"))
    rows = lambda *more: classes.select(*more, least.alias("w")).select(*more, F.explode(some).alias("key"))
    shared = materialize(rows().groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > FAMILY).select("key"), "linekeys")
    n = shared.count()
    found = materialize(_near(rows("id", "at", "n", "q0", "q1"), shared, n, "key").withColumn("np", F.shiftleft("n", 32)).drop("n"), "linefamilies") if n else None
    drop_materialized(shared)
    return found


def _near(rows: DataFrame, few: DataFrame, n: int, *on: str) -> DataFrame:
    """The rows whose ``on`` is among the ``n`` rows of ``few``; only what a bit table lets through is shuffled."""
    return rows.filter(_may_hold(_id_filter(few.select(*on), n), list(on))).join(few, list(on))


def _settled(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """(id, at, ``earlier``) of the classes that a leader settles, in rounds; None without large families.

    In the first rounds the open members of a key meet the first of them, in the others one
    drawn by hash from all members, settled ones included. Those that verify are settled.
    What is open after the last round is left to the join.
    """
    spark = classes.sparkSession
    rows = _families(classes)
    if rows is None:
        return None
    words = _words_of(rows.select("id", "at").distinct(), texts)
    done = spark.createDataFrame([], words.select("id", "at", F.col("at").alias("earlier")).schema)
    for k in range(ROUNDS):
        open_ = rows.join(done.select("id"), "id", "left_anti")
        among, order = (open_, F.struct("at")) if k < FIRSTS else (rows, F.struct(F.xxhash64("id", F.lit(k))))
        lead = among.groupBy("key").agg(F.min(F.struct(order.alias("order"), "at", "id", "np", "q0", "q1")).alias("lead")).select("key", "lead.*").alias("lead")
        met = open_.alias("m").join(lead, (F.col("m.key") == F.col("lead.key")) & (F.col("m.at") > F.col("lead.at")) & _alike("lead", "m", percent))
        found = _similar(met.select(F.col("lead.id").alias("a"), F.col("m.id").alias("b")).distinct(), words, percent)
        if found.isEmpty():
            drop_materialized(found)
            break
        both = materialize(done.unionByName(found), "linesettled")
        drop_materialized(found, *([done] if k else []))
        done = both
        tidy(spark)
    drop_materialized(rows, words)
    return done


def _keyed(classes: DataFrame, percent: int) -> DataFrame:
    """A row for each key of each class: (key, id, ord, np, q0, q1), and ``done`` where the classes have it.

    ``np`` packs n, the place of the key's first word, and whether the key is of two words.
    """
    marks = [c for c in classes.columns if c == "done"]
    frequent = lambda k: F.shiftright(k, _KEY_BITS) >= F.lit(FREQUENT.bit_length() - 1)
    shorter = (F.col("n") - _least_size(F.col("n"), percent) + 1).cast("int")
    spots = F.transform("prefix", lambda k, i: F.struct(k.alias("k"), _shift_left(i.cast("bigint"), 1).alias("i")))
    rare = F.filter(F.slice(spots, F.lit(1), shorter), lambda x: ~frequent(x["k"]))
    many = F.filter(spots, lambda x: frequent(x["k"]))
    after = lambda all_, x: F.filter(all_, lambda y: y["i"] > x["i"])
    pair = lambda x, y: F.struct(F.xxhash64(x["k"], y["k"]).alias("k"), (x["i"] + 1).alias("i"))
    pairs = F.flatten(F.transform(many, lambda x: F.transform(after(many, x), lambda y: pair(x, y))))
    keys = F.when(F.size(many) < 2, rare).otherwise(F.concat(rare, pairs))
    rows = classes.filter(F.col("n") < LONG).select("id", "ord", "n", "q0", "q1", *marks, F.explode(keys).alias("x"))
    short = rows.select(F.col("x.k").alias("key"), "id", "ord", F.shiftleft("n", 32).bitwiseOR(F.col("x.i")).alias("np"), "q0", "q1", *marks)
    return short.unionByName(_parted(classes, percent))


def _alike(a: str, b: str, percent: int) -> Column:
    """Length, parity and positional filters of two rows that share a key."""
    of = lambda x, c: F.col(f"{x}.{c}")
    na, nb = F.shiftright(of(a, "np"), 32), F.shiftright(of(b, "np"), 32)
    pa, pb = (F.shiftright(of(x, "np").bitwiseAND(F.lit((1 << 32) - 1)), 1) for x in (a, b))
    x0, x1 = of(a, "q0").bitwiseXOR(of(b, "q0")), of(a, "q1").bitwiseXOR(of(b, "q1"))
    differing = F.when(F.least(na, nb) < SHORT, F.bit_count(x0.bitwiseXOR(x1))).otherwise(F.bit_count(x0) + F.bit_count(x1))
    # Similar sets pass at the first word that they share; before it they share none.
    shared = F.least(na - pa, nb - pb)
    return (
        # |A ^ B| (100 + p) <= (100 - p) (|A| + |B|) wherever 100 |A & B| >= p |A | B|.
        (differing * (100 + percent) <= (na + nb) * (100 - percent))
        & (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
        & (shared * (100 + percent) >= (na + nb) * percent)
    )


def _words_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, at, words) of the classes (id, at), read from the texts once more and written."""
    where = ["doc", "hash", "line_no"]
    wanted = materialize(wanted.select("id", "at", "at.*"), "lineplaces")
    n = wanted.count()
    near = _lines(docs.filter(_may_hold(_id_filter(wanted.select("doc", "hash"), n), ["doc", "hash"])))
    near = near.filter(_may_hold(_id_filter(wanted.select(*where), n), where))
    words = F.array_distinct(F.array_remove(_split("line"), ""))
    # Rows that share id and text give equal lines; one of them is enough.
    read = materialize(_plain(near.join(wanted, where), "line").select("id", "at", words.alias("words")).dropDuplicates(["id"]), "linewords")
    drop_materialized(wanted)
    return read


def _similar(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, the similar ones: (id and place of the later, ``earlier``: the first place found)."""
    end = lambda x: words.select(F.col("id").alias(x), F.col("at").alias(f"at_{x}"), F.col("words").alias(f"w{x}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    alike = both.filter(common * 100 >= (F.size("wa") + F.size("wb") - common) * percent)
    later = alike.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("id"), F.greatest("at_a", "at_b").alias("at"), F.least("at_a", "at_b").alias("earlier"))
    return materialize(later.groupBy("id").agg(F.min("at").alias("at"), F.min("earlier").alias("earlier")), "linelinks")


def duplicate_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = 1) -> DataFrame:
    """(doc, hash, line_no, earlier) of the lines of (doc, hash, text) that go.

    ``earlier``: the first line of its class for a repeat; else the first earlier line
    found to be similar. The table is the caller's to delete.
    """
    spark = docs.sparkSession
    texts = docs.filter(F.col("text").isNotNull())
    # The filter stands behind the table: before it, Spark would work out the words twice.
    wide = materialize(_sketches(texts, percent), "linesketches")
    tidy(spark)
    lines = wide.filter(F.col("n") >= max(1, min_words))
    place = F.struct("doc", "line_no", "hash")
    parts = ["n", "prefix", "whole", "q0", "q1"]
    # Sets that occur once are classes as they stand; only the others are gathered.
    several = materialize(lines.groupBy("d1", "d2").agg(F.count("*").alias("copies")).filter("copies > 1").select("d1", "d2"), "linecopies")
    again = _may_hold(_id_filter(several, several.count()), ["d1", "d2"])
    merged = lines.filter(again).groupBy("d1", "d2").agg(F.min(place).alias("at"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in parts])
    merged = materialize(merged, "lineclasses")
    repeated = merged.filter("copies > 1").select("d1", "d2", F.col("at").alias("earlier"))
    repeats = lines.filter(again).select("doc", "hash", "line_no", "d1", "d2").join(repeated, ["d1", "d2"]).filter(place != F.col("earlier"))
    repeats = materialize(repeats.select("doc", "hash", "line_no", "earlier"), "linerepeats")
    tidy(spark)
    classes = lines.filter(~again).select("d1", "d2", place.alias("at"), *parts).unionByName(merged.select("d1", "d2", "at", *parts))

    # Sets so small that one word more or less is too much are similar to equal sets only.
    joinable = classes.filter(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    joinable = joinable.select(F.xxhash64("d1", "d2").alias("id"), "at", _order("at.doc", docs.schema["doc"].dataType["of"].dataType).alias("ord"), *parts)
    settled = _settled(joinable, texts, percent)
    open_or_not = joinable.drop("at").withColumn("done", F.lit(False))
    if settled is not None:
        maybe = _may_hold(_id_filter(settled.select("id"), settled.count()), ["id"])
        checked = joinable.drop("at").filter(maybe).join(settled.select("id", F.lit(True).alias("settled")), "id", "left")
        checked = materialize(checked.withColumn("done", F.col("settled").isNotNull()).drop("settled"), "linesettled")
        open_or_not = open_or_not.filter(~maybe).unionByName(checked)

    # The later of two lines is an open one. No condition is of one side alone, so that both share one exchange.
    rows = _keyed(open_or_not, percent)
    u, v = rows.alias("u"), rows.alias("v")
    tied = (F.col("u.ord") == F.col("v.ord")) & ((F.col("u.id") < F.col("v.id")) | (F.col("u.done") & (F.col("u.id") != F.col("v.id"))))
    not_after = ((F.col("u.ord") < F.col("v.ord")) | tied) & (~F.col("v.done") | (F.col("u.ord") > F.col("v.ord")))
    met = u.join(v, (F.col("u.key") == F.col("v.key")) & not_after & _alike("u", "v", percent)).select(F.col("u.id").alias("a"), F.col("v.id").alias("b"))
    ends = materialize(met.distinct(), "linepairs")
    ids = materialize(ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct(), "lineends")
    tidy(spark)
    words = _words_of(_near(joinable.select("id", "at"), ids, ids.count(), "id"), texts)
    near = _similar(ends, words, percent)
    drop_materialized(ends, ids, words)
    if settled is not None:
        # A settled line that was met again may turn out to be the later one; it has its partner already.
        near = settled.unionByName(near.join(settled.select("id"), "id", "left_anti"))
    out = materialize(repeats.unionByName(near.select("at.*", "earlier").select("doc", "hash", "line_no", "earlier")).distinct(), "linesgone")
    drop_materialized(wide, several, merged, repeats, *([settled, checked] if settled is not None else []))
    tidy(spark)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, min_words: int = 1, details: bool = False) -> DataFrame:
    """``docs`` with the later of similar lines cut out of ``text``.

    With ``details`` also n_lines, n_removed, removed_lines (places from 0) and
    matched_docs (ids of the earlier lines), both in the order of the lines.
    """
    clash = {c.lower() for c in docs.columns} & {"n_lines", "n_removed", "removed_lines", "matched_docs"} if details else ()
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    # The id stands in a struct, in which nulls are equal and come first.
    doc = F.struct(F.col(key).alias("of"))
    plain = docs.select(doc.alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    gone = duplicate_lines(plain, percent, min_words)
    per_doc = gone.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("earlier.doc.of").alias("of")))).alias("cut"))
    per_doc = materialize(per_doc, "linecuts")
    drop_materialized(gone)
    k, h, c = (free_name(docs, x) for x in ("doc", "text_h", "line_cut"))
    keyed = docs.withColumns({k: doc, h: F.xxhash64(text)})
    cut = per_doc.select(F.col("doc").alias(k), F.col("hash").alias(h), F.col("cut").alias(c))
    # Only texts that lose lines are moved.
    touched = _may_hold(_id_filter(cut.select(k, h), per_doc.count()), [k, h])
    untouched = keyed.filter(~touched).withColumn(c, F.lit(None).cast(cut.schema[c].dataType))
    joined = keyed.filter(touched).join(cut, [k, h], "left").unionByName(untouched)
    p = free_name(docs, "line_parts")
    joined = joined.withColumn(p, F.split(text, "\n", -1))
    parts = F.col(p)
    places = F.transform(F.col(c), lambda x: x["line_no"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    left = F.transform(stay, lambda i: F.get(parts, i))
    extra = [
        F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(places, F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce(F.transform(F.col(c), lambda x: x["of"]), F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")).alias("matched_docs"),
    ]
    body = F.when(F.col(c).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text)
    return joined.select(*(body if x == text else F.col(x) for x in docs.columns), *(extra if details else ()))
