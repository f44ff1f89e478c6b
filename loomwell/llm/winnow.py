"""Benchmark decontamination by winnowing; DataFrame and SQL functions only.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of anything outside ASCII.  A
window is SPAN consecutive words of a benchmark item (an item of fewer words is one window).

Winnowing: of every run of GUARD = SPAN - GRAM + 1 consecutive GRAM-word hashes the least is
kept.  Two equal stretches of SPAN words hold the same run of hashes and therefore keep the same
least value, so each shared window shares a fingerprint.  Steps:
 1. Fingerprints of documents (distinct for each text) meet those of the benchmark; what is left
    are the texts with a possible hit.
 2. In those, every GRAM-word run whose hash is a benchmark fingerprint is an anchor.  An anchor is
    extended to the windows around it, at most GUARD, and each such window is compared, as its
    words, with the windows of the benchmark.  A row holds one window, never a whole text.
 3. Covered word positions are united for each text, and so are the items of its distinct windows.
Items shorter than SPAN words are looked up by a hash of the whole item; only item lengths that
occur in the benchmark are hashed.  All steps are linear in the words of texts and items.

A side of a join is broadcast only if it was counted and has at most BROADCAST_ROWS rows and
BROADCAST_BYTES bytes; otherwise the join is a shuffle, salted where one key can be frequent.
Texts are identified by two hashes and their length, so copies are examined once.

Null text has no words and no hits.  Repeated rows, null ids and empty texts are returned like
any others; an empty benchmark hits nothing; repeated items of one item_id count once; a null
item_id never counts.  Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_name

SPAN, GRAM = 10, 5
GUARD = SPAN - GRAM + 1
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
SALT = 16

#: Words of lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only.  lower() does the same, and faster, where no other letter would change."""
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _grams(words: Column, size: int) -> Column:
    """Hash of each run of `size` words, by its first position."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + (j - 1)) for j in range(size)]))


def _least(grams: Column) -> Column:
    """Distinct least hashes of every GUARD consecutive ones."""
    at = F.when(F.size(grams) >= GUARD, F.sequence(F.lit(0), F.size(grams) - GUARD)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.least(*[F.get(grams, i + j) for j in range(GUARD)])))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.crc32(text).alias("k2"), F.octet_length(text).alias("k3")]


KEY = ["k1", "k2", "k3"]


def _small(df: DataFrame, *wide: str) -> bool:
    """Whether df, already cut, may be broadcast; wide: its columns of no fixed size."""
    size = sum([F.coalesce(F.octet_length(c), F.lit(0)) for c in wide], F.lit(32))
    got = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return got[0] <= BROADCAST_ROWS and got[1] <= BROADCAST_BYTES


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str, small: bool, spread: str | None = None) -> DataFrame:
    """Join; spread: a column of the left side that deals a frequent key out to SALT tasks."""
    if small:
        return left.join(F.broadcast(right), on, how)
    if spread is None:
        return left.join(right, on, how)
    left = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def _item_windows(items: DataFrame) -> DataFrame:
    """Distinct (win, item): each window of an item, its words joined by one space."""
    n = F.least(F.size("iw"), F.lit(SPAN))
    wins = F.transform(F.sequence(F.lit(1), F.size("iw") - n + 1), lambda i: F.array_join(F.slice("iw", i, n), " "))
    return items.select(F.col("item_id").cast("string").alias("item"), F.explode(F.array_distinct(wins)).alias("win")).distinct()


def _hits(docs: DataFrame, benchmark: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """Of each hit text (k1, k2, k3, n_hit, items); and of every row (*kept, k1, k2, k3, n_words), from the same pass."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("iw")).distinct()
    items = cut(items.filter(F.size("iw") > 0))
    # at most SPAN - 1 values
    lengths = [r[0] for r in items.filter(F.size("iw") < SPAN).select(F.size("iw").alias("n")).distinct().collect()]
    prints = items.filter(F.size("iw") >= SPAN).select(_grams(F.col("iw"), GRAM).alias("grams")).select(F.explode(_least(F.col("grams"))).alias("g"))
    for n in lengths:
        prints = prints.union(items.filter(F.size("iw") == n).select(F.explode(_grams(F.col("iw"), n)).alias("g")))
    prints = cut(prints.distinct())
    few = _small(prints)
    of_items = cut(_item_windows(items))
    windows = cut(of_items.select("win").distinct())
    few_windows = _small(windows, "win")

    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(*kept, *text_key(text), words_of(text).alias("w")).withColumn("g", _grams(F.col("w"), GRAM))
    short = [F.array_distinct(_grams(F.col("w"), n)) for n in lengths]
    # the texts are cut into words and hashed once; the fingerprints stay in the shared folder
    seen = cut(words.select(*kept, *KEY, F.size("w").cast("long").alias("n_words"), F.concat(_least(F.col("g")), *short).alias("g")))
    hot = cut(_meet(seen.select(*KEY, F.explode("g").alias("g")), prints, ["g"], "left_semi", few, "k1").select(KEY).distinct())

    texts = docs.filter("text is not null").select("text", *text_key(F.col("text")))
    hit_texts = _meet(texts, hot, KEY, "left_semi", _small(hot)).dropDuplicates(KEY)
    hit_words = cut(hit_texts.select(*KEY, words_of(F.col("text")).alias("w")))
    anchors = hit_words.select(*KEY, F.posexplode(_grams(F.col("w"), GRAM)).alias("p", "g"), F.lit(SPAN).alias("n"))
    for n in lengths:
        anchors = anchors.union(hit_words.select(*KEY, F.posexplode(_grams(F.col("w"), n)).alias("p", "g"), F.lit(n).alias("n")))
    anchors = _meet(anchors, prints, ["g"], "left_semi", few, "p").groupBy(KEY).agg(F.collect_set(F.struct("n", "p")).alias("anchors"))

    def around(a: Column) -> Column:
        low, high = F.greatest(a["p"] - (GUARD - 1), F.lit(0)), F.least(a["p"], F.size("w") - SPAN)
        whole = F.array(F.struct(a["n"].alias("n"), a["p"].alias("at")))
        near = F.transform(F.sequence(low, high), lambda i: F.struct(a["n"].alias("n"), i.alias("at")))
        none = F.array().cast("array<struct<n:int,at:int>>")
        return F.when(a["n"] < SPAN, whole).when(low <= high, near).otherwise(none)

    places = F.array_distinct(F.flatten(F.transform("anchors", around)))
    tried = hit_words.join(anchors, KEY).select(*KEY, "w", places.alias("places"))
    tried = tried.select(*KEY, F.explode(F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ").alias("win")))).alias("x"))
    found = cut(_meet(tried.select(*KEY, "x.at", "x.n", "x.win"), windows, ["win"], "left_semi", few_windows, "k1"))
    covered = found.groupBy(KEY).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    covered = covered.select(*KEY, F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))).alias("n_hit"))
    named = _meet(found.select(*KEY, "win").distinct(), of_items, ["win"], "inner", _small(of_items, "win", "item"), "k1")
    named = named.groupBy(KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return cut(covered.join(named, KEY)), seen.drop("g")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a hit word, with all their columns."""
    names = [fresh_name(docs, "hit_" + k) for k in KEY]
    hits = cut(_hits(docs, benchmark)[0].select(*[F.col(k).alias(n) for k, n in zip(KEY, names)]))
    keyed = docs.withColumns(dict(zip(names, text_key(F.coalesce("text", F.lit(""))))))
    return _meet(keyed, hits, names, "left_anti", _small(hits)).select(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, contaminated) of every row."""
    hits, rows = _hits(docs.select("doc_id", "text"), benchmark, "doc_id")
    items = hits.select(F.sum(F.coalesce(F.octet_length(F.array_join("items", ",")), F.lit(0)))).first()[0] or 0
    none = F.array().cast("array<string>")
    # copies of one text carry one key: where the hits are many, doc_id deals them out
    joined = _meet(rows, hits, KEY, "left", items <= BROADCAST_BYTES and _small(hits), "doc_id")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("items").isNotNull().alias("contaminated"),
    )
