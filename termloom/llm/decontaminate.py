"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A document contains a benchmark window when the window's words occur in it in a row. The
containment threshold is 1, so the necessary prefix of a window is one token: its rarest
word by frequency over all documents. The join goes in steps that leave less each:

* document words that are some window's prefix token;
* those with a place of that token in a window of some length that the document has room for,
  the positional and the length bound;
* those where the slice of the document there is a window, by its hash;
* those where it is the window, word by word, in an equi-join on the whole slice.

The first three look into sets of hash slots: whatever the benchmark holds, a set has at most
``SLOTS`` rows of one long, so it may always be broadcast; what passes by chance fails the last
step. Only what passes is shuffled. Keys that many rows share (a common word in the windows, a
passage in many documents) are salted in ``SALTS`` parts, the other side repeated as often.

Defined cases: null texts have no words; an item of no words has no window; an item shorter
than the window size is one window; a null ``item_id`` marks words as hit but is not
listed; rows that repeat the same id and text each get their row; empty tables give zero
counts or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, materialize

WINDOW = 10
#: Most rows of a set of slots, 8 MB of longs; and parts of a key that many rows share.
SLOTS, SALTS = 1 << 20, 32
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(col: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(col), WORD_BREAK), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win, key): every window of every item; key is its words joined by spaces."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    every = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return every.select("item_id", "win", F.array_join("win", " ").alias("key")).distinct()


def _slot(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(SLOTS))


def _met(rows: DataFrame, values: list[Column], among: DataFrame) -> DataFrame:
    """The rows whose values have a slot that rows of ``among`` have."""
    slots = among.select(_slot(*[F.col(c) for c in among.columns]).alias("__slot")).distinct()
    return rows.join(F.broadcast(slots), _slot(*values) == F.col("__slot"), "left_semi")


def _salted(many: DataFrame, few: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join on a key that many rows of ``many`` may share; ``spread`` tells these apart."""
    many = many.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.join(few, [key, "__salt"], how).drop("__salt")


def anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, token, back, len): each distinct window with its rarest word and that word's place."""
    distinct = windows.select("key", "win").distinct()
    spread = distinct.select("key", F.size("win").alias("len"), F.posexplode("win").alias("back", "token"))
    words = docs.select(F.explode(words_of(F.col("text"))).alias("token"))
    rarity = _met(words, [F.col("token")], spread.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = _salted(spread, rarity, "token", ["key", "back"], "left").groupBy("key", "len")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "back"))
    return ranked.agg(first.alias("a")).select("key", "a.token", "a.back", "len")


def slices(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words, at, len, key): a row with ``n_words`` for every document row, and
    rows with ``key`` for its slices that are windows, or by chance have a window's slot.

    The empty string, which is no word, closes every word list and passes all steps, so
    documents are read once and those without hits keep their row."""
    places = sorted((r["back"], r["len"]) for r in prefixes.select("back", "len").distinct().collect())  # below WINDOW squared
    body = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("row_key"), words_of(F.col("text")).alias("w"))
    words = body.select("doc_id", "row_key", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "token"))
    spark = docs.sparkSession
    end = spark.createDataFrame([("", None, None)], "token string, back int, len int")
    words = _met(words, [F.col("token")], prefixes.select("token").unionByName(end.select("token")))
    is_end = F.col("token") == ""
    place = lambda back, size: F.struct(F.lit(back).cast("int").alias("back"), F.lit(size).cast("int").alias("len"))
    every = F.array(*[place(*p) for p in places]) if places else F.array().cast("array<struct<back:int,len:int>>")
    tried = words.select("doc_id", "row_key", "w", "pos", "token", F.explode(F.when(is_end, F.array(place(None, None))).otherwise(every)).alias("p"))
    at, size = F.col("pos") - F.col("p.back"), F.col("p.len")
    tried = tried.where(is_end | ((at >= 0) & (at + size <= F.size("w"))))
    tried = _met(tried, [F.col("token"), F.col("p.back"), size], prefixes.select("token", "back", "len").unionByName(end))
    key = F.when(~is_end, F.array_join(F.slice("w", F.greatest(at, F.lit(0)) + 1, F.coalesce(size, F.lit(0))), " "))
    cut = tried.select("doc_id", "row_key", F.when(is_end, F.col("pos")).cast("long").alias("n_words"), at.alias("at"), size.alias("len"), key.alias("key"))
    return _met(cut, [F.col("key")], prefixes.select("key").unionByName(spark.createDataFrame([(None,)], "key string")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = materialize(item_windows(benchmark, window), "decon-windows")
    prefixes = materialize(anchored(windows, docs), "decon-prefixes")
    found = materialize(slices(docs, prefixes), "decon-slices")
    owner = ["doc_id", "row_key"]
    hits = _salted(found.where("key is not null").drop("n_words"), prefixes.select("key"), "key", [*owner, "at"])
    hits = materialize(hits.distinct(), "decon-hits")
    listed = windows.where("item_id is not null").select("key", F.col("item_id").cast("string").alias("item"))
    items = _salted(hits.select(*owner, "key").distinct(), listed, "key", owner).select(*owner, F.lit(None).alias("span"), "item").distinct()
    spans = hits.select(*owner, F.struct("at", "len").alias("span"), F.lit(None).cast("string").alias("item"))
    per = spans.unionByName(items).groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r"))
    per = per.agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
    out = found.where("key is null").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left")
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    ids = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("spans").isNotNull(), F.size(F.array_distinct(covered))).otherwise(0).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )
