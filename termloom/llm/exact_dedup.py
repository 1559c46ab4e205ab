"""Exact de-duplication with an extendible-hash index kept in shared Parquet files.

Every text is folded (A-Z to a-z only, null to empty) and hashed to 64 bits; the distinct
hashes are the keys. The directory says which bucket owns a key. It begins with one bucket
for all; a bucket that holds more keys than its capacity is split on the next bit of the
hash, and the directory doubles whenever a bucket as deep as itself is split. Splitting ends
when every bucket fits, at any depth: a round counts the keys by prefix, and rounds go on
under the prefixes that are still too full. The directory is a table of (depth, prefix,
bucket), where the slots that share a bucket are one row.

Rows then go to the task that owns their bucket, which is a range of keys, and meet there
in its hash table: keys chain the texts that collide, the texts are compared byte by byte, and
each text keeps its survivor and size. A key with more rows than ``HOT_ROWS`` is combined
by input task first, so its owner gets one row from each. The tasks write the index
(bucket, hash, digest, survivor, size); every row finds its survivor by a join on hash and
digest, which Spark may split where one key is hot.

The capacity grows with the keys where needed to keep the directory within some 2 ** 17
rows, and so does the limit for hot keys; both tables are broadcast within that bound.

Defined cases: null text counts as empty; null ``doc_id`` sorts below every id; rows that
repeat the same id and text all report the same survivor and are all ``kept``; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, materialize

#: Keys of a bucket, and rows of a key that go to its owner as they are.
BUCKET_CAPACITY, HOT_ROWS = 8_192, 1_000
#: Buckets and hot keys stay within some two to this power.
TABLE_BITS = 16
HASH_BITS = 64
_ENTRY = "bucket long, depth int, prefix long, keys long"


def _prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int, n_keys: int) -> DataFrame:
    """(bucket, depth, prefix, keys) of the buckets that hold the distinct hashes ``h``.

    A bucket is named by the first key of its range."""
    settled = keys.sparkSession.createDataFrame([], _ENTRY)
    least, depth = 0, min(HASH_BITS, max(1, -(-n_keys // capacity)).bit_length() + 2)
    todo = keys.select("h")
    while True:
        leaves = materialize(todo.groupBy(_prefix(F.col("h"), depth).alias("leaf")).agg(F.count(F.lit(1)).alias("n")), "exact-leaves")
        cuts = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("leaf", depth - d).alias("prefix")) for d in range(least, depth + 1)]))
        spans = leaves.select(cuts.alias("s"), "n").groupBy("s.depth", "s.prefix").agg(F.sum("n").alias("keys"))
        fits = spans.where(F.col("keys") <= capacity)
        # what fits already before its last bit was never split
        whole = fits.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        buckets = fits.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(whole, ["depth", "parent"], "left_anti")
        start = F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)")
        fresh = buckets.select(F.when(F.col("depth") > 0, start).otherwise(F.lit(0).cast("long")).alias("bucket"), "depth", "prefix", "keys")
        settled = materialize(settled.unionByName(fresh), "exact-directory")
        full = leaves.where(F.col("n") > capacity).select("leaf")
        if full.isEmpty():
            return settled
        todo = materialize(todo.withColumn("leaf", _prefix(F.col("h"), depth)).join(full, "leaf", "left_semi").select("h"), "exact-full")
        least, depth = depth + 1, min(HASH_BITS, depth + 4)


def _owned(texts: DataFrame, directory: DataFrame) -> DataFrame:
    """The rows with the bucket that owns their hash; one look-up for each depth in use."""
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())  # 65 at most
    for d in depths:
        at = directory.where(F.col("depth") == d).select(F.col("prefix").alias(f"prefix_{d}"), F.col("bucket").alias(f"bucket_{d}"))
        texts = texts.join(F.broadcast(at), _prefix(F.col("h"), d) == F.col(f"prefix_{d}"), "left")
    bucket = F.coalesce(*[F.col(f"bucket_{d}") for d in depths]) if depths else F.lit(None).cast("long")
    return texts.select("doc_id", "body", "h", bucket.alias("bucket")).where("bucket is not null")


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    texts = docs.select("doc_id", ascii_lower(F.col("text")).alias("body")).withColumn("h", F.xxhash64("body"))
    digests = materialize(texts.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256")), "exact-digests")
    keys = materialize(digests.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    directory = build_directory(keys, max(capacity, n_keys >> TABLE_BITS), n_keys)
    hot = F.broadcast(keys.where(F.col("n") > max(hot_rows, n_rows >> TABLE_BITS)).select("h"))

    owned = _owned(texts, directory)
    alone = owned.join(hot, "h", "left_anti").select("bucket", "h", "body", "doc_id", F.lit(1).cast("long").alias("n"))
    crowd = owned.join(hot, "h", "left_semi").withColumn("task", F.spark_partition_id())
    crowd = crowd.groupBy("bucket", "h", "body", "task").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("task")
    # all rows of a bucket are in its owner's partition, so this grouping needs no other exchange
    chains = alone.unionByName(crowd).repartition("bucket").groupBy("bucket", "h", "body")
    index = chains.agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index = index.select("bucket", "h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    index = materialize(index.sortWithinPartitions("bucket", "h", "text_sha256"), "exact-index")

    found = digests.join(index, ["h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")
