"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into word shingles,
each hashed with XXH64 (seed 42); a fingerprint bit is set where it is set in over half of
the hashes. Two fingerprints within 3 bits differ in at most one bit in one of their two
32-bit halves. So each fingerprint is stored in a table under both halves and looks up the
Hamming balls of radius 1 around them; of two halves that differ in one bit only the one
with the bit unset looks up the other, so a ball has half the members. Matches are verified
on all 64 bits.

Documents with the same fingerprint form a class first and only classes are linked; a class is
named by its fingerprint. A dense group of near copies holds many classes in a few buckets, so
classes that distance-1 links (whole-fingerprint look-ups, at most 64 per class) connect are
gathered first, and a bucket's largest gathering is never compared with itself. So neither the
work nor the output of a bucket grows with the square of the group that fills it.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle count as one shingle; repeated rows share a class; a null ``doc_id``
keeps its row and its links but never names a component unless its whole component has no
other id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize, short
from termloom.llm.components import components

BITS = 64
RADIUS = 3
#: Shingle hashes held at once while one document's bit counts are summed.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text over its word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _flips(value: Column, width: int) -> Column:
    """The value, and the value with each one of its unset bits set."""
    bits = [F.when(value.bitwiseAND(F.lit(1 << i)) == 0, value.bitwiseOR(F.lit(1 << i))) for i in range(width - (width == 64))]
    if width == 64:
        bits.append(F.when(value >= 0, value.bitwiseOR(F.lit(-(1 << 63)))))
    return F.array_compact(F.array(*bits))


def cross_pairs(probes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, ca, cb) of probes (keys, a, ca) and table rows (keys, b, cb) that share their keys and
    are of different gatherings ``ca`` and ``cb``; the largest one under a key does not meet itself."""
    held = table.groupBy(*keys, F.col("cb").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy(*keys).agg(F.max(F.struct("n", "g"))["g"].alias("g"), F.count(F.lit(1)).alias("gatherings"))
    # most look-ups find nothing, and most of the rest their own gathering only
    live = probes.join(held, keys).where((F.col("gatherings") > 1) | (F.col("ca") != F.col("g")))
    sides = F.when(F.col("ca") == F.col("g"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    live = materialize(live.select(*keys, "a", "ca", F.explode(sides).alias("largest")), "pairs-probes")
    rows = table.join(held.where("gatherings > 1").select(*keys, "g"), keys, "left").withColumn("largest", F.coalesce(F.col("cb") == F.col("g"), F.lit(True)))
    return live.join(rows.select(*keys, "b", "cb", "largest"), [*keys, "largest"]).where(F.col("ca") != F.col("cb")).select("a", "b", "ca", "cb")


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) of fingerprints that connect whatever links within RADIUS bits do.

    ``classes`` has distinct ``fp``."""
    near = classes.select(F.col("fp").alias("u"), F.explode(_flips(F.col("fp"), 64)).alias("fp"))
    ones = materialize(near.join(classes.select("fp"), "fp").select("u", F.col("fp").alias("v")), "simhash-ones")
    tight = components(ones, "simhash-tight")
    grouped = classes.join(tight, classes.fp == tight.node, "left")
    grouped = materialize(grouped.select("fp", F.coalesce("component", "fp").alias("c")), "simhash-classes")
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    table = grouped.select("fp", "c", F.posexplode(halves).alias("part", "key"))
    exact = table.select("fp", "c", "part", "key")
    ball = table.select("fp", "c", "part", F.explode(_flips(F.col("key"), 32)).alias("key"))
    probes = exact.unionByName(ball).withColumnsRenamed({"fp": "a", "c": "ca"})
    pairs = cross_pairs(probes, table.withColumnsRenamed({"fp": "b", "c": "cb"}), ["part", "key"]).where(_distance("a", "b") <= RADIUS)
    wide = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return ones.unionByName(wide)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps")
    joined = components(fingerprint_links(classes.select("fp")), "simhash-components")
    members = materialize(classes.join(joined, classes.fp == joined.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c")), "simhash-members")
    low = members.groupBy("c").agg(F.min("rep").alias("component_id"))
    out = prints.join(members.join(low, "c").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similar documents: long fingerprints --------------------------------------------------

#: The probability that a bit of two fingerprints differs where the Jaccard similarity of the
#: shingle sets is 0.8: the angle of a cosine of 0.89 over pi. And that of missing such a pair.
BIT_DIFFERS, MISSED = 0.1515, 0.05
#: Segments looked up in one pass, whose shuffles are all that the disk holds at once.
PASS_SEGMENTS = 4
#: Rows of one gathering that a row is compared with wherever it meets them; for more, bounds tell which.
CROWD = 100
#: There: the part of a gathering that makes a shingle common, steps of a doubling in which lengths
#: are looked up, and what bounds leave to rounding.
COMMON, STEPS, SLACK = 10, 16, 1e-6
#: The odd factors and shifts of a well-known 64-bit mixer.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles; fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)], np.uint64))


@dataclass(frozen=True)
class Segments:
    """How many segments of how many bits a long fingerprint has."""

    count: int
    bits: int

    @property
    def words(self) -> int:
        """Longs of the fingerprint."""
        return -(-self.count * self.bits // 64)

    @property
    def far(self) -> int:
        """Bits that fingerprints may differ in before shingles are compared: at a similarity of 0.8
        one pair in a thousand differs in more."""
        n = 64 * self.words
        return math.ceil(n * BIT_DIFFERS + 3.3 * math.sqrt(n * BIT_DIFFERS * (1 - BIT_DIFFERS)))


def segments_for(n: int) -> Segments:
    """The shortest segments with which a document of n meets at most one other by chance.

    A segment of w bits differs in at most one bit with a probability s that falls with w; so many
    segments are taken that a pair at a similarity of 0.8 is missed by all with probability MISSED.
    The look-ups per document so grow with about the fourth root of the documents."""
    for w in range(16, 56):
        s = (1 - BIT_DIFFERS) ** w * (1 + w * BIT_DIFFERS / (1 - BIT_DIFFERS))
        m = math.ceil(math.log(MISSED) / math.log(1 - s))
        if m * (1 + w) / 2**w * n / 2 <= 1:
            return Segments(m, w)
    raise ValueError("too many documents")


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Unsigned longs: a bit is set where it is set in over half of the mixed hashes."""
    total = np.zeros(64 * words, np.int64)
    step = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_MIX[0]))[None, :]
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        z ^= z >> np.uint64(31)
        # 255 rows at most, so a byte holds the sum
        total += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).view(np.uint64)


def _slots(prints: np.ndarray, parts: Segments) -> np.ndarray:
    """Slots of the segments of fingerprints: the segment's number above its bits."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)[:, : parts.count * parts.bits]
    found = bits.reshape(len(prints), parts.count, parts.bits).astype(np.int64) @ (1 << np.arange(parts.bits, dtype=np.int64))
    return found + (np.arange(parts.count, dtype=np.int64) << parts.bits)


def long_fingerprints(docs: DataFrame, shingle: int, parts: Segments) -> DataFrame:
    """(row, fp, slots) of documents (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            prints = np.array([long_fingerprint(shingle_hashes(t, shingle), parts.words) for t in batch.column(1).to_pylist()], np.uint64)
            columns = [pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.int64())) for x in (prints.view(np.int64), _slots(prints, parts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "fp", "slots"])

    return docs.select("row", "text").mapInArrow(run, "row long, fp array<long>, slots array<long>")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "hashes"])

    return docs.select("row", "text").mapInArrow(run, "row long, hashes array<long>")


def _alike(a: str, b: str, similarity: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    return (common >= similarity * (F.size(a) + F.size(b) - common)) | (F.size(a) + F.size(b) == 0)


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, shingle: int, similarity: float, parts: Segments) -> DataFrame:
    """The distinct pairs (a, b) whose fingerprints are near and whose shingle sets are similar."""
    fp = prints.select("row", "fp")
    near = pairs.join(fp.withColumnsRenamed({"row": "a", "fp": "fa"}), "a").join(fp.withColumnsRenamed({"row": "b", "fp": "fb"}), "b")
    bits = reduce(add, [F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(parts.words)])
    near = materialize(near.where(bits <= parts.far).select("a", "b").distinct(), "similar-near")
    used = near.select(F.col("a").alias("row")).unionByName(near.select(F.col("b").alias("row"))).distinct()
    sets = materialize(_shingle_sets(docs.join(used, "row", "left_semi"), shingle), "similar-sets")
    both = near.join(sets.withColumnsRenamed({"row": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"row": "b", "hashes": "hb"}), "b")
    return materialize(both.where(_alike("ha", "hb", similarity)).select(F.col("a").alias("u"), F.col("b").alias("v")), "similar-links")


def _turned(slot: Column, bits: int, unset: bool) -> Column:
    """The slot with each one of its bits turned, or only with those that are unset."""
    turned = [F.when((slot.bitwiseAND(F.lit(1 << i)) == 0) | F.lit(not unset), slot.bitwiseXOR(F.lit(1 << i))) for i in range(bits)]
    return F.array_compact(F.array(*turned))


def _lone_pairs(lone: DataFrame, parts: Segments) -> DataFrame:
    """(a, b) of rows with slots that differ in at most one bit, a few segments a pass."""
    passes = []
    for first in range(0, parts.count, PASS_SEGMENTS):
        table = lone.select(F.col("row").alias("b"), F.explode(F.slice("slots", first + 1, PASS_SEGMENTS)).alias("slot"))
        exact = table.select(F.col("b").alias("a"), "slot", F.lit(True).alias("same"))
        ball = table.select(F.col("b").alias("a"), F.explode(_turned(F.col("slot"), parts.bits, True)).alias("slot"), F.lit(False).alias("same"))
        met = exact.unionByName(ball).join(table, "slot").where(~F.col("same") | (F.col("a") < F.col("b")))
        passes.append(materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "similar-lone"))
        # what this pass has shuffled is not needed any more; Spark deletes it when the plan is collected
        lone.sparkSession._jvm.System.gc()
    return reduce(DataFrame.unionByName, passes)


def _crowd_pairs(asks: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows ``a`` that would look at many rows of a gathering ``c`` (asks: a, c, n, meets): the
    asks (a, c, meets) that are settled here, pairs (a, b) left to compare, and links (u, v). What is
    settled is compared with the gathering and with all that ask for it.

    Shingles that over 1 / COMMON of a gathering's rows have are its common ones, the others rare.
    One row is the nearest to the common ones: who links to it is of the gathering, and needs no
    other row. Else a and b are alike only if they share a rare shingle, for which a looks its rarest
    ones up, or if the fewer of their common shingles reach what their lengths ask for, which is a
    range of lengths. So whoever merely resembles a crowd is not compared with each row of it.
    An ask whose look-ups outnumber the rows it meets is not settled."""
    members = rows.join(asks.select("c").distinct(), "c", "left_semi").select("c", "n", "row", F.lit(None).cast("long").alias("meets"))
    asking = asks.select("c", "n", F.col("a").alias("row"), "meets")
    used = members.select("row").unionByName(asking.select("row")).distinct()
    sets = materialize(_shingle_sets(docs.join(used, "row", "left_semi"), shingle), "similar-crowd-sets")
    around = members.unionByName(asking).join(sets, "row")
    counts = members.join(sets, "row").select("c", "n", F.explode("hashes").alias("s")).groupBy("c", "n", "s").agg(F.count(F.lit(1)).alias("df"))
    common = counts.where(F.col("df") * COMMON > F.col("n")).groupBy("c").agg(F.collect_list("s").alias("known"))
    shapes = around.join(common, "c", "left")
    rare = F.array_except("hashes", F.coalesce("known", F.array().cast("array<long>")))
    shapes = materialize(shapes.select("c", "row", "meets", F.size("hashes").alias("size"), rare.alias("rare")), "similar-shapes")
    shapes = shapes.withColumn("common", F.col("size") - F.size("rare"))
    held = shapes.select("c", "meets", F.col("row").alias("b"), F.col("size").alias("nb"), F.col("common").alias("kb"), "rare")
    counts = held.select("c", F.explode("rare").alias("s")).groupBy("c", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")

    nearest = F.struct((1 + similarity) * F.col("kb") - similarity * F.col("nb"), -F.col("b"))
    heart = held.where("meets is null").groupBy("c").agg((-F.max(nearest)["col2"]).alias("v"))
    tried = asks.select("c", F.col("a").alias("u")).join(heart, "c").join(sets.withColumnsRenamed({"row": "u", "hashes": "ha"}), "u")
    tried = tried.join(sets.withColumnsRenamed({"row": "v", "hashes": "hb"}), "v").where(_alike("ha", "hb", similarity))
    links = materialize(tried.select("c", "u", "v"), "similar-hearts")

    # what is shared is at least the similarity of the longer one's length, and of what is not common at least the rest
    left = shapes.where("meets is not null").withColumnRenamed("row", "a").join(links.select("c", F.col("u").alias("a")), ["c", "a"], "left_anti")
    least = F.ceil(similarity * F.col("size") - SLACK)
    need = F.greatest(F.lit(1), least - F.col("common"))
    found = left.select("c", "a", "meets", need.alias("need"), F.explode("rare").alias("s")).join(counts, ["c", "s"])
    found = found.groupBy("c", "a", "meets", "need").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("keys")).where(F.size("keys") >= F.col("need"))
    found = found.withColumn("keys", F.slice("keys", F.lit(1), (F.size("keys") - F.col("need") + 1).cast("int")))
    found = materialize(found.withColumn("cost", F.aggregate("keys", F.lit(0).cast("long"), lambda n, k: n + k["df"])), "similar-keys")
    costly = found.where("cost > meets").select("c", "a")
    shared = found.where("cost <= meets").select("c", "a", F.explode("keys.s").alias("s")).join(held.select("c", "b", F.explode("rare").alias("s")), ["c", "s"])

    step = lambda n: F.floor(STEPS * F.log2(n))
    most = F.floor(((1 + similarity) * F.col("common") + SLACK) / similarity) - F.col("size")
    spans = left.join(costly, ["c", "a"], "left_anti").withColumn("least", least).withColumn("most", most).where("least <= most")
    spans = spans.select("c", "a", "size", "common", F.explode(F.sequence(step(F.col("least")), step(F.col("most")))).alias("step"))
    enough = (1 + similarity) * F.least("common", "kb") + SLACK >= similarity * (F.col("size") + F.col("nb"))
    fits = spans.join(held.select("c", "b", "nb", "kb", step(F.col("nb")).alias("step")), ["c", "step"]).where(enough)
    pairs = shared.select("a", "b").unionByName(fits.select("a", "b")).where("a <> b")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-crowd-pairs")
    return asks.select("a", "c", "meets").join(costly, ["a", "c"], "left_anti"), pairs, links.select("u", "v")


def _balls(rows: DataFrame, parts: Segments) -> DataFrame:
    """(b, c, n, slot): rows (row, slots, c, n) under the whole balls around their segments."""
    many = rows.select(F.col("row").alias("b"), "c", "n", F.explode("slots").alias("slot"))
    return many.select("b", "c", "n", F.explode(F.concat(F.array("slot"), _turned(F.col("slot"), parts.bits, False))).alias("slot"))


def _beside_pairs(placed: DataFrame, parts: Segments) -> DataFrame:
    """(a, b) of lone rows (row, slots, n, z) near each other, one at least beside a crowd ``z``, not
    both beside the same."""
    probes = _balls(placed.where("z is not null").select("row", "slots", F.col("z").alias("c"), "n"), parts)
    # a row beside no crowd stands for itself; crowds have names of rows that are not lone
    table = placed.select(F.col("row").alias("b"), F.coalesce("z", "row").alias("cb"), F.explode("slots").alias("slot"))
    pairs = cross_pairs(probes.select("slot", F.col("b").alias("a"), F.col("c").alias("ca")), table, ["slot"])
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _gathered_pairs(rows: DataFrame, docs: DataFrame, parts: Segments, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(a, b) of rows (row, slots, c, n) of different gatherings where the larger one has two rows or
    more, links (u, v) found on the way, and (row, z), the crowd around which a row has been compared
    with all others there. The larger one's rows stand in the table under the whole balls around
    their segments, and rows of smaller gatherings look their own segments up, so a large group's
    rows look nothing up. In gatherings of over CROWD rows it is first counted how many of them each
    row meets; where they are more than CROWD, :func:`_crowd_pairs` tells which to compare."""
    probes = rows.select(F.col("row").alias("a"), F.struct("n", "c").alias("oa"), F.explode("slots").alias("slot"))
    table = _balls(rows.where((F.col("n") > 1) & (F.col("n") <= CROWD)), parts).select("b", F.struct("n", "c").alias("ob"), "slot")
    largest = table.groupBy("slot").agg(F.max("ob").alias("most"))
    live = materialize(probes.join(largest, "slot").where(F.col("oa") < F.col("most")).select("slot", "a", "oa"), "similar-live")
    met = live.join(table, "slot").where(F.col("oa") < F.col("ob")).select("a", "b")

    crowds = rows.where(F.col("n") > CROWD)
    if crowds.isEmpty():
        return met, None, None
    table = _balls(crowds, parts)
    held = table.groupBy("slot", "c", "n").agg(F.count(F.lit(1)).alias("held"))
    live = probes.join(held, "slot").where(F.col("oa") < F.struct("n", "c")).select("slot", "a", "c", "n", "held")
    live = materialize(live, "similar-around")
    asks = live.groupBy("a", "c", "n").agg(F.sum("held").alias("meets")).where(F.col("meets") > CROWD)
    settled, pairs, links = _crowd_pairs(materialize(asks, "similar-asks"), rows, docs, shingle, similarity)
    around = settled.groupBy(F.col("a").alias("row")).agg(F.max(F.struct("meets", "c"))["c"].alias("z"))
    few = live.join(settled, ["a", "c"], "left_anti").select("slot", "a", "c").join(table.select("slot", "c", "b"), ["slot", "c"])
    return met.unionByName(few.select("a", "b")).unionByName(pairs), links, around


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group) of documents (row, text), ``row`` distinct longs: the smallest row that links of
    a Jaccard ``similarity`` of word shingles or more lead to.

    Multi-index hashing over long fingerprints: each is stored in a table under every segment, and
    Hamming balls of radius 1 around segments are looked up; matches are verified by the complete
    distance, then by the shingle sets themselves. Documents are first compared with the smallest
    row that shares a segment, which gathers dense groups with one pair a member and segment; then
    look-ups pair documents of different gatherings only, and one that would meet many documents of
    a gathering is compared with those only that bounds on shingles leave. A pair is missed where no
    segment is near, by chance: see :func:`segments_for`. Documents without words are alike. Rows with a
    null or repeated ``row`` are not allowed; columns other than these are ignored."""
    parts = segments_for(docs.count())
    prints = materialize(long_fingerprints(docs, shingle, parts), "similar-prints")
    slots = prints.select("row", F.explode("slots").alias("slot"))
    heads = slots.groupBy("slot").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("slot", "head")
    first = slots.join(heads, "slot").where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct()
    links = _verified(first, prints, docs, shingle, similarity, parts)
    gathered = components(links, "similar-gathered")
    sizes = gathered.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rows = prints.join(gathered.join(sizes, "component"), prints.row == gathered.node, "left")
    rows = materialize(rows.select("row", "slots", F.coalesce("component", "row").alias("c"), F.coalesce("n", F.lit(1).cast("long")).alias("n")), "similar-grouped")
    crowd, near, around = _gathered_pairs(rows, docs, parts, shingle, similarity)
    wide, lone = materialize(crowd, "similar-crowd"), rows.where("n = 1")
    if around:
        placed = materialize(lone.join(around, "row", "left"), "similar-placed")
        lone = placed.where("z is null")
        wide = wide.unionByName(materialize(_beside_pairs(placed, parts), "similar-beside"))
    wide = wide.unionByName(_lone_pairs(lone, parts))
    links = links.unionByName(_verified(materialize(wide.distinct(), "similar-wide"), prints, docs, shingle, similarity, parts))
    links = links.unionByName(near) if near else links
    groups = components(links, "similar-groups")
    out = prints.join(groups, prints.row == groups.node, "left")
    return out.select("row", F.coalesce("component", "row").alias("group"))
