"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are encoded and longer ones cut so that every piece but the first is full. A piece
of more than half a sequence opens its own; what room is left there is a gap. Then, in rounds:

* unplaced pieces and gaps are range-sorted together by size, from large to small;
* a sweep over the sorted parts gives each piece its successor, the smallest gap that holds it.
  Every part sweeps its own rows with a stack of the gaps met and not taken: the next piece
  takes the last of them. What a part cannot match, it ranks: pieces left without a gap take
  gaps left over in the parts before them, which follows from the parts' totals alone;
* so pieces that want the same gap are told apart by their rank in the sort: the first takes
  it and the others the next one;
* the gaps taken are made smaller, and the next round begins with what is unplaced.

A gap that holds several of the largest unplaced piece offers that many places in a round, so
small pieces fill it in one. When pieces are larger than every gap, sequences are opened for
their volume. Each round places a piece or opens a sequence; the number of rounds grows with
the logarithm of the lengths, not with the rows. The sort goes by size, kind and a hash of
the row, so a size that a third of all rows share lies in many parts. The driver sees counts
by size (at most as many as a sequence has tokens) and one row a part.

Defined cases: null and empty texts are the end token alone; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import materialize
from termloom.llm.tokenization import encoder, slices

CAPACITY = 1024


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)] if n > capacity else [0]


def pieces(docs: DataFrame, tokenizer_path: str, layout: str, end_id: int, capacity: int) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32): ``pid`` numbers the rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, layout).encode
        pid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            owner, piece, starts, ends, crcs = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                cuts = [*cut_points(len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip((owner, piece, starts, ends, crcs), (i, k, a, b, zlib.crc32(ids[a:b])), strict=True):
                        column.append(value)
            starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
            columns = [pa.array(np.arange(pid, pid + len(owner))), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
            pid += len(owner)
            yield pa.RecordBatch.from_arrays(columns, names=["pid", "doc_id", "piece", "start", "length", "ids_crc32"])

    shape = f"pid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


GAP, PIECE, MATCH = 0, 1, 2
_SWEPT = ["part", "kind", "rank", "size", "pid", "gid", "slot"]


def sweep(gaps: DataFrame, loose: DataFrame, most: int) -> DataFrame:
    """Range-sort gaps (gid, room) and pieces (pid, length) and match them part by part.

    Rows (part, kind, rank, size, pid, gid, slot): matches, and the ranked rest of each part.
    ``most`` is the largest length: a gap offers a place for each time it holds it."""
    # a gap's places stand together, so that pieces of one length fill it
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("room") / most), F.lit(1)) - 1)).alias("slot")
    offered = gaps.select(F.lit(GAP).alias("kind"), F.col("room").alias("size"), F.lit(None).cast("long").alias("pid"), "gid", places)
    wanted = loose.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), "pid", F.lit(None).cast("long").alias("gid"), F.lit(None).cast("long").alias("slot"))
    order = [F.desc("size"), F.asc("kind"), F.asc(F.xxhash64("pid", "gid")), F.asc("pid"), F.asc("gid"), F.asc("slot")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, left = TaskContext.get().partitionId(), [], 0

        def rows(kind: int, found: list) -> pa.RecordBatch:
            columns = [[part] * len(found), [kind] * len(found), *zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], names=_SWEPT)

        for batch in batches:
            met, rest = [], []
            for kind, size, pid, gid, slot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == GAP:
                    waiting.append((size, None, gid, slot))
                elif waiting:
                    met.append((0, size, pid, *waiting.pop()[2:]))
                else:
                    rest.append((left, size, pid, None, None))
                    left += 1
            if met:
                yield rows(MATCH, met)
            if rest:
                yield rows(PIECE, rest)
        if waiting:
            yield rows(GAP, [(i, *gap) for i, gap in enumerate(waiting)])

    both = offered.unionByName(wanted).repartitionByRange(*order).sortWithinPartitions(*order)
    shape = "part long, kind int, rank long, size long, pid long, gid long, slot long"
    return both.select("kind", "size", "pid", "gid", "slot").mapInArrow(run, shape)


def carried(totals: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """Which leftover pieces of a part take which leftover gaps of parts before it.

    ``totals`` counts leftovers by (part, kind). Rows (part, first, end, gap part, top): the
    piece of rank r, first <= r < end, takes the gap of rank top - (r - first)."""
    stack: list[list[int]] = []
    runs = []
    for part in sorted({p for p, _ in totals}):
        rank, n = 0, totals.get((part, PIECE), 0)
        while rank < n and stack:
            held = stack[-1]
            take = min(held[1], n - rank)
            runs.append((part, rank, rank + take, held[0], held[1] - 1))
            rank, held[1] = rank + take, held[1] - take
            if not held[1]:
                stack.pop()
        if totals.get((part, GAP)):
            stack.append([part, totals[part, GAP]])
    return runs


def _sizes(table: DataFrame, size: str) -> dict[int, int]:
    """Rows by size."""
    return {r[size]: r["n"] for r in table.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}


def best_fit(sized: DataFrame, capacity: int) -> DataFrame:
    """(pid, sequence_id, offset) of every piece (pid, length)."""
    spark = sized.sparkSession
    large = F.col("length") * 2 > capacity
    placed = [sized.where(large).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = sized.where(large & (F.col("length") < capacity)).select(F.col("pid").alias("gid"), (F.lit(capacity) - F.col("length")).alias("room"))
    loose = sized.where(~large)
    opened = 0
    while lengths := _sizes(loose, "length"):
        rooms = _sizes(gaps, "room")
        widest, least = max(rooms, default=0), min(lengths)
        volume = lambda counts, least=0: sum(size * n for size, n in counts.items() if size > least)
        # no gap holds these; and all together need this many more at least
        need = max(-(-volume(lengths, widest) // capacity), -(-(volume(lengths) - volume(rooms)) // capacity), 0)
        if need:
            fresh = spark.range(opened + 1, opened + need + 1).select((-F.col("id")).alias("gid"), F.lit(capacity).cast("long").alias("room"))
            gaps, opened = gaps.unionByName(fresh), opened + need
            widest = capacity
        swept = materialize(sweep(gaps.where(F.col("room") >= least), loose, max(size for size in lengths if size <= widest)), "packing-sweep")
        rest = swept.where(F.col("kind") != MATCH)
        runs = carried({(r["part"], r["kind"]): r["n"] for r in rest.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()})
        # at most two runs for each part of the sort
        table = spark.createDataFrame(runs, "part long, first long, end long, gap_part long, top long")
        within = (F.col("p.part") == F.col("t.part")) & (F.col("p.rank") >= F.col("t.first")) & (F.col("p.rank") < F.col("t.end"))
        pieces_left = rest.where(F.col("kind") == PIECE).alias("p").join(table.alias("t"), within, "left")
        pieces_left = pieces_left.select("p.pid", "p.size", "gap_part", (F.col("top") - F.col("p.rank") + F.col("first")).alias("gap_rank"))
        gaps_left = rest.where(F.col("kind") == GAP).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "gid", "slot")
        late = pieces_left.where("gap_part is not null").join(gaps_left, ["gap_part", "gap_rank"]).select("pid", "size", "gid", "slot")
        met = swept.where(F.col("kind") == MATCH).select("pid", "size", "gid", "slot").unionByName(late)
        # at most one row a place, so a gap's rows here are bounded by the capacity
        before = Window.partitionBy("gid").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
        met = met.join(gaps, "gid").select("pid", F.col("gid").alias("sequence_id"), (F.lit(capacity) - F.col("room") + F.col("within")).alias("offset"), "size")
        met = materialize(met, "packing-placed")
        taken = met.groupBy(F.col("sequence_id").alias("gid")).agg(F.sum("size").alias("taken"))
        gaps = gaps.join(taken, "gid", "left").select("gid", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")).where("room > 0")
        gaps = materialize(gaps, "packing-gaps")
        loose = materialize(pieces_left.where("gap_part is null").select("pid", F.col("size").alias("length")), "packing-loose")
        placed.append(met.drop("size"))
    return reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, tokenizer_path: str, layout: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    staged = materialize(pieces(docs, tokenizer_path, layout, end_id, capacity), "packing-pieces")
    placed = best_fit(staged.select("pid", "length"), capacity)
    return staged.join(placed, "pid").drop("pid")
