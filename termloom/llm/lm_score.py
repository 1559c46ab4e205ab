"""Cross-entropy difference under matched target and background n-gram models.

Both models are character n-gram models of the same order, smoothing and vocabulary: all
folded characters met in the documents, and a boundary. The background model is counted over
all documents, the target model over the documents labelled good outside the held-out fold,
all of them: their ids are joined, not broadcast. A document's score is the mean over its
characters of the target's loss less the background's, with the sign turned: higher is
closer to the target.

Documents are dealt into blocks of about ``BLOCK`` characters. A block lists each of its
n-grams once, with counts; the lists are summed into one distributed table of all n-grams,
keyed by the characters themselves (21 bits each: the context in one long, the last one beside it).
The table of losses follows from it by joins with the shorter contexts, and each block gets
the losses of its own n-grams by a join. Vocabulary and counts grow with the corpus; a task
holds one block and its list, and the driver only the totals. (``vocabulary``,
``count_grams`` and ``log_probabilities`` are the small dense model of the toxicity decoder.)

Defined cases: null and empty texts have no characters and score 0 with zero losses; rows of
``labels`` without ids or labels choose nothing; without any target both models are the
same, up to smoothing, and score by the uniform model; repeated rows count and score each;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import held_out, materialize, short

ORDER = 4
#: Characters of a block: what a task holds at once, unless one document is longer.
BLOCK = 1 << 21
POINT_BITS = 21
SMOOTHING = 5.0
BOUNDARY, UNKNOWN = 0, 1
_FLUSH = 4_000_000
_PLANE = 1 << 16


def _folded() -> np.ndarray:
    """Lower-case code point of each code point of the basic plane; the last cell stands for the others."""
    out = np.arange(_PLANE + 1)
    for i in range(_PLANE):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


FOLDED = _folded()


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), _PLANE)


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Symbol of each code point: 0 boundary, 1 unknown, then characters by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PLANE + 1, np.int64)
        for batch in short(batches):
            total += np.bincount(code_points("".join(t for t in batch.column(0).to_pylist() if t)), minlength=_PLANE + 1)
        merged = np.bincount(FOLDED, weights=total, minlength=_PLANE + 1).astype(np.int64)
        found = np.flatnonzero(merged)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(merged[found])], names=["c", "n"])

    counts = docs.select("text").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    # at most one row for each code point of the basic plane
    top = sorted(((r["n"], -r["c"]) for r in counts.where(f"c < {_PLANE} and c > 0").collect()), reverse=True)[: size - 2]
    symbol_of = np.full(_PLANE + 1, UNKNOWN, np.int64)
    for symbol, (_, c) in enumerate(top, 2):
        symbol_of[-c] = symbol
    return symbol_of[FOLDED]


def symbols(texts: list[str], symbol_of: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each after order - 1 boundaries and ended by one; and their first places."""
    pad = "\0" * (order - 1)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = code_points(pad + ("\0" + pad).join(t.replace("\0", "�") for t in texts) + "\0")
    out = np.where(points == 0, BOUNDARY, symbol_of[points])
    starts = np.cumsum(np.r_[0, lengths[:-1] + order]) + order - 1
    return out, starts


def gram_codes(seq: np.ndarray, order: int, size: int) -> np.ndarray:
    """Code of the n-gram that ends at each place from order - 1 on."""
    out = seq[: len(seq) - order + 1].astype(np.int64)
    for k in range(1, order):
        out = out * size + seq[k : len(seq) - order + 1 + k]
    return out


def count_grams(docs: DataFrame, symbol_of: np.ndarray, order: int, size: int) -> DataFrame:
    """(gram, target, background) over all rows of (text, chosen)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(symbol_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        totals = [np.zeros(size**order, np.int32) for _ in range(2)]
        held: list[list[np.ndarray]] = [[], []]

        def flush(which: int) -> None:
            if held[which]:
                totals[which] += np.bincount(np.concatenate(held[which]), minlength=size**order).astype(np.int32)
                held[which].clear()

        waiting = [0, 0]
        for batch in short(batches):
            texts, chosen = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for which in (0, 1):
                some = [t for t, c in zip(texts, chosen, strict=True) if t and bool(c) == bool(which)]
                if some:
                    seq, _ = symbols(some, table, order)
                    codes = gram_codes(seq, order, size)
                    held[which].append(codes[seq[order - 1 :] != BOUNDARY])
                    waiting[which] += len(codes)
                if waiting[which] > _FLUSH:
                    flush(which)
                    waiting[which] = 0
        flush(0)
        flush(1)
        found = np.flatnonzero(totals[0] + totals[1])
        target, other = totals[1][found].astype(np.int64), totals[0][found].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(target), pa.array(target + other)], names=["gram", "target", "background"])

    rows = docs.select("text", "chosen").mapInArrow(run, "gram long, target long, background long")
    return rows.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int, size: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probability of each n-gram's last symbol after the others: interpolated with the
    shorter contexts down to the uniform distribution."""
    table = np.zeros(size**order, np.float32)
    table[grams] = counts
    p = np.full(size, 1.0 / size, np.float32)
    for n in range(1, order + 1):
        part = table.reshape(-1, size**n).sum(axis=0) if n < order else table
        part = part.reshape(-1, size)
        seen = part.sum(axis=1, keepdims=True)
        lower = np.broadcast_to(p.reshape(-1, size), (size, max(1, size ** (n - 2)), size)).reshape(-1, size) if n > 1 else p.reshape(1, size)
        p = (part + smoothing * lower) / (seen + smoothing)
    return np.log(p).reshape(-1)


@functools.cache
def _lower() -> np.ndarray:
    """Folded code point of every code point; a null character becomes the replacement character."""
    out = np.arange(0x110000, dtype=np.int32)
    for i in range(len(out)):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    out[0] = 0xFFFD
    return out


def compact(codes: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes met, in order, and the place of each code among them."""
    if space > 1 << 22:
        return np.unique(codes, return_inverse=True)
    met = np.flatnonzero(np.bincount(codes, minlength=space))
    rank = np.zeros(space, np.int64)
    rank[met] = np.arange(len(met))
    return met, rank[codes]


def block_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and last characters of the n-grams of texts, each once and in an order that
    does not depend on that of the texts; and the place in that list of each character of the
    texts in a row."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = _lower()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")]
    if not len(points):
        none = np.zeros(0, np.int64)
        return none, none, none
    alphabet, inner = compact(points, 0x110000)
    size = len(alphabet) + 1
    # each text after order - 1 boundaries
    seq = np.zeros(len(points) + (order - 1) * len(texts), np.int64)
    at = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), lengths)
    seq[at] = inner + 1
    met, place = compact(seq[at - order + 1], size)
    for k in range(order - 2, -1, -1):
        met, place = compact(place * size + seq[at - k], len(met) * size)
    first = np.zeros(len(met), np.int64)
    first[place] = np.arange(len(place))  # any place of each will do
    real = np.r_[0, alphabet].astype(np.int64)
    context = np.zeros(len(first), np.int64)
    for k in range(order - 1, 0, -1):
        context = context << POINT_BITS | real[seq[at[first] - k]]
    return context, real[seq[at[first]]], place


def blocks_of(docs: DataFrame, block: int) -> DataFrame:
    """The rows with a number of the block they are dealt to, written down."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in short(batches):
            numbers = []
            for n in pc.utf8_length(batch.column(1)).to_pylist():
                if held and held + (n or 0) > block:
                    number, held = number + 1, 0
                held += (n or 0) + 1
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["block", "doc_id", "text", "chosen"])

    return materialize(docs.mapInArrow(run, f"block long, doc_id {kind}, text string, chosen boolean"), "lm-blocks")


def block_counts(dealt: DataFrame, order: int) -> DataFrame:
    """(block, place, context, c, target, background): the n-grams of each block."""

    def count(table: pa.Table) -> pa.Table:
        texts = [t or "" for t in table.column("text").to_pylist()]
        chosen = np.array([bool(c) for c in table.column("chosen").to_pylist()], bool)
        context, last, place = block_grams(texts, order)
        flags = np.repeat(chosen, [len(t) for t in texts])
        background, target = np.bincount(place, minlength=len(last)), np.bincount(place[flags], minlength=len(last))
        block = np.full(len(last), table.column("block")[0].as_py(), np.int64)
        columns = [block, np.arange(len(last)), context, last, target.astype(np.int64), background.astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=["block", "place", "context", "c", "target", "background"])

    shape = "block long, place long, context long, c long, target long, background long"
    return materialize(dealt.groupBy("block").applyInArrow(count, shape), "lm-counts")


def gram_losses(grams: DataFrame, order: int, size: int | None, smoothing: float = SMOOTHING) -> DataFrame:
    """(context, c, target_loss, background_loss) of the n-grams: each level interpolated with the
    shorter contexts down to the uniform distribution over ``size`` symbols."""
    sides = ("target", "background")
    sums = [F.sum(s).alias(s) for s in sides]
    levels = [grams]
    for n in range(order - 1, 0, -1):
        context = F.col("context").bitwiseAND(F.lit((1 << POINT_BITS * (n - 1)) - 1)).alias("context")
        levels.append(levels[-1].groupBy(context, "c").agg(*sums))
    # one row: the characters met, and a boundary and one for what is never met
    symbols_met = size or levels[-1].count() + 2
    lower = None
    for n, level in enumerate(reversed(levels), 1):
        seen = level.groupBy("context").agg(*(F.sum(s).alias(f"{s}_seen") for s in sides))
        level = level.join(seen, "context")
        if lower is None:
            below = {s: F.lit(1.0 / symbols_met) for s in sides}
        else:
            level = level.withColumn("shorter", F.col("context").bitwiseAND(F.lit((1 << POINT_BITS * (n - 2)) - 1)))
            level = level.join(lower, ["shorter", "c"])
            below = {s: F.col(f"{s}_below") for s in sides}
        level = level.select("context", "c", *(((F.col(s) + smoothing * below[s]) / (F.col(f"{s}_seen") + smoothing)).alias(f"{s}_below") for s in sides))
        lower = level.withColumnRenamed("context", "shorter")
    return lower.select(F.col("shorter").alias("context"), "c", *((-F.ln(f"{s}_below")).alias(f"{s}_loss") for s in sides))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, order: int = ORDER, size: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, score.

    ``size`` is the number of symbols of the uniform distribution, by default all that are met;
    ``order`` is 4 at most."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    # merged, not broadcast, at every size, so that the plan does not change as the ids grow
    marked = docs.select("doc_id", "text").join(good.withColumn("chosen", F.lit(True)).hint("merge"), "doc_id", "left")
    dealt = blocks_of(marked, block)
    counts = block_counts(dealt, order)
    sums = [F.sum(s).alias(s) for s in ("target", "background")]
    grams = materialize(counts.groupBy("context", "c").agg(*sums), "lm-grams")
    losses = materialize(gram_losses(grams, order, size), "lm-losses")
    own = counts.select("block", "place", "context", "c").join(losses, ["context", "c"]).drop("context", "c")

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        ids, texts = texts.column("doc_id"), [t or "" for t in texts.column("text").to_pylist()]
        _, last, place = block_grams(texts, order)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        sums = []
        for side in ("target_loss", "background_loss"):
            loss = np.zeros(len(last))
            loss[own.column("place").to_numpy()] = own.column(side).to_numpy()
            sums.append(np.bincount(owner, weights=loss[place], minlength=len(texts)) / np.maximum(lengths, 1))
        return pa.table([ids, pa.array(lengths), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[1] - sums[0])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    shape = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return dealt.select("block", "doc_id", "text").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, shape)
