"""Token ids in a content-addressed store.

Each document's ids are cut into chunks where a rolling hash of the last ids says so, so
equal passages give equal chunks wherever they stand. A chunk is named by its SHA-256 and
stored once; a document is a recipe, the list of its chunk names, with the root of their
Merkle tree. Files, all Parquet (zstd) in the shared folder:

* ``kind=0`` (chunks): name, number of ids, payload (little-endian ids, 2 or 4 bytes each);
* ``kind=1`` (recipes): doc_id, number of ids, chunk names, Merkle root;
* the recipes again in ascending doc_id order, in parts that are ranges of (doc_id, root,
  row), with each document's place and first position in its part;
* a manifest: of each part its documents, its ids, the ids of all parts before it and the
  Merkle root over its recipes' roots; and one row, ``part`` -1, with the totals and the root
  over the parts' roots.

Reading checks all of it: each chunk against its name and size, each recipe against its root
and number of ids, each part and the whole against the manifest. Checksums come from the
payloads alone: chunk checksums are combined in order, so the ids of a document need not be
brought together.

Chunks that repeat within a task are dropped before the shuffle; each chunk name is owned by
one task, which keeps its first copy. Both kinds cross one shuffle. Nulls or an id that many
rows share are spread over parts by root and row.

Defined cases: null and empty texts are the end token alone; rows that repeat a doc_id each
get their place, ordered by root; a null doc_id comes first; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import materialize, short
from termloom.llm.tokenization import encoder, slices

MIN_CHUNK, MASK_BITS, MAX_CHUNK, ROLL = 64, 9, 8192, 8
#: Words whose ids a worker keeps, some 100 MB.
WORDS_KEPT = 500_000
#: Recipes under one inner node of a part's Merkle tree.
FANOUT = 1024
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
CRC_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32


def chunk_ends(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """Ends of the chunks of documents that follow each other in ``ids`` up to ``bounds``: where
    the hash of the last ROLL ids has MASK_BITS zero bits. The hash of a place that may end a
    chunk never reaches back beyond its document, as chunks are longer than ROLL."""
    gear = _GEAR[ids & 0xFFFF]
    rolled = gear.copy()
    for back in range(1, ROLL):
        rolled[back:] += gear[:-back] << np.uint64(back)
    marks = np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + 1
    split = np.searchsorted(marks, bounds, side="left").tolist()
    marks = marks.tolist()
    out, last, at = [], 0, 0
    for bound, upto in zip(bounds, split, strict=True):
        ends = []
        for mark in [*marks[at:upto], bound]:
            while mark - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if mark - last >= MIN_CHUNK or mark == bound and last < bound:
                ends.append(mark)
                last = mark
        out.append(ends)
        last, at = bound, upto
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 Merkle root; an odd node is carried up as it is, no leaves give the empty hash."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        paired = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two reflected CRC-32 polynomials."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


@functools.lru_cache(1 << 16)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, square = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, square)
        square = _times(square, square)
        n_bytes >>= 1
    return out


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from the CRC-32 of each."""
    return _times(_shift(second_bytes), first) ^ second


def write_store(docs: DataFrame, tokenizer_path: str, layout: str, end_id: int) -> DataFrame:
    """Write chunks and recipes; returns the table of both, split by ``kind``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("kind", pa.int32()), ("owner", pa.binary()), ("doc_id", None), ("row", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("width", pa.int32()), ("names", pa.list_(pa.binary())), ("root", pa.binary()), ("payload", pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = encoder(tokenizer_path, layout, WORDS_KEPT), set()
        sha, row = hashlib.sha256, TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            doc_ids = batch.column(0)
            found = tokens.encode(batch.column(1).to_pylist())
            end = np.array([end_id], tokens.kind)
            ids = np.concatenate([x for each in found for x in (each, end)])
            bounds = np.cumsum([len(x) + 1 for x in found]).tolist()
            width, raw = ids.itemsize, memoryview(ids.view(np.uint8))
            chunks: tuple[list, list, list] = ([], [], [])  # names, sizes, payloads
            recipes: tuple[list, list, list] = ([], [], [])  # sizes, names, roots
            last = 0
            for bound, ends in zip(bounds, chunk_ends(ids, bounds), strict=True):
                names, first = [], last
                for end_at in ends:
                    payload = raw[width * last : width * end_at]
                    name = sha(payload).digest()
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        for column, value in zip(chunks, (name, end_at - last, payload.tobytes()), strict=True):
                            column.append(value)
                    last = end_at
                for column, value in zip(recipes, (bound - first, names, merkle_root(names)), strict=True):
                    column.append(value)
            rows = [row + i for i in range(len(found))]
            row += len(found)
            owners = [sha(root + i.to_bytes(8, "little")).digest() for i, root in zip(rows, recipes[2], strict=True)]
            c, r = len(chunks[0]), len(rows)
            columns = [[0] * c + [1] * r, chunks[0] + owners, None, [None] * c + rows, chunks[1] + recipes[0], [width] * (c + r)]
            columns += [[None] * c + recipes[1], [None] * c + recipes[2], chunks[2] + [None] * r]
            arrays = [pa.concat_arrays([pa.nulls(c, doc_ids.type), doc_ids]) if name == "doc_id" else pa.array(x, t) for (name, t), x in zip(fields, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in short(batches):
            keep = []
            for what, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(what == 1 or name not in seen)
                if what == 0:
                    seen.add(name)
            yield batch.filter(pa.array(keep))

    shape = f"kind int, owner binary, doc_id {kind}, row long, n_tokens long, width int, names array<binary>, root binary, payload binary"
    rows = docs.select("doc_id", "text").mapInArrow(encode, shape)
    return materialize(rows.repartition("owner").mapInArrow(own, shape), "token-store", ["kind"], codec="zstd")


def _grouped_roots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, docs, root): Merkle roots of groups of at most FANOUT rows (at, n, docs, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            roots = [merkle_root([x["root"] for x in sorted(part, key=lambda x: x["at"])]) for part in batch.column("held").to_pylist()]
            columns = [batch.column(c) for c in (*keys, "n", "docs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(roots, pa.binary())], names=[*keys, "n", "docs", "root"])

    held = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("at", "root")).alias("held"))
    shape = ", ".join([*(f"{k} long" for k in keys), "n long, docs long, root binary"])
    return held.select(*keys, "n", "docs", "held").mapInArrow(run, shape)


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, n, docs, root) of the recipes' parts, by inner nodes of FANOUT recipes each."""
    at = F.col("place")
    leaf = recipes.select("part", F.floor(at / FANOUT).alias("node"), at.alias("at"), F.col("n_tokens").alias("n"), F.lit(1).cast("long").alias("docs"), "root")
    nodes = _grouped_roots(leaf, ["part", "node"])
    return _grouped_roots(nodes.withColumn("at", F.col("node")), ["part"])


def order_recipes(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipes in ascending doc_id order with their places in their parts, and the manifest."""
    kind = store.schema["doc_id"].dataType.simpleString()
    recipes = store.where("kind = 1").select("doc_id", "row", "n_tokens", "names", "root")
    order = [F.asc_nulls_first("doc_id"), F.asc("root"), F.asc("row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in short(batches):
            n = batch.column("n_tokens").to_numpy()
            starts = start + np.cumsum(n) - n
            added = [np.full(len(n), part, np.int64), np.arange(place, place + len(n)), starts]
            place, start = place + len(n), start + int(n.sum())
            names = ["doc_id", "n_tokens", "names", "root"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, added)], names=[*names, "part", "place", "part_start"])

    shape = f"doc_id {kind}, n_tokens long, names array<binary>, root binary, part long, place long, part_start long"
    parts = recipes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, shape)
    parts = materialize(parts, "token-recipes")
    # one row a part from here on, so window and list are as small as the list of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = materialize(part_roots(parts).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "token-parts")
    return parts, materialize(found.unionByName(_whole(found)), "token-manifest")


def _whole(parts: DataFrame) -> DataFrame:
    """The manifest's row for the whole store, from its rows for parts."""
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    total = (-1, sum(r["n"] for r in rows), sum(r["docs"] for r in rows), merkle_root([bytes(r["root"]) for r in rows]), 0)
    return parts.sparkSession.createDataFrame([total], parts.schema)


def verify_manifest(recipes: DataFrame, manifest: DataFrame) -> None:
    """Raise unless the recipes' parts, and the parts together, are what the manifest says."""
    listed = manifest.where("part >= 0")
    found, said = part_roots(recipes).alias("f"), listed.alias("s")
    same = (F.col("f.n") == F.col("s.n")) & (F.col("f.docs") == F.col("s.docs")) & (F.col("f.root") == F.col("s.root"))
    wrong = found.join(said, F.col("f.part") == F.col("s.part"), "full").where(~F.coalesce(same, F.lit(False)))
    if (row := wrong.select(F.coalesce("f.part", "s.part").alias("part")).first()) is not None:
        raise ValueError(f"part {row['part']} of the recipes is not what the manifest says")
    if manifest.where("part < 0").collect() != _whole(listed).collect():
        raise ValueError("the manifest's parts do not hash to its root")


def read_store(store: DataFrame, recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per recipe, from the files: doc_id, start, n_tokens, ids_crc32, chunks.

    Raises when a chunk does not hash to its name, a chunk is missing, a recipe does not hash
    to its root or has another number of ids, or parts are not what the manifest says."""
    kind = recipes.schema["doc_id"].dataType.simpleString()
    verify_manifest(recipes, manifest)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            crcs = []
            for name, n, width, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(payload).digest() != name or len(payload) != n * width:
                    raise ValueError(f"chunk {name.hex()} does not hash to its name")
                crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), batch.column(1)], names=["name", "crc", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            crcs = []
            for root, said, chunks in zip(*(batch.column(c).to_pylist() for c in ("root", "n_tokens", "chunks")), strict=True):
                chunks.sort(key=lambda c: c["k"])
                if merkle_root([c["name"] for c in chunks]) != root or sum(c["n"] for c in chunks) != said:
                    raise ValueError(f"recipe {root.hex()} does not hash to its root")
                crc = 0
                for c in chunks:
                    crc = crc_join(crc, c["crc"], 4 * c["n"])
                crcs.append(crc)
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = store.where("kind = 0").select(F.col("owner").alias("name"), "n_tokens", "width", "payload")
    known = materialize(chunks.mapInArrow(check, "name binary, crc long, n long"), "token-chunks")
    placed = recipes.join(manifest.where("part >= 0").select("part", "base"), "part").withColumn("start", F.col("base") + F.col("part_start"))
    used = placed.select("doc_id", "start", "n_tokens", "root", F.posexplode("names").alias("k", "name")).join(known, "name", "left")
    used = used.withColumn("crc", F.when(F.col("crc").isNull(), F.raise_error(F.lit("a chunk is missing"))).otherwise(F.col("crc")))
    whole = used.groupBy("start", "doc_id", "n_tokens", "root").agg(F.collect_list(F.struct("k", "name", "crc", "n")).alias("chunks"))
    return whole.mapInArrow(build, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer_path: str, layout: str, end_id: int) -> DataFrame:
    store = write_store(docs, tokenizer_path, layout, end_id)
    recipes, manifest = order_recipes(store)
    return read_store(store, recipes, manifest)
