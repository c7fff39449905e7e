"""Shared plumbing of the text operators: packed exchanges, bitmaps, components.

A *packed exchange* moves numpy records between map tasks and hash blocks: a
map task turns its rows into structured records, sorts them by block and emits
one binary row for each block, so a shuffled row holds thousands of records and
the JVM never sees them one by one.  Before records leave a map task they are
combined (duplicates inside the task are settled there), which keeps a value
that is in a third of all rows from filling one block.
"""

from __future__ import annotations

import gc
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textcore as tc

PACKED = "block int, kind int, payload binary"
PACKED_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Text bytes whose records meet in one block, at least and at most: in between they grow with the square root of the input,
#: and so does what a map task gathers before it sends records, so a packed row holds several records at any size.
BLOCK_BYTES, MOST_BLOCK_BYTES = 12 << 20, 96 << 20
FLUSH_BYTES, MOST_FLUSH_BYTES = 8 << 20, 64 << 20
#: Rows and bytes in a batch for Python.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20
#: Edges that one task of components() holds at once (16 bytes each).
TASK_EDGES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, or on one machine, where none is set, one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Frees the shuffle files of what is written down by now.

    Spark's cleaner deletes the files of a shuffle when the driver has collected its last reference, which on a driver
    with little to do can take until long after the next shuffle has filled the disks.  Call it after a checkpoint
    of something large, with no variable left that holds what came before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """df, after limiting the rows and bytes that its session hands to Python at once: ten thousand texts, Spark's default, take
    much memory.  The limits are session settings, as plans read them when they run; ones that are lower already stay."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(name, str(most))).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def unused(names: list[str], name: str) -> str:
    """A column name that is not among names."""
    while name.lower() in {n.lower() for n in names}:
        name = f"_{name}"
    return name


def sheltered(df: DataFrame, inner: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with those of its columns renamed that have a name of inner ones, and how to name them back."""
    clash = {n.lower() for n in inner}
    new = {}
    for n in df.columns:
        if n.lower() in clash:
            new[n] = unused([*df.columns, *inner, *new.values()], n)
    return df.withColumnsRenamed(new), {b: a for a, b in new.items()}


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for all that use it; a plain column would be computed again in every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def row_key() -> Column:
    """A hash of a document's id and text.  Rows are told apart by (doc_id, row_key): the hash alone would not do for
    a table of many billions."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, text) of documents: rows equal in id and text share a key, and so a result."""
    return small_batches(docs).select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)


def blocks_for(spark: SparkSession, total: int) -> int:
    """Blocks for an exchange: by the text's bytes, and at least the session's shuffle partitions."""
    size = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, 10 * math.isqrt(total)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // size + 1)


def block_count(docs: DataFrame) -> int:
    return blocks_for(docs.sparkSession, text_bytes(docs))


def flush_bytes(blocks: int) -> int:
    """Text bytes that a map task gathers for so many blocks."""
    return min(MOST_FLUSH_BYTES, max(FLUSH_BYTES, 64 * blocks))


def pack(blocks: np.ndarray, kind: int, records: np.ndarray) -> pa.RecordBatch | None:
    """One row for each block that has records."""
    if not len(records):
        return None
    order = np.argsort(blocks, kind="stable")
    blocks, records = blocks[order], records[order]
    cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    offsets = np.append(cuts, len(records)) * records.dtype.itemsize
    payload = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(records).view(np.uint8).data)])
    return pa.RecordBatch.from_arrays([pa.array(blocks[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int32()), payload], schema=PACKED_ARROW)


def unpack(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    """All records of one kind in a block."""
    chosen = table.column("payload").filter(pc.equal(table.column("kind"), kind))
    data, _ = tc.buffers(chosen)
    return np.frombuffer(data.tobytes(), dtype=dtype)


def pack_runs(run_blocks: np.ndarray, runs: np.ndarray, blocks: np.ndarray, items: np.ndarray) -> pa.RecordBatch | None:
    """One row of kind 0 for each block: how many runs, the runs' records, then their items.  Both are sorted by block, and the
    items by run: apart, the two halves compress better than one record for each item would."""
    if not len(runs):
        return None
    cuts = np.append(np.flatnonzero(np.append(True, run_blocks[1:] != run_blocks[:-1])), len(runs))
    payload = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low, high = np.searchsorted(blocks, run_blocks[a]), np.searchsorted(blocks, run_blocks[a], side="right")
        payload.append(np.int64(b - a).tobytes() + runs[a:b].tobytes() + items[low:high].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(run_blocks[cuts[:-1]], pa.int32()), pa.array(np.zeros(len(payload), np.int32)), pa.array(payload, pa.binary())], schema=PACKED_ARROW)


def unpack_runs(table: pa.Table, run: np.dtype, item: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All runs and all items of kind 0 in a block, in step."""
    runs, items = [np.zeros(0, run)], [np.zeros(0, item)]
    for payload in table.column("payload").filter(pc.equal(table.column("kind"), 0)).to_pylist():
        n = int(np.frombuffer(payload, np.int64, 1)[0])
        runs.append(np.frombuffer(payload, run, n, 8))
        items.append(np.frombuffer(payload, item, -1, 8 + n * run.itemsize))
    return np.concatenate(runs), np.concatenate(items)


def map_flushed(per_chunk: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, int, int], object], flush: Callable[[list], list], blocks: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: works on chunks of whole documents and flushes what they gave, for so many blocks.

    per_chunk(batch, data, offsets, first, last) handles documents first..last of a batch, whose text bytes are data;
    flush(parts) makes record batches of what some chunks gave.
    """

    most = flush_bytes(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                parts.append(per_chunk(batch, data[own[0] : own[-1]], own - own[0], first, last))
                held += int(own[-1] - own[0]) + 1
                if held >= most:
                    yield from (x for x in flush(parts) if x is not None)
                    parts, held = [], 0
        if parts:
            yield from (x for x in flush(parts) if x is not None)

    return run


def int64s(column: pa.Array, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


class Bitmap:
    """A set of 64-bit hashes as a bitmap of fixed size: no false negatives; false positives only cost work."""

    def __init__(self, bits: np.ndarray, log2: int) -> None:
        self.bits, self.log2 = bits, log2

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & np.uint64((1 << self.log2) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(df: DataFrame, column: str, rows: int | None = None, most: int = 27) -> Bitmap:
    """Bitmap of a long column, made by executors; at most 2**most bits (16 MiB) reach the driver, whatever the input."""
    n = df.count() if rows is None else rows
    log2 = min(most, max(23, int(n).bit_length() + 8))
    at = (F.col(column).bitwiseAND(F.lit((1 << log2) - 1)) + 1).alias("at")
    made = df.select(at).groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("m"))
    bits = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for row in made.collect():  # 2**most bits at most
        part = np.frombuffer(bytes(row["m"]), dtype=np.uint8)[: len(bits)]
        bits[(row["b"] - 1) * 4096 : (row["b"] - 1) * 4096 + len(part)] = part
    return Bitmap(bits, log2)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of the undirected edges (a, b); a root is the smallest node that can be reached."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        px, py = parent[x], parent[y]
        apart = px != py
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        up = parent[parent]
        while (up != parent).any():
            parent, up = up, up[up]
    return nodes, nodes[parent]


def contracted(roots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: of each TASK_EDGES edges a star for each component; with roots, an edge of each root to itself too."""

    def settle(held: list) -> pa.RecordBatch:
        node, root = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
        if not roots:
            node, root = node[node != root], root[node != root]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > TASK_EDGES:
                yield settle(held)
                held, n = [], 0
        if n:
            yield settle(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the component's smallest node.  Nodes should be hashes.

    Every task contracts the edges it has to stars.  A node that is the centre of no task's star is settled by the smallest
    of its centres, which it ties together; what is left are edges between centres, many fewer, and they are contracted
    again, until what is left fits into one task.  No neighbour list is ever collected: a node has one centre for
    each task at most.
    """
    now, settled = checkpoint(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")), []
    n = now.count()
    while n > TASK_EDGES:
        stars = now.coalesce(n // TASK_EDGES + 1).mapInArrow(contracted(False), "a long, b long")
        seen = stars.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("root")))).alias("s")).select("s.*")
        seen = checkpoint(seen.groupBy("node").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"), F.max(F.col("root").isNull()).alias("centre")).filter("m IS NOT NULL"))
        settled.append(seen.filter("NOT centre").select("node", "m"))
        left = seen.select(F.explode("roots").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(seen.filter("centre").select(F.col("node").alias("a"), F.col("m").alias("b")))
        now = checkpoint(left)
        n = now.count()
    found = checkpoint(now.coalesce(1).mapInArrow(contracted(True), "a long, b long").toDF("node", "root"))
    for level in reversed(settled):
        up = checkpoint(level.join(found.withColumnRenamed("node", "m"), "m", "left").select("node", "m", "root"))
        found = found.unionByName(up.select("node", F.coalesce("root", "m").alias("root"))).unionByName(up.filter("root IS NULL").select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
    return found


def read_docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
