"""N-gram Jaccard join: connected components of documents with similar shingle sets.

The document by shingle incidence matrix is multiplied with its transpose in blocks, and overlap counts below the
bounds that the set sizes imply are never formed:

1. Every set gets a signature; equal sets are one row of the matrix from here on.
2. Columns are dealt into hash blocks.  A block finds which shingles are in two sets at least, and every set counts
   its shared shingles.  A link needs ``100 * overlap >= percent * union >= percent * own size``, so a set whose
   count of shared shingles is lower can have no link and leaves.
3. Of the sets that stay, shingles are ordered by rarity; a linked pair has a shingle of both prefixes
   (size - ceil(percent * size / 100) + 1 long) in common.  Such shingles tie sets together, and the ties' components are
   the row groups.  Links never cross row groups.
4. In each row group overlap counts are accumulated through the column lists, pairs below
   ``percent / (100 + percent) * (size + size)`` are discarded, and links between rows that are already connected are not
   looked for again; no list of pairs is emitted, only spanning links.
5. A row group beyond ROW_BLOCK is cut into row blocks by size class (linked sets are in the same or in neighbouring
   classes) and within a class by hash.  Each block is multiplied with itself; what that links is one part from then on.
   Rows outside of their group's largest part are then multiplied, block by block, with all rows of other parts in the
   same and the neighbouring classes.  Rows of the largest part never meet again, so a large group of near copies, which
   its blocks link almost whole, costs its own size and not the square of it.

Every step is exact but for hashes: sets, shingles and rows are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as ex
from plumbline.llm import textcore as tc

#: Sets that meet in one task of the product; larger row groups are cut into blocks.
ROW_BLOCK = 1500
#: Larger row groups up to which tables of them (a row for each size class at most) are broadcast; beyond, they are joined with a shuffle.
BROADCAST_GROUPS = 1_000
SHARED = np.dtype([("sig", "<i8"), ("n", "<i4")])
#: A set's shingles in a block: how many, then 32 bits of each.
SEEN = np.dtype([("sig", "<i8"), ("n", "<i4")])


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One signed 64-bit signature of each set; 0 stands for the empty set."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(tc.mix64(hashes), out=sums[1:])
        sig = tc.mix64(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))
    sig[sig == 0] = 1
    sig[np.diff(offsets) == 0] = 0
    return sig.view(np.int64)


#: (bytes, offsets) -> (hashes, n + 1 offsets): the sets of some documents, ascending.
SetsOf = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_shingles(k: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tc.Words(data, offsets, tc.NON_SPACE).shingle_sets(k)


def _sets(sets_of: SetsOf, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, cuts = sets_of(data, offsets)
    return hashes, cuts, _signatures(hashes, cuts)


def signed_sets(docs: DataFrame, sets_of: SetsOf) -> DataFrame:
    """(row_key, doc_id, n_shingles, sig) of every row."""
    out = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            n, sig = [], []
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                _, cuts, s = _sets(sets_of, data[own[0] : own[-1]], own - own[0])
                n.append(np.diff(cuts))
                sig.append(s)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(sig), pa.int64())], schema=out)

    return docs.mapInArrow(run, "row_key long, doc_id long, n_shingles long, sig long")


def _shared_counts(docs: DataFrame, sets_of: SetsOf, blocks: int) -> DataFrame:
    """(sig, shared): an upper bound of how many of a set's shingles are in another set as well."""

    def per_chunk(batch, data, offsets, first, last):  # noqa: ANN001, ANN202
        hashes, cuts, sig = _sets(sets_of, data, offsets)
        return hashes, np.repeat(sig, np.diff(cuts))

    def flush(parts: list) -> list:
        h, sig = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((sig, h))
        h, sig = h[order], sig[order]
        if not len(h):
            return []
        keep = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
        h, sig = h[keep], sig[keep]
        head = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(head) - 1
        several = np.bincount(group)[group] > 1
        own, n = np.unique(sig[several], return_counts=True)
        settled = np.zeros(len(own), dtype=SHARED)
        settled["sig"], settled["n"] = own, n
        asked = head | ~several
        sent, owner = (h[asked] >> np.uint64(32)).astype("<u4"), np.where(several[asked], 0, sig[asked])
        at = ((h[asked] & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((sent, owner, at))
        sent, owner, at = sent[order], owner[order], at[order]
        run = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])))
        owners = np.zeros(len(run), dtype=SEEN)
        owners["sig"], owners["n"] = owner[run], np.diff(np.append(run, len(owner)))
        return [ex.pack_runs(at[run], owners, at, sent), ex.pack((own % blocks).astype(np.int32), 1, settled)]

    def at_block(table: pa.Table) -> pa.Table:
        owners, h = ex.unpack_runs(table, SEEN, np.dtype("<u4"))
        sig, settled = np.repeat(owners["sig"], owners["n"]), ex.unpack(table, 1, SHARED)
        order = np.lexsort((sig, h))
        h, sig = h[order], sig[order]
        if len(h):
            keep = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
            h, sig = h[keep], sig[keep]
            group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            shared = (np.bincount(group) > 1) | (np.bincount(group, weights=sig == 0) > 0)
            sig = sig[shared[group] & (sig != 0)]
        own, n = np.unique(sig, return_counts=True)
        told = np.zeros(len(own), dtype=SHARED)
        told["sig"], told["n"] = own, n
        told = np.concatenate([told, settled])
        batch = ex.pack((told["sig"] % blocks).astype(np.int32), 0, told)
        return pa.Table.from_batches([batch] if batch else [], schema=ex.PACKED_ARROW)

    def total(table: pa.Table) -> pa.Table:
        told = ex.unpack(table, 0, SHARED)
        own, inverse = np.unique(told["sig"], return_inverse=True)
        n = np.bincount(inverse, weights=told["n"], minlength=len(own)).astype(np.int64)
        return pa.table({"sig": pa.array(own, pa.int64()), "shared": pa.array(n, pa.int64())})

    sent = docs.mapInArrow(ex.map_flushed(per_chunk, flush, blocks), ex.PACKED)
    return sent.groupBy("block").applyInArrow(at_block, ex.PACKED).groupBy("block").applyInArrow(total, "sig long, shared long")


def _sets_of(docs: DataFrame, sets_of: SetsOf, wanted: DataFrame) -> DataFrame:
    """(sig, n, h array) of the wanted (row_key, sig, n): a bitmap of their keys picks rows in the scan, a join settles it."""
    chosen = docs.sparkSession.sparkContext.broadcast(ex.bitmap(wanted, "row_key"))
    out = pa.schema([("sig", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            batch = batch.filter(pa.array(chosen.value.may_have(ex.int64s(batch.column("row_key"), 0))))
            data, offsets = tc.buffers(batch.column("text"))
            for first, last in tc.chunks(offsets):
                own = offsets[first : last + 1]
                hashes, cuts, sig = _sets(sets_of, data[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))], schema=out)

    found = docs.mapInArrow(run, "sig long, h array<long>")
    return found.join(wanted.select("sig", "n"), "sig").dropDuplicates(["sig"]).select("sig", "n", "h")


TIE = np.dtype([("a", "<i8"), ("b", "<i8")])


def _ties(sets: DataFrame, percent: int, blocks: int, length_partitions: bool) -> DataFrame:
    """(a, b): edges that tie all sets together that have a shingle of both necessary prefixes in common.

    A prefix has the rarest shingles of a set, without those no other set has.  A task ties the sets it has itself, and
    says of each shingle only which of its parts has it: a shingle of a million sets comes once from each task.
    """
    tokens = sets.select("sig", "n", F.explode("h").alias("h"))
    rarity = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = tokens.join(rarity, "h").withColumn("block", F.pmod("sig", F.lit(blocks)))

    def choose(table: pa.Table) -> pa.Table:
        sig, n, df, h = (table.column(c).to_numpy() for c in ("sig", "n", "df", "h"))
        order = np.lexsort((h, df, sig))
        sig, n, h = sig[order], n[order], h[order]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, int)
        size = np.diff(np.append(head, len(sig)))
        place = np.arange(len(sig)) - np.repeat(head, size)
        alone = n - np.repeat(size, size)  # shingles of this set only come first in the order
        keep = place + alone < n + (-percent * n) // 100 + 1
        sig, n, h = sig[keep], n[keep], h[keep]
        if length_partitions:
            part = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.uint64)
            h = np.concatenate([tc.mix64(h.view(np.uint64) ^ tc.mix64(part + np.uint64(i + 1))) for i in (0, 1)]).view(np.int64)
            sig = np.append(sig, sig)
        if not len(sig):
            return pa.Table.from_batches([], schema=ex.PACKED_ARROW)
        order = np.argsort(h, kind="stable")
        sig, h = sig[order], h[order]
        head = np.append(True, h[1:] != h[:-1])
        hub = sig[head][np.cumsum(head) - 1]
        node, root = ex.forest(sig, hub)
        star, has = np.zeros(int((node != root).sum()), TIE), np.zeros(int(head.sum()), TIE)
        star["a"], star["b"] = node[node != root], root[node != root]
        has["a"], has["b"] = h[head], root[np.searchsorted(node, sig[head])]
        made = [ex.pack((x["a"] % blocks).astype(np.int32), kind, x) for kind, x in ((0, star), (1, has))]
        return pa.Table.from_batches([m for m in made if m is not None], schema=ex.PACKED_ARROW)

    def tie(table: pa.Table) -> pa.Table:
        star, has = (ex.unpack(table, kind, TIE) for kind in (0, 1))
        has = has[np.argsort(has["a"], kind="stable")]
        head = np.append(True, has["a"][1:] != has["a"][:-1]) if len(has) else np.zeros(0, bool)
        hub = has["b"][head][np.cumsum(head) - 1]
        node, root = ex.forest(np.append(star["a"], has["b"]), np.append(star["b"], hub))
        return pa.table({"a": node[node != root], "b": root[node != root]})

    return known.groupBy("block").applyInArrow(choose, ex.PACKED).groupBy("block").applyInArrow(tie, "a long, b long")


def spanning_links(sig: np.ndarray, group: np.ndarray, cuts: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) that connect what all links between these sets connect.

    A breadth-first search over the rows of the product: a popped row's overlaps with rows not reached yet are
    counted through the column lists, which are cut down to such rows whenever half of them are gone.
    """
    k = len(sig)
    size = np.diff(cuts)
    _, column = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(k), size)
    weight = np.bincount(row, weights=np.bincount(column)[column], minlength=k) / np.maximum(size, 1)
    waiting = np.ones(k, dtype=bool)
    _, group = np.unique(group, return_inverse=True)
    left = np.bincount(group)
    lists: dict = {}

    def rebuild() -> None:
        live = waiting[row]
        order = np.argsort(column[live], kind="stable")
        lists["rows"], lists["at"] = row[live][order], np.searchsorted(column[live][order], np.arange(len(np.bincount(column)) + 1))
        lists["n"] = int(waiting.sum())

    rebuild()
    a, b = [], []
    for start in np.argsort(-weight, kind="stable"):
        if not waiting[start]:
            continue
        waiting[start] = False
        left[group[start]] -= 1
        stack = [start]
        while stack:
            x = stack.pop()
            if not left[group[x]]:
                continue
            own = column[cuts[x] : cuts[x + 1]]
            low, high = lists["at"][own], lists["at"][own + 1]
            length = high - low
            met = lists["rows"][np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())]
            met = met[waiting[met]]
            if not len(met):
                continue
            found, overlap = np.unique(met, return_counts=True)
            found = found[100 * overlap >= percent * (size[x] + size[found] - overlap)]
            if len(found):
                waiting[found] = False
                left -= np.bincount(group[found], minlength=len(left))
                a.append(np.full(len(found), x))
                b.append(found)
                stack.extend(found)
                if 2 * int(waiting.sum()) < lists["n"]:
                    rebuild()
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def crossing_links(sig: np.ndarray, side: np.ndarray, label: np.ndarray, cuts: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) that connect what all links between rows of side 0 and of side 1 (without any: of side 0) with
    different labels connect, when rows with the same label are connected already."""
    size = np.diff(cuts)
    _, column = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(len(sig)), size)
    to = 1 if (side == 1).any() else 0
    met = side[row] == to
    order = np.argsort(column[met], kind="stable")
    rows, at = row[met][order], np.searchsorted(column[met][order], np.arange(column.max(initial=-1) + 2))
    _, label = np.unique(label, return_inverse=True)
    a, b = [], []
    for x in np.flatnonzero(side == 0).tolist():
        own = column[cuts[x] : cuts[x + 1]]
        low, length = at[own], at[own + 1] - at[own]
        seen = rows[np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())]
        seen = seen[label[seen] != label[x]]
        if not len(seen):
            continue
        found, overlap = np.unique(seen, return_counts=True)
        found = found[100 * overlap >= percent * (size[x] + size[found] - overlap)]
        for other in np.unique(label[found]).tolist():
            a.append(x)
            b.append(int(found[label[found] == other][0]))
        label[np.isin(label, label[found])] = label[x]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = table.column("h").combine_chunks()
    return table.column("sig").to_numpy(), np.append(0, np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64), h.flatten().to_numpy()


def _linked(sets: DataFrame, groups: DataFrame, percent: int, blocks: int) -> DataFrame:
    """(node, root) of the components of all links; groups has (node, root) of the row groups."""
    # by size class, so a group's sets beyond ROW_BLOCK are counted class by class
    size_class = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    large = ex.checkpoint(groups.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > ROW_BLOCK).select("root"))
    n_large = large.count()
    some_large, small = n_large > 0, F.broadcast if n_large <= BROADCAST_GROUPS else lambda df: df
    rows = groups.select(F.col("node").alias("sig"), "root")
    whole = rows.join(small(large), "root", "left_anti") if some_large else rows
    dealt = whole.select("sig", "root", F.pmod(F.xxhash64("root"), F.lit(4 * blocks)).alias("task"))
    if some_large:
        rows = ex.checkpoint(rows.join(small(large), "root", "left_semi").join(sets.select("sig", "n"), "sig").select("sig", "root", size_class.alias("class")))
        parts = rows.groupBy("root", "class").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("parts"))
        cut = rows.join(small(parts), ["root", "class"])
        dealt = dealt.unionByName(cut.select("sig", "root", F.xxhash64("root", "class", F.pmod(F.xxhash64("sig"), F.col("parts"))).alias("task")))

    def product(table: pa.Table) -> pa.Table:
        sig, cuts, tokens = _matrix(table)
        a, b = spanning_links(sig, table.column("root").to_numpy(), cuts, tokens, percent)
        return pa.table({"a": sig[a], "b": sig[b]})

    inner = ex.components(dealt.join(sets, "sig").groupBy("task").applyInArrow(product, "a long, b long"))
    if not some_large:
        return inner
    named = rows.join(inner.select(F.col("node").alias("sig"), F.col("root").alias("part")), "sig", "left").withColumn("part", F.coalesce("part", "sig"))
    largest = named.groupBy("root", "part").agg(F.count("*").alias("k")).groupBy("root").agg(F.max_by("part", F.struct("k", "part")).alias("largest"))
    named = ex.checkpoint(named.join(small(largest), "root").select("sig", "root", "class", "part", (F.col("part") != F.col("largest")).cast("int").alias("minor")))
    units = named.groupBy("root", "class", "minor").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("units"))
    each = ex.checkpoint(units.withColumn("unit", F.explode(F.expr("sequence(0, units - 1)"))))
    u = each.filter("minor = 1").select("root", F.col("class").alias("u_class"), F.col("unit").alias("u"))
    v = each.select("root", "class", "minor", "unit")
    near = (F.abs(F.col("class") - F.col("u_class")) <= 1) & ((F.col("minor") == 0) | (F.struct("class", "unit") >= F.struct(F.col("u_class").alias("class"), F.col("u").alias("unit"))))
    pairs = u.join(small(v), "root").filter(near).withColumn("task", F.xxhash64("root", "u_class", "u", "class", "minor", "unit"))
    if not pairs.take(1):
        return inner
    sides = F.array(F.struct(F.col("u_class").alias("class"), F.lit(1).alias("minor"), F.col("u").alias("unit"), F.lit(0).alias("side")), F.struct("class", "minor", "unit", F.lit(1).alias("side")))
    same = (F.col("minor") == 1) & (F.col("class") == F.col("u_class")) & (F.col("unit") == F.col("u"))
    asked = pairs.select("root", "task", F.explode(F.when(same, F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("root", "task", "s.*")
    placed = named.join(small(units), ["root", "class", "minor"]).withColumn("unit", F.pmod(F.xxhash64("sig"), F.col("units")).cast("int")).drop("units")
    met = placed.join(asked, ["root", "class", "minor", "unit"]).select("sig", "part", "side", "task")

    def crossing(table: pa.Table) -> pa.Table:
        sig, cuts, tokens = _matrix(table)
        a, b = crossing_links(sig, table.column("side").to_numpy(), table.column("part").to_numpy(), cuts, tokens, percent)
        return pa.table({"a": sig[a], "b": sig[b]})

    outer = met.join(sets, "sig").groupBy("task").applyInArrow(crossing, "a long, b long")
    return ex.components(outer.unionByName(inner.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, n_in_component, component_key) for every row of documents.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A row's set is its distinct k-word shingles;
    with fewer words, the whole sequence; without words or text (null, empty, white space), empty.  Two rows are
    linked when ``100 * intersection >= percent * union``; component_id is the smallest doc_id reachable, the row's
    own included; component_key tells components apart also where ids are null.  Empty sets link with nothing: their component is themselves.  Rows equal in id and text get equal
    results, each its own row.  A null doc_id takes part and is never a component's name unless all its ids are null.
    Extra columns are ignored.
    """
    return components_of(docs, partial(word_shingles, k), percent)


def components_of(docs: DataFrame, sets_of: SetsOf, percent: int, length_partitions: bool = False) -> DataFrame:
    """similar_components() of any sets.

    With length_partitions, sets are also partitioned by length: a partition ends where its sizes exceed those at its
    beginning by 100 / percent, and a set is in its own and the next partition, so only linkable sizes meet.
    """
    rows = ex.keyed(docs)
    blocks = ex.block_count(rows)
    signed = ex.checkpoint(signed_sets(rows, sets_of))
    classes = signed.filter("n_shingles > 0").groupBy("sig").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.count("*").alias("rows"))
    enough = ex.checkpoint(classes.join(_shared_counts(rows, sets_of, blocks), "sig").filter(f"100 * shared >= {percent} * n").select("row_key", "sig", "n"))
    ex.let_go(docs.sparkSession)
    sets = ex.checkpoint(_sets_of(rows, sets_of, enough))
    groups = ex.components(_ties(sets, percent, blocks, length_partitions))
    ex.let_go(docs.sparkSession)
    found = _linked(sets, groups, percent, blocks)
    named = found.join(classes.select(F.col("sig").alias("node"), "least_id", "rows"), "node")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("rows").alias("members"))
    names = named.select("node", "root").join(names, "root").select(F.col("node").alias("sig"), "component_id", "members", F.col("root").alias("component_key"))
    alone = classes.select("sig", "least_id", "rows").join(names, "sig", "left").select("sig", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("members", "rows").alias("n_in_component"), F.coalesce("component_key", "sig").alias("component_key"))
    return signed.join(alone, "sig", "left").select("row_key", "doc_id", "n_shingles", F.when(F.col("sig") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_in_component", F.lit(1)).alias("n_in_component"), F.coalesce("component_key", "row_key").alias("component_key"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component of similar rows: the one with the smallest doc_id (then hash of id
    and text).  Rows that are like no other, those with empty sets included, stay as they are."""
    crowd = ex.checkpoint(similar_components(docs, k, percent).filter("n_in_component > 1 AND n_shingles > 0").select("row_key", "doc_id", "component_key"))
    key, doc, stays = (ex.unused(docs.columns, n) for n in ("row_key", "doc_id", "stays"))
    first = crowd.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("f")).select(F.col("f.row_key").alias("k"), F.col("f.doc_id").alias("d"), F.lit(True).alias("first"))
    members = crowd.select("row_key", "doc_id").distinct()
    marked = members.join(first, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(F.col("row_key").alias(key), F.col("doc_id").alias(doc), F.coalesce("first", F.lit(False)).alias(stays))
    each = docs.join(marked, (ex.row_key() == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    others, chosen = each.filter(F.col(stays).isNull()), each.filter(F.col(stays)).dropDuplicates([key, doc])
    return others.unionByName(chosen).drop(key, doc, stays)
