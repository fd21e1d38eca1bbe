"""Near-duplicate documents: an exact Jaccard join of word n-gram sets.

The document by n-gram incidence matrix is multiplied with its transpose in blocks of columns, over
the columns that can still decide a pair:

1. Documents with equal sets become one row of the matrix.
2. Equal minima under a few hash functions suggest groups of near copies. Within a group the product is
   computed in tiles of whole sets, and a tile returns a spanning forest of its links and each set's number of
   links, so a large group costs no row per pair. This step decides no pair of different groups.
3. Columns are ordered by rarity. Two sets that link share one of their rarest
   ``n - ceil(t * n) + 1`` columns, so only these entries are dealt to column blocks. Each block
   counts shared entries of pairs from different groups, the counts are summed over the
   blocks, and a pair goes where count plus all that lies outside the shorter prefix stays
   below the overlap that the two sizes ask for.
4. What is left is verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.components import components
from rainweave.llm.words import SPACED, Words, mix, sequence_hashes, text_slices, words_of
from rainweave.session import checkpointed

KEYS = 12  # minima that suggest groups of near copies
AGREE = 4  # of these minima lead to the head of a group; one shared passage seldom does that
TILE_ROWS = 512  # sets in a block of a group
TILE_COLUMNS = 2048  # columns multiplied at a time
SKETCH_BITS = 20  # size of the count sketch that orders the columns: one byte a bucket in every task
SKETCH_CHUNK = 1024
FILTER_BITS = 23  # size of the filter that saves reading sets of documents without candidates
BLOCK_ENTRIES = 2_000_000
LEAST_BLOCKS = 6
PAIR_CHUNK = 500_000
HEAD = np.dtype([("node", "<i8"), ("n", "<i4"), ("end", "<u2")])  # of a set in a block; ``end`` keeps the leading bits of the order


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, ascending, and where each text begins."""
    texts, first = words.texts(), words.first
    length = np.diff(first)
    count = np.where(length >= size, length - size + 1, (length > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    runs = sequence_hashes(words.hashes, size)
    values = np.zeros(begin[-1], dtype=np.uint64)
    for i in np.flatnonzero(length):
        a, b = begin[i], begin[i + 1]
        if length[i] >= size:
            values[a:b] = runs[first[i]:first[i] + count[i]]
            values[a:b].sort()
        else:
            values[a] = sequence_hashes(words.hashes[first[i]:first[i + 1]], int(length[i]))[0]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[begin[:-1][count > 0]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[begin]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for rows, data, offsets in text_slices(batch.column(1)):
        values, begin = shingle_sets(words_of(rows, data, offsets, SPACED), size)
        yield batch.column(0).slice(rows.start, rows.stop - rows.start), values, begin


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _per_text(values: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]


SIGNATURE = ["id", "n", "same", "minima", "chunk", "sketch"]


def _digests(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return _binary([hashlib.blake2b(x, digest_size=16).digest() for x in _per_text(values, begin)])


def _signatures(size: int):
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for ids, values, begin in _sets(batch, size):
                sketch += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                n = np.diff(begin)
                minima = np.zeros((len(ids), KEYS), dtype=np.int64)
                full = np.flatnonzero(n)
                for k in range(KEYS):
                    if len(full):
                        minima[full, k] = np.minimum.reduceat(mix(values ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)), begin[:-1][full]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), _digests(values, begin), pa.array(list(minima), pa.list_(pa.int64())), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())],
                    SIGNATURE,
                )
        chunks = np.minimum(sketch, 65535).astype(np.uint16).reshape(-1, SKETCH_CHUNK)
        none = [pa.nulls(len(chunks), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(len(chunks)), pa.int32()), _binary([c.tobytes() for c in chunks])], SIGNATURE)

    return run


def _summed(batches):
    """Sums of the tasks' sketches by chunk, as a stream."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint16).astype(np.int64)
    rarity = [np.minimum(255, np.floor(6 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _binary(rarity)], ["chunk", "rarity"])


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes that links them."""
    return -(-percent * (n + m) // (100 + percent))


def _prefixes(size: int, percent: int, rarity: np.ndarray):
    """Each set's rarest columns, as many as a link must meet, and the order of the last one."""

    def run(batches):
        for batch in batches:
            for ids, values, begin in _sets(batch, size):
                order = (rarity[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
                parts, ends = [], np.zeros(len(ids), dtype=np.int64)
                n = np.diff(begin)
                keep = n - -(-percent * n // 100) + 1
                for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
                    if a == b:
                        parts.append(b"")
                        continue
                    # equal orders of different columns are cut by the column itself: values ascend, the sort is stable
                    chosen = np.argsort(order[a:b], kind="stable")[:keep[i]]
                    parts.append(values[a:b][chosen].tobytes())
                    ends[i] = (order[a:b][chosen[-1]] >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(ends, pa.int64()), _binary(parts)], ["id", "n", "end", "columns"]
                )

    return run


def _deal(blocks: int):
    """Entries of many documents, packed by column block."""

    def run(batches):
        for batch in batches:
            node, n, end, label = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            head = np.zeros(len(node), dtype=HEAD)
            head["node"], head["n"], head["end"] = node, n, end >> 47
            merged = label != node
            columns = batch.column(4).to_pylist()
            values = np.frombuffer(b"".join(columns), dtype=np.uint64)
            owner = np.repeat(np.arange(len(columns)), [len(x) // 8 for x in columns])
            block = (mix(values) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            values, owner, block = values[order], owner[order], block[order]
            edges = np.concatenate([np.flatnonzero(np.diff(block, prepend=-1)), [len(block)]])
            rows = {"block": [], "columns": [], "counts": [], "heads": [], "labels": []}
            for a, b in zip(edges[:-1], edges[1:]):
                docs, counts = np.unique(owner[a:b], return_counts=True)
                rows["block"].append(int(block[a]))
                rows["columns"].append(values[a:b].tobytes())
                rows["counts"].append(np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes())
                rows["heads"].append(head[docs].tobytes())
                inside = docs[merged[docs]]
                rows["labels"].append(np.stack([node[inside], label[inside]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["block"], pa.int64()), *[_binary(rows[k]) for k in list(rows)[1:]]], list(rows)
            )

    return run


def _count_block(percent: int):
    """Shared entries of pairs from different groups within one block of columns."""

    def run(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table.column("columns").to_pylist()), dtype=np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int32)
        heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), dtype=HEAD)
        known = np.frombuffer(b"".join(table.column("labels").to_pylist()), dtype=np.int64).reshape(-1, 2)
        known = known[np.argsort(known[:, 0], kind="stable")]
        labels = heads["node"].astype(np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known[:, 0], labels), len(known) - 1)
            labels = np.where(known[at, 0] == labels, known[at, 1], labels)
        owner = np.repeat(np.arange(len(counts)), counts)
        node, n, end, label = heads["node"][owner], heads["n"][owner].astype(np.int64), heads["end"][owner], labels[owner]
        order = np.lexsort((node, label, values))
        values, node, n, end, label = values[order], node[order], n[order], end[order], label[order]
        fresh = np.ones(len(values), dtype=bool)  # a set met in several rows counts once
        fresh[1:] = (values[1:] != values[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
        values, node, n, end, label = values[fresh], node[fresh], n[fresh], end[fresh], label[fresh]
        size = len(values)
        run_start = np.ones(size, dtype=bool)
        run_start[1:] = values[1:] != values[:-1]
        label_start = run_start.copy()
        label_start[1:] |= label[1:] != label[:-1]

        def next_start(flags):
            at = np.concatenate([np.flatnonzero(flags), [size]])
            return at[np.cumsum(flags)]

        begin, stop = next_start(label_start), next_start(run_start)
        partners = stop - begin
        cut = np.concatenate([[0], np.cumsum(partners)])
        at, found = 0, []
        rest = n - (n - -(-percent * n // 100) + 1)
        while at < size:
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + PAIR_CHUNK, side="right")) - 1)
            left = np.repeat(np.arange(at, to), partners[at:to])
            right = np.arange(len(left)) - np.repeat(cut[at:to] - cut[at], partners[at:to]) + np.repeat(begin[at:to], partners[at:to])
            fit = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            left, right = left[fit], right[fit]
            beyond = np.where(end[left] < end[right], rest[left], np.where(end[left] > end[right], rest[right], np.maximum(rest[left], rest[right])))
            least = np.maximum(1, _needed(n[left], n[right], percent) - beyond)
            swap = node[left] > node[right]
            a, b = np.where(swap, node[right], node[left]), np.where(swap, node[left], node[right])
            if len(a):
                order = np.lexsort((b, a))
                a, b, least = a[order], b[order], least[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                found.append((a[first], b[first], np.diff(np.append(first, len(a))), np.minimum.reduceat(least, first)))
            at = to
        joined = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "shared", "least"), joined)})

    return run


def _filter_of(ids: DataFrame) -> np.ndarray:
    """Bitmap of hashed ids, of fixed size; says yes for every id given and for some others."""
    place = F.expr(f"shiftrightunsigned(xxhash64(id), {64 - FILTER_BITS})")
    words = (
        ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def _wanted(size: int, bits: np.ndarray):
    def run(batches):
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            hit = (bits.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            chosen = batch.filter(pa.array(hit.astype(bool)))
            for ids, values, begin in _sets(chosen, size):
                yield pa.RecordBatch.from_arrays([ids, _digests(values, begin), _binary(_per_text(values, begin))], ["id", "same", "columns"])

    return run


def _overlap(percent: int):
    def run(batches):
        for batch in batches:
            hit = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(*batch.columns[-2:])):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                hit[i] = shared > 0 and shared >= _needed(len(x), len(y), percent)
            yield batch.select(batch.schema.names[:-2]).filter(pa.array(hit))

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The classes (``id``, ``same``, ...) with their ``columns``; other texts are skipped by a filter of fixed size.

    Repeated rows of a document give repeated rows here.
    """
    return (
        docs.select("id", "text", F.xxhash64("id").alias("place"))
        .mapInArrow(_wanted(size, _filter_of(classes)), "id long, same binary, columns binary")
        .join(classes, ["id", "same"])
    )


def _tile(percent: int):
    """Links within one tile of a group: the product of two blocks of rows, by slices of columns.

    Returns a spanning forest (``a`` is the root of ``b``), and the rows that ``b`` links with in this tile. Pairs
    within one block are counted in the tile of the block with itself.
    """

    def run(table: pa.Table) -> pa.Table:
        first: dict = {}
        for row, key in enumerate(zip(table.column("id").to_pylist(), table.column("same").to_pylist())):
            first.setdefault(key, row)
        table = table.take(pa.array(list(first.values()), pa.int64()))
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("columns").to_pylist()]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        often = counts > 1  # a column of one row adds nothing
        column = np.cumsum(often) - 1
        keep = often[places]
        column, owner = column[places[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner, width = column[order], owner[order], int(often.sum())
        product = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for begin in range(0, width, TILE_COLUMNS):
            a, b = np.searchsorted(column, [begin, begin + TILE_COLUMNS])
            part = np.zeros((len(sets), min(TILE_COLUMNS, width - begin)), dtype=np.float32)
            part[owner[a:b], column[a:b] - begin] = 1
            product += part @ part.T
        link = product >= _needed(n[:, None], n[None, :], percent)
        link &= (n > 0)[:, None]
        counted = link & (ids[:, None] != ids[None, :])
        if table.column("i")[0] != table.column("j")[0]:
            counted &= own[:, None] != own[None, :]
        partners = counted @ table.column("copies").to_numpy()
        label = np.arange(len(ids))
        open_rows = np.ones(len(ids), dtype=bool)
        for i in range(len(ids)):  # breadth first from every row not reached yet
            if not open_rows[i]:
                continue
            reached = np.zeros(len(ids), dtype=bool)
            edge = np.array([i])
            reached[i] = True
            while len(edge):
                fresh = link[edge].any(axis=0) & ~reached
                reached |= fresh
                edge = np.flatnonzero(fresh)
            label[reached] = i
            open_rows &= ~reached
        said = (label != np.arange(len(ids))) | (partners > 0)
        kept = table.select(["same"]).filter(pa.array(said)).combine_chunks()
        return pa.table({"a": pa.array(ids[label[said]], pa.int64()), "b": pa.array(ids[said], pa.int64()), "same": kept.column("same"), "links": pa.array(partners[said], pa.int64())})

    return run


def _linked_within(docs: DataFrame, classes: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """``a``, ``b``: links that connect all that links within each group of (``node``, ``group``), on whole sets; and
    ``links``: with how many rows the class (``b``, ``same``) links, in parts to be summed.

    A group is cut into blocks of about ``TILE_ROWS`` sets by hash; every pair of blocks is a tile, a task of
    bounded size, that returns a forest and not its pairs.
    """
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = groups.join(sizes, "group").select(F.col("node").alias("id"), "group", F.ceil(F.col("size") / TILE_ROWS).cast("int").alias("cuts"))
    members = checkpointed(classes.select("id", "same", "copies").join(members, "id"))
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    tiles = members.select("id", "same", "group", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    tiles = tiles.select("id", "same", "group", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = _sets_of(docs, members.select("id", "same", "copies"), size)
    return checkpointed(sets.join(tiles, ["id", "same"]).groupBy("group", "i", "j").applyInArrow(_tile(percent), "a long, b long, same binary, links long"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of classes whose whole sets link. Reads the sets of documents in pairs only."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets_of(docs, classes.select("id", "same", "copies").join(ids, "id", "left_semi"), size)
    left, right = (sets.withColumnsRenamed({"id": k, **{c: f"{c}_{k}" for c in ("same", "copies", "columns")}}) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "same_a", "same_b", "copies_a", "copies_b", "columns_a", "columns_b")
    schema = "a long, b long, same_a binary, same_b binary, copies_a long, copies_b long"
    return checkpointed(both.mapInArrow(_overlap(percent), schema).distinct())


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_links``.

    The set of a text are its distinct runs of ``words`` words (A-Z lower-cased, split at ASCII white
    space); a shorter text is one run; a text without words or NULL has the empty set. Two documents
    link when ``100 * overlap >= percent * union``; empty sets link with nothing. The component is the
    smallest id reachable by links. Rows with the same id are one document and stay together.
    ``n_links`` counts the other rows that a row links with, equal sets included; other texts under the same id aside.
    A NULL id links with nothing and has a NULL component. Other columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = checkpointed(docs.mapInArrow(_signatures(words), "id long, n long, same binary, minima array<long>, chunk int, sketch binary"))
    rows = signed.where("sketch is null").select("id", "n", "same", "minima")

    # equal sets are one class under its smallest id
    classes = rows.where("n > 0 and id is not null").groupBy("same").agg(
        F.min("id").alias("node"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes)
    named = classes.select(F.col("node").alias("id"), "same", "copies")

    # likely groups: each class with the most central class that several of its minima lead to; a class whose minima are
    # shared by many is central
    keyed = classes.select("node", F.posexplode("minima").alias("k", "minimum"))
    shared_minima = checkpointed(keyed.groupBy("k", "minimum").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    keyed = keyed.join(shared_minima, ["k", "minimum"])
    central = checkpointed(keyed.groupBy("node").agg(F.sum("size").alias("weight"))).select("node", F.struct("weight", (-F.col("node")).alias("back")).alias("rank"))
    scored = keyed.drop("size").join(central, "node")
    heads = scored.groupBy("k", "minimum").agg(F.max("rank").alias("head"))
    agreed = keyed.drop("size").join(heads, ["k", "minimum"]).groupBy("node", "head").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= AGREE)
    near = checkpointed(agreed.groupBy("node").agg((-F.max("head").getField("back")).alias("head")))
    onward = near.select(F.col("node").alias("head"), F.col("head").alias("next"))
    groups = checkpointed(near.join(onward, "head", "left").select("node", F.coalesce("next", "head").alias("group")))
    sure = _linked_within(docs, named, groups, words, percent)

    # exact pass over the rarest columns of the classes
    summed = signed.where("sketch is not null").select("chunk", "sketch").repartition("chunk").mapInArrow(_summed, "chunk int, rarity binary")
    rarity = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for chunk, values in summed.collect():  # as many rows as the sketch has chunks
        rarity[chunk * SKETCH_CHUNK:(chunk + 1) * SKETCH_CHUNK] = np.frombuffer(values, dtype=np.uint8)
    entries = classes.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, int(entries) // BLOCK_ENTRIES)
    labels = classes.select("node", "n").distinct().join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        F.col("node").alias("id"), F.col("n"), F.coalesce("group", "node").alias("label"))
    shared = (
        docs.where("id is not null").mapInArrow(_prefixes(words, percent, rarity), "id long, n long, end long, columns binary")
        .join(labels, ["id", "n"])
        .select("id", "n", "end", "label", "columns")
        .mapInArrow(_deal(blocks), "block long, columns binary, counts binary, heads binary, labels binary")
        .groupBy("block").applyInArrow(_count_block(percent), "a long, b long, shared long, least long")
        .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
        .where("shared >= least").select("a", "b")
    )
    late = _verified(docs, named, checkpointed(shared), words, percent)

    same = rows.where("n > 0 and id is not null").join(classes.select("same", "node"), "same").where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = components(sure.select("a", "b").union(late.select("a", "b")).union(same))
    # links of a class: rows of the classes that it links with
    parts = sure.select("same", "links")
    for own, other in (("a", "b"), ("b", "a")):
        parts = parts.union(late.select(f"same_{own}", f"copies_{other}"))
    linked = parts.groupBy("same").agg(F.sum("links").alias("links"))
    linked = classes.where("copies > 1").select("same", "copies").join(linked, "same", "full").select(
        "same", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    return (
        rows.join(found, F.col("id") == F.col("node"), "left").join(linked, "same", "left")
        .select(
            F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
            F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        )
    )
