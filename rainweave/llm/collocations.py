"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of two words, edges runs of three between overlapping nodes. Only edges, and the places
where a walk along a piece of text leaves the graph, are counted; every shorter count is a flow: a node
occurs as often as its outgoing edges and its exits, a word as often as the nodes that begin with it and its
own exits. Parts of the graph that cannot hold a candidate are contracted before words are shuffled:
a first pass sums local flows of words and nodes by hash, a second one the edges between nodes that are left, and a
bit filter of bounded size each holds what reaches the minimum. Colliding hashes only add to a sum, so the
filters keep too much at worst and the counts stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.llm.words import Words, mix, text_slices, words_of
from rainweave.session import checkpointed

MINIMUM = 10
TOP = 2000
INSIDE_PERCENT = 50  # a phrase goes when a longer candidate around it has this share of its occurrences
SCALE = 1_000_000
SLICE_BYTES = 1 << 20
FILTER_BITS = 29  # the filter has 64 MB at most; beyond some 30 million flows it keeps more, and stays exact
BITMAP = 32768  # bits of one row of the bitmap functions
RANK_PARTS = (64, 16, 4)  # ranks are taken in ever fewer parts of a lang, so no task sorts all its phrases

BREAK = np.zeros(256, dtype=bool)  # pieces end at [.,;:!?\x0A-\x0D]
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
PIECED = ~BREAK  # words [^\x20\x09]+ of a piece
PIECED[[0x20, 0x09]] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Runs:
    """Words of a slice with the hashes of the runs of one, two and three words that begin at each of them."""

    def __init__(self, words: Words, langs: np.ndarray):
        text = np.repeat(np.arange(words.texts()), np.diff(words.first))
        breaks = np.concatenate([[0], np.cumsum(BREAK[words.data])])
        self.words, self.count = words, len(words.starts)
        self.lang = text + words.rows.start
        step = np.zeros(self.count + 2, dtype=bool)  # the next word is in the same piece
        if self.count:
            step[:self.count - 1] = (text[1:] == text[:-1]) & (breaks[words.starts[1:]] == breaks[words.ends[:-1]])
        self.pair, self.triple = step[:self.count], step[:self.count] & step[1:self.count + 1]
        own = np.concatenate([words.hashes, np.zeros(2, dtype=np.uint64)])
        self.base = langs[self.lang]
        self.one = mix(words.hashes ^ self.base)
        self.two = mix(self.one * _STEP + own[1:self.count + 1])
        self.three = mix(self.two * _STEP + own[2:])


def _langs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    names = pc.fill_null(column.cast(pa.string()), "und")
    coded = names.dictionary_encode()
    keys = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return names, np.array(keys, dtype=np.uint64)[coded.indices.to_numpy()] if len(column) else np.zeros(0, np.uint64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, _Runs]]:
    names, keys = _langs(batch.column(0))
    for rows, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
        yield names, _Runs(words_of(rows, data, offsets, PIECED), keys)


def _local_flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, runs in _runs(batch):
            keys, counts = np.unique(np.concatenate([runs.one, runs.two[runs.pair]]), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "flow"])


def _spelled(words: Words, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The words at these places, NULL where not valid."""
    at = np.where(valid, at, 0)
    starts, sizes = words.starts[at], np.where(valid, words.ends[at] - words.starts[at], 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.data[source].tobytes()))
    return pc.if_else(pa.array(valid), text.cast(pa.string()), pa.scalar(None, pa.string()))


def _known(keys: np.ndarray, held: tuple[int, np.ndarray]) -> np.ndarray:
    bits, filled = held
    place = keys >> np.uint64(64 - bits)
    return (filled[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _between_nodes(runs: _Runs, held: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where a kept node begins, and where an edge between two of them does."""
    node = np.concatenate([_known(runs.two, held) & runs.pair, [False]])
    return node[:-1], node[:-1] & node[1:] & runs.triple


def _local_weights(held: tuple[int, np.ndarray]):
    """Counts of the edges between kept nodes in a slice, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in _runs(batch):
                keys, counts = np.unique(runs.three[_between_nodes(runs, held)[1]], return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "flow"])

    return run


def _local_edges(held: tuple[int, np.ndarray], heavy: tuple[int, np.ndarray]):
    """Edges, exits of nodes and exits of words of a slice, each with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, runs in _runs(batch):
                node, edge = _between_nodes(runs, held)
                edge &= _known(runs.three, heavy)
                level = np.where(edge, 3, np.where(node, 2, _known(runs.one, held).astype(np.int64)))
                key = np.choose(level, [runs.base, runs.one, runs.two, runs.three])
                own = np.concatenate([runs.words.hashes, np.zeros(2, dtype=np.uint64)])
                parts = [np.where(level > k, own[k:k + runs.count], 0) for k in range(3)] + [level.astype(np.uint64), runs.base]
                _, first, group, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                if any((p != p[first][group]).any() for p in parts):  # two runs with one hash
                    _, first, counts = np.unique(np.stack(parts, axis=1), axis=0, return_index=True, return_counts=True)
                spelled = [_spelled(runs.words, first + k, level[first] > k) for k in range(3)]
                yield pa.record_batch([names.take(pa.array(runs.lang[first])), *spelled, pa.array(counts.astype(np.int64))], ["lang", "a", "b", "c", "n"])

    return run


def _filter(flows: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the hashes of ``flows``; the rows that reach the driver have 64 MB at most."""
    bits = min(FILTER_BITS, max(20, int(flows.count()).bit_length() + 4))
    place = F.expr(f"shiftrightunsigned(key, {64 - bits}) + 1")
    rows = flows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    filled = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for part, held in rows.collect():
        filled[(part - 1) * BITMAP // 8:part * BITMAP // 8] = np.frombuffer(held, dtype=np.uint8)
    return bits, filled


def word_graph(docs: DataFrame, minimum: int = MINIMUM, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang``, ``a``, ``b``, ``c``, ``n``: counted edges; ``c`` is NULL for walks that leave the graph at the
    node (a, b) (the piece ends, or goes on in a contracted part), ``b`` too where they leave at the word ``a``, and
    ``a`` too for words in contracted parts. Flows of ``minimum`` and more are whole (see ``flows``)."""
    texts = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))

    def reaching(local) -> tuple[int, np.ndarray]:
        summed = texts.mapInArrow(local, "key long, flow long").groupBy("key").agg(F.sum("flow").alias("flow"))
        return _filter(checkpointed(summed.where(F.col("flow") >= minimum).select("key")))

    held = reaching(_local_flows)
    heavy = reaching(_local_weights(held))
    local = texts.mapInArrow(_local_edges(held, heavy), "lang string, a string, b string, c string, n long")
    return checkpointed(local.groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n")))


def flows(graph: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of the runs ``keys`` (of ``a``, ``b``): all that goes out of them."""
    known = graph.where(F.col(keys[-1]).isNotNull()) if keys else graph
    return known.groupBy("lang", *keys).agg(F.sum("n").alias("f"))


def unary_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang``, ``words``, ``n``: the edges, with those joined by unary nodes compacted to one path.

    A node is unary when all its flow comes in by one edge and goes out by one, so that all edges of a path have
    the same count and every node inside has it too. ``nodes`` has the boolean ``unary``. Edges find the head
    of their path by doubling their distance to it; a path is no longer than a piece of text.
    """
    edges = checkpointed(edges.withColumn("id", F.monotonically_increasing_id()))
    inner = nodes.where("unary").select("lang", "a", "b", F.col("f").alias("n"))
    into = edges.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n", F.col("id").alias("head"))
    links = inner.join(into, ["lang", "a", "b", "n"]).join(edges.select("lang", "a", "b", "n", "id"), ["lang", "a", "b", "n"])
    links = checkpointed(links.select("id", "head", F.lit(1).cast("long").alias("hops")))
    while True:
        onward = links.select(F.col("id").alias("head"), F.col("head").alias("far"), F.col("hops").alias("more"))
        moved = links.join(onward, "head", "left")
        if moved.where("far is not null").limit(1).count() == 0:
            break
        links = checkpointed(moved.select("id", F.coalesce("far", "head").alias("head"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    placed = edges.join(links, "id", "left").withColumn("head", F.coalesce("head", "id"))
    alone = placed.groupBy("head").agg(
        F.first("lang").alias("lang"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("hops", F.lit(0)).alias("at"), "a", "b", "c"))).alias("line"))
    first = F.element_at("line", 1)
    return checkpointed(alone.select("lang", "n", F.concat(F.array(first["a"], first["b"]), F.transform("line", lambda e: e["c"])).alias("words")))


def _score(a: str, left: str, right: str) -> Column:
    a, left, right = (f"cast({name} as decimal(16,0))" for name in (a, left, right))
    return F.expr(f"({SCALE} * ({a} * {a})) div ({left} * {right})")


def collocations(docs: DataFrame, minimum: int = MINIMUM, top: int = TOP, inside_percent: int = INSIDE_PERCENT,
                 text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``top`` phrases of two and three words per lang.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` and then at spaces and tabs. ``a`` counts the phrase,
    ``l`` and ``r`` the two parts of its lowest-scoring cut (the first of equal ones), ``n`` all words of the lang;
    the score is ``floor(10^6 a a / (l r))`` in exact decimals. Phrases below ``minimum`` are no candidates;
    one inside a longer candidate with ``inside_percent`` of its occurrences goes. Ties: more occurrences first,
    then the phrase in byte order. A NULL lang is ``und``; NULL and empty texts have no words; repeated rows count
    again; other columns are ignored; no candidates, no rows.
    """
    graph = word_graph(docs, minimum, text_column, lang_column)
    words = checkpointed(flows(graph, "a").where(F.col("f") >= minimum))
    edges = graph.where("c is not null").where(F.col("n") >= minimum)
    into = edges.groupBy("lang", F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("most_in"))
    out = edges.groupBy("lang", "a", "b").agg(F.max("n").alias("most_out"))
    nodes = flows(graph, "a", "b").where(F.col("f") >= minimum).join(into, ["lang", "a", "b"], "left").join(out, ["lang", "a", "b"], "left")
    nodes = checkpointed(nodes.withColumn("unary", F.coalesce((F.col("most_in") == F.col("f")) & (F.col("most_out") == F.col("f")), F.lit(False))))
    paths = unary_paths(edges, nodes)

    # nodes inside a path have its count; those at its ends are looked up
    ends = nodes.select("lang", "a", "b", "f")
    last = F.size("words")
    paths = (
        paths.withColumns({"a": F.element_at("words", 1), "b": F.element_at("words", 2)}).join(ends.withColumnRenamed("f", "head_flow"), ["lang", "a", "b"])
        .withColumns({"a": F.element_at("words", -2), "b": F.element_at("words", -1)}).join(ends.withColumnRenamed("f", "tail_flow"), ["lang", "a", "b"])
    )
    along = paths.select("lang", "words", F.col("n").alias("a"), "head_flow", "tail_flow", (last - 2).alias("edges"), F.explode(F.sequence(F.lit(1), last - 2)).alias("i"))
    threes = along.select(
        "lang", F.slice("words", F.col("i"), F.lit(3)).alias("words"), "a",
        F.when(F.col("i") == 1, F.col("head_flow")).otherwise(F.col("a")).alias("front"),
        F.when(F.col("i") == F.col("edges"), F.col("tail_flow")).otherwise(F.col("a")).alias("back"),
    )
    inside = F.greatest(F.coalesce("most_in", F.lit(0)), F.coalesce("most_out", F.lit(0)))
    twos = nodes.where(~F.col("unary") & (100 * inside < inside_percent * F.col("f"))).select(
        "lang", F.array("a", "b").alias("words"), F.col("f").alias("a"), F.lit(None).cast("long").alias("front"), F.lit(None).cast("long").alias("back"))

    ends_of = threes.union(twos).withColumns({"head": F.element_at("words", 1), "tail": F.element_at("words", -1)})
    for name in ("head", "tail"):
        ends_of = ends_of.join(words.select("lang", F.col("a").alias(name), F.col("f").alias(f"{name}_word")), ["lang", name])
    ends_of = ends_of.withColumn("back", F.coalesce("back", "tail_word"))
    cut = ends_of.withColumns({"first_score": _score("a", "head_word", "back"), "second_score": F.when(F.col("front").isNotNull(), _score("a", "front", "tail_word"))})
    second = F.coalesce(F.col("second_score") < F.col("first_score"), F.lit(False))
    scored = cut.select(
        "lang", F.array_join("words", " ").alias("phrase"), "a",
        F.when(second, F.col("front")).otherwise(F.col("head_word")).alias("l"),
        F.when(second, F.col("tail_word")).otherwise(F.col("back")).alias("r"),
        F.when(second, F.col("second_score")).otherwise(F.col("first_score")).alias("score"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for parts in (*RANK_PARTS, 1):  # the first of all are among the first of each part
        line = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= top)
    return scored.join(flows(graph).withColumnRenamed("f", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
