"""Classifiers by compressed size: zstandard with raw-content dictionaries of labelled text.

A text compresses better with a dictionary of its own kind. Learning takes a bounded sample of the
labelled rows, chosen by a hash of the row, as whole texts: a dictionary gets pieces from all parts of every one of
them, and calibration measures them as scoring does. Scoring compresses every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweave.session import checkpointed

SAMPLE_ROWS = 1500  # labelled rows per class: the bound of the learning sample
DICTIONARY_BYTES = 96 << 10
PIECE_BYTES = 64  # of a text that is longer than its share of a dictionary; also the least share
LEVEL = 6
LEAST_MATCH = 4
FOLDS = 5


def held_out(id_column: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves no remainder. False for a NULL id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learning_sample(rows: DataFrame, rows_per_class: int = SAMPLE_ROWS) -> DataFrame:
    """``label``, ``rank`` (from 1 within the label), ``text``: at most ``rows_per_class`` whole rows a label, written once.

    ``rows`` has ``label``, ``id``, ``text``. They are first thinned by hash to about twice the bound per label, so no
    large label is sorted.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    thin = rows.withColumn("h", spread).join(checkpointed(counts), "label").where(F.col("h") * F.col("n") < 2 * rows_per_class)
    best = thin.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("rank") <= rows_per_class)
    return checkpointed(best.select("label", "rank", "text"))


def share_bytes(sizes: list[int], limit: int = DICTIONARY_BYTES) -> int:
    """The most bytes a text gives so that all texts together give ``limit``; what short ones leave goes to the others."""
    left = limit
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size + 1 > share:
            return max(PIECE_BYTES, share - 1)
        left -= size + 1
    return limit


def pieces(data: bytes, share: int) -> bytes:
    """About ``share`` bytes of a text: all of it, or a piece at a hashed place in each of equal parts of the whole text."""
    if len(data) <= share:
        return data
    n, seed = max(1, share // PIECE_BYTES), zlib.crc32(data)
    width, out = share // n, []
    for k in range(n):
        begin, end = len(data) * k // n, len(data) * (k + 1) // n
        at = begin + zlib.crc32(b"%d" % k, seed) % max(1, end - begin - width + 1)
        out.append(data[at:at + width])
    return b"".join(out)


def learn_dictionaries(sample: DataFrame) -> dict:
    """{label: dictionary} from all rows of a learning sample. Only sizes and the pieces come to the driver."""
    sizes: dict = {}
    for label, size in sample.select("label", F.octet_length("text")).collect():  # bounded: labels x rows_per_class
        sizes.setdefault(label, []).append(size)
    shares = {k: share_bytes(v) for k, v in sizes.items()}

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(2)
            found = [pieces(x.as_py().encode(), shares[k]) for k, x in zip(labels, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["label", "rank", "piece"])

    out: dict = {}
    given = sample.mapInArrow(cut, f"label {dict(sample.dtypes)['label']}, rank int, piece binary")
    for label, _, piece in sorted(tuple(r) for r in given.collect()):  # bounded: a dictionary each label
        out.setdefault(label, []).append(bytes(piece))
    return {k: b"\n".join(v) for k, v in out.items()}


class Sizer:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard

        self.compressors = []
        for data in dictionaries:
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_dict_id=False)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))

    def sizes(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.compressors]


def measured(dictionaries: list[bytes]):
    """mapInArrow function: (id columns..., text) to (id columns..., bytes, sizes)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw = [(x.as_py() or "").encode() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(x) for x in raw], pa.int64()), pa.array([sizer.sizes(x) for x in raw], pa.list_(pa.int32()))],
                [*batch.schema.names[:-1], "bytes", "sizes"],
            )

    return run


# --- language -------------------------------------------------------------------------------------

NARROW = 0.02  # margin, as a share of the second smallest size, below which a prediction is rejected


def identify_language(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows_per_class: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected`` for every row.

    The language whose dictionary compresses the text best; of equal sizes the first by code point.
    ``score`` is 0.5 for no margin and grows to 1 with the bytes between best and second;
    ``rejected`` marks narrow margins. A text that is NULL or has no letter is ``und`` with score 0, as is
    every text if nothing can be learned. A NULL id is not held out and not learned from.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(lang_column).alias("label"), F.col(text_column).alias("text"))
    taught = rows.where("not held_out and doc_id is not null and label is not null and text is not null").select("label", F.col("doc_id").alias("id"), "text")
    learned = learn_dictionaries(learning_sample(taught, rows_per_class))
    langs = sorted(learned)
    dictionaries = [learned[k] for k in langs]
    sized = rows.select("doc_id", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    sized = sized.mapInArrow(measured(dictionaries), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lettered boolean, bytes long, sizes array<int>")
    order = F.array_sort(F.col("sizes"))
    best = F.get(F.array(*[F.lit(k) for k in langs]) if langs else F.array().cast("array<string>"), (F.array_position("sizes", F.array_min("sizes")) - 1).cast("int"))
    second = F.coalesce(F.get(order, 1), F.get(order, 0) * 2)
    gap = second - F.get(order, 0)
    known = F.col("lettered") & F.lit(bool(langs))
    return sized.select(
        "doc_id", "held_out",
        F.when(known, best).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / (1 + F.exp(-gap / 4.0))).otherwise(0.0).alias("score"),
        F.when(known, gap < NARROW * second).otherwise(True).alias("rejected"),
    )


# --- quality --------------------------------------------------------------------------------------

QUALITY_CUT = 0.3


def _features(sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Intercept and normalised difference of the sizes, the only signal of the score.

    The difference of two code lengths over n bytes scatters like the square root of n, so that root is its unit:
    texts of all lengths share one scale.
    """
    bad, good = sizes[:, 0].astype(float), sizes[:, 1].astype(float)
    return np.stack([np.ones_like(bad), (bad - good) / np.sqrt(1 + length)], axis=1)


def _calibrate(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic fit by Newton steps with a small ridge, on scaled features, weighted to equal use of all rows."""
    middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    middle[0], spread[0] = 0, 1
    x, w = (features - middle) / spread, np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * w)
    return w, middle, spread


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows_per_class: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` for every row.

    Two dictionaries are cut from half of the learning sample, the score is calibrated on the other
    half, each class counted by its share of all labelled rows: a logistic curve over the normalised difference of the two
    sizes and nothing else, so the score rises with that difference. Of repeated labels the largest holds. A NULL text is scored as an empty
    one. Without rows of both labels every score is 0.5.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    marked = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    marked = marked.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))
    shares = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}  # two rows
    picked = marked.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30))
    some = [picked.where((F.col("label") == k) & (F.col("h") * n < 2 * rows_per_class)) for k, n in shares.items()]
    if len(some) == 2:
        chosen = checkpointed(some[0].unionByName(some[1]).select("id", "label"))
        taught = rows.where("text is not null").join(chosen, F.col("doc_id") == F.col("id")).select("label", "id", "text")
        sample = learning_sample(taught, rows_per_class)
        learned = learn_dictionaries(sample.where("rank % 2 = 1"))
    if len(some) < 2 or len(learned) < 2:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    dictionaries = [learned[k] for k in (0, 1)]
    lone = sample.groupBy("label").agg(F.max("rank").alias("last")).where("last = 1").select("label")
    lone = [r[0] for r in lone.collect()]  # two labels at most; a row of its own serves both halves
    rest = sample.where((F.col("rank") % 2 == 0) | F.col("label").isin(lone)).select("label", "rank", "text")
    sized = rest.mapInArrow(measured(dictionaries), f"label {dict(rest.dtypes)['label']}, rank int, bytes long, sizes array<int>")
    drawn = sorted(tuple(r) for r in sized.collect())  # numbers only, of at most two labels x rows_per_class
    found, wanted = np.array([[size, *both] for _, _, size, both in drawn]), np.array([r[0] for r in drawn], dtype=float)
    fit, middle, spread = _calibrate(_features(found[:, 1:], found[:, 0]), wanted)
    # the sample holds the classes evenly: the intercept takes their shares in
    fit[0] += np.log(shares[1] / shares[0]) - np.log(max(1, (wanted == 1).sum()) / max(1, (wanted == 0).sum()))

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in measured(dictionaries)(batches):
            length = batch.column(2).to_numpy()
            sizes = np.stack(batch.column(3).to_numpy(zero_copy_only=False)) if len(length) else np.zeros((0, 2))
            x = (_features(sizes, length) - middle) / spread
            p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0))
