"""A quality classifier: histogram gradient-boosted trees over statistics of a document's bytes, words and lines.

Null and empty texts have the statistics of no words and get a score like any other. Repeated rows are scored each.
The trees are fitted on the driver, on no more than `max_fit` labelled rows, those of the least hash; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.boosting import Trees, fit
from tidemark.llm.common import cut, free_name, give_back, held_out, label_of, of_text, text_bytes, word_hashes

# Classes of bytes: 0 other, then as named.
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, MARK, QUOTE, HIGH, BAR, CONTROL = range(1, 12)
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = CONTROL
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[128:] = UPPER, LOWER, DIGIT, SPACE, LINE, HIGH
_CLASS[list(b".,;:?")], _CLASS[list(b"!#$%&*+=@^~_<>\\")], _CLASS[list(b"\"'()[]{}-/`")], _CLASS[list(b"|")] = STOP, MARK, QUOTE, BAR
CLASSES = 12
#: The features, in order.
NAMES = (
    *(f"share_{k}" for k in ("other", "upper", "lower", "digit", "space", "line", "stop", "mark", "quote", "high", "bar", "control")),
    "log_bytes", "log_words", "bytes_a_word", "log_lines", "words_a_line", "distinct_words", "repeated_lines", "commonest_word", "marks_a_word", "stops_a_word", "bars_a_word", "uppers_a_word",
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, and the count of its commonest."""
    n = len(offsets) - 1
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    key = np.sort((doc << np.uint64(40)) | (hashes >> np.uint64(24)))
    at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    owner, most = (key[at[:-1]] >> np.uint64(40)).astype(np.int64), np.zeros(n)
    np.maximum.at(most, owner, np.diff(at))
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for every text of a batch."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    hashes, words_at = word_hashes(data, offsets)
    words = np.diff(words_at).astype(float)
    distinct, most = _distinct(hashes, words_at)
    ends = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets[:-1], ends + 1, offsets[-1:]]))
    lines_at = np.searchsorted(bounds[:-1], offsets)
    lines = np.diff(lines_at).astype(float)
    wide = np.diff(bounds)
    if len(data):
        codes = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(data)) - np.repeat(bounds[:-1], wide) + 1).astype(np.uint64))
        line_hash = np.diff(np.append(np.uint64(0), codes[bounds[1:] - 1])) * np.uint64(0xBF58476D1CE4E5B9)
    else:
        line_hash = np.zeros(0, np.uint64)
    lines_distinct, _ = _distinct(line_hash, lines_at)
    some, a_word = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    return np.column_stack([
        counts / some, np.log1p(size), np.log1p(words), size / a_word, np.log1p(lines), words / np.maximum(lines, 1), distinct / a_word,
        1 - lines_distinct / np.maximum(lines, 1), most / a_word, counts[:, MARK] / a_word, counts[:, STOP] / a_word, counts[:, BAR] / a_word, counts[:, UPPER] / a_word,
    ])


def _measured(docs: DataFrame) -> DataFrame:
    """(label, features) of docs (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            x = statistics(*text_bytes(batch, "text"))
            values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), values], ["label", "features"])

    return of_text(docs, "label", "text").mapInArrow(run, "label int, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, max_fit: int = 20_000) -> Trees:
    """Trees fitted to labels.quality of the documents outside the held-out fold."""
    own = label_of(labels, "quality").where(~held_out(F.col("doc_id"), folds, fold))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)  # bounded by max_fit
    rows = _measured(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("label", "text")).toArrow()  # bounded by max_fit
    x = pa.concat_arrays(rows.column("features").chunks).flatten().to_numpy().reshape(-1, len(NAMES)) if rows.num_rows else np.zeros((0, len(NAMES)))
    order = np.lexsort(x.T)  # the fit must not depend on the order in which rows arrive
    return fit(x[order], rows.column("label").to_numpy().astype(float)[order])


def score_quality(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """docs (text, ...) with a column of scores, from 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            scores = model.value.score(statistics(*text_bytes(batch, "text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])
        give_back()

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return of_text(docs, *docs.columns).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) for every row of docs (doc_id, text, ...).

    Null and empty texts have the statistics of no words; repeated rows are scored each; a null doc_id is not held out and has
    no label; other columns of docs are not read; an empty docs gives no rows, and without labels every score is a half. Texts
    are of any length. Equal statistics give equal scores.
    """
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels, folds, fold))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at_least or more, with their columns, whatever their names. Cases as in `quality`."""
    name = free_name(docs, "score")
    return score_quality(docs, fit_quality(docs, labels), name).where(F.col(name) >= at_least).drop(name)
