"""What the operators of this subpackage share: staging, text batches and word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more than max_rows rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """One row (doc_id, label) per labelled document; the largest label counts where rows repeat."""
    return (
        labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(name).cast("int").alias("label"))
    )


def columns_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts hold about max_bytes (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // max_bytes
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array and their n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.binary()), b"")
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system; a worker is kept for later tasks and would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_codes(seed: int) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_CODES = byte_codes(11)
_POWERS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased words of every text, and the n + 1 offsets of the texts in them.

    A word is a run of ASCII letters, digits and bytes from 128 on. For each length in prefixes, an array more holds the
    hash of every word's first so many bytes (of the whole word, if shorter), each length with hashes of its own.
    """
    n_texts = len(offsets) - 1
    where = np.flatnonzero(_IS_WORD[data])
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    first = np.ones(len(where), bool)
    first[1:] = np.diff(where) > 1
    edge = np.searchsorted(where, offsets[1:-1])
    first[edge[edge < len(where)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(where)))
    at = np.arange(len(where)) - np.repeat(starts, lengths)
    codes = _CODES[_LOWER[data[where]]] * (_POWERS[at & 63] + (at >> 6).astype(np.uint64))
    hashes = mixed(np.add.reduceat(codes, starts) + lengths.astype(np.uint64))
    heads = [
        mixed(np.add.reduceat(np.where(at < k, codes, np.uint64(0)), starts) + np.minimum(lengths, k + 1).astype(np.uint64) * np.uint64(2 * k + 1))
        for k in prefixes
    ]
    return hashes, np.searchsorted(where[starts], offsets), *heads


def of_text(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with only the columns asked for, to be handed to Python in batches of bounded bytes.

    Rows of text vary too much in size for the session's default of 10,000 rows a batch.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    missing = [c for c in columns if c not in docs.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return docs.select(*columns)
