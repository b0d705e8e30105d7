"""Work done once per distinct pre-token and joined back to documents.

A chunk is a run of documents that one task reads (about CHUNK_BYTES of text). One pass cuts every text once and gives
rows of two kinds: each chunk's distinct pre-tokens, numbered by first appearance, and the chunk's documents as those
numbers. Both go through one exchange, which the distinct values, the join back and the documents all read. Chunks grow
in number with the input, never in size, and no row holds more than one chunk, so neither hot sources nor frequent words
make a large group.

A chunk's name is a hash of its task, place and pre-tokens. A task that is run again over rows in another order (after a
lost executor, on input that comes from a shuffle) gives chunks of other names; a chunk whose documents and values are not
of one run is found out, and raises an error in place of wrong numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, of_text

CHUNK_BYTES = 16 << 20
GROUP_WORDS = 1 << 19
PACK_ROWS = 1 << 20
KINDS = {"home": pa.int64(), "chunk": pa.int64(), "number": pa.int32(), "blob": pa.binary()}
PIECE = {"piece": pa.string()}


class _Numbers(dict):
    """The number of each key by first appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def packed(numbers: np.ndarray) -> bytes:
    """uint32 numbers as zstd of their byte planes; small numbers leave the high planes empty."""
    planes = np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()


def batch_of(key: dict[str, pa.DataType], **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of key's columns and KINDS; a column that is left out is null, one of key is empty or 0."""
    n = len(next(iter(columns.values())))
    kinds = key | KINDS
    blank = lambda c, kind: pa.array([""] * n if kind == pa.string() else np.zeros(n, np.int64), kind) if c in key else pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else blank(c, kind) for c, kind in kinds.items()], names=list(kinds))


def tagged_ddl(key: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[kind]}" for c, kind in (key | KINDS).items())


def chunk_name(task: int, at: int, content: bytes) -> int:
    return xxhash.xxh64_intdigest(f"{task} {at} {len(content)}\n".encode() + content) >> 1


def tagged(docs: DataFrame, splitter: Callable[[], Callable[[str], list[str]]], counted: bool, chunk_bytes: int) -> DataFrame:
    """Rows (piece, 0, chunk, number, null) for pre-tokens, ('', chunk, chunk, part, blob) for documents.

    A blob holds the ids, byte sizes and lengths of some documents of the chunk, their pre-token numbers one after another
    and how many pre-tokens the chunk has; if counted, each number stands once per document, with its frequency.
    """

    def out(task: int, at: int, numbers: dict[str, int], ids: list, sizes: list[int], rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        chunk = chunk_name(task, at, "\n".join(words).encode())
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            yield batch_of(PIECE, piece=part, home=np.zeros(len(part), np.int64), chunk=np.full(len(part), chunk), number=np.arange(a, a + len(part), dtype=np.int32))
        counts = [np.zeros(0, np.uint32)] * len(rows)
        if counted:
            for k, row in enumerate(rows):
                rows[k], counts[k] = np.unique(row, return_counts=True)
        lengths = np.array([len(r) for r in rows])
        part = np.cumsum(lengths) // GROUP_WORDS
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            a, b = int(own[0]), int(own[-1]) + 1
            blob = pickle.dumps((len(words), ids[a:b], sizes[a:b], lengths[a:b], packed(np.concatenate(rows[a:b])), packed(np.concatenate(counts[a:b])) if counted else b""))  # zstd of nothing isn't empty
            yield batch_of(PIECE, home=[chunk], chunk=[chunk], number=[a], blob=[blob])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        task, at = TaskContext.get().partitionId(), 0
        numbers, ids, sizes, rows = _Numbers(), [], [], []
        for batch in cut(batches, "text"):
            sizes += pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            ids += batch.column("doc_id").to_pylist()
            for text in batch.column("text").to_pylist():
                found = split(text or "")
                rows.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            at += 1
            if sum(sizes) >= chunk_bytes:
                yield from out(task, at, numbers, ids, sizes, rows)
                numbers, ids, sizes, rows = _Numbers(), [], [], []
                give_back()
        if ids:
            yield from out(task, at + 1, numbers, ids, sizes, rows)
        del numbers, ids, sizes, rows
        give_back()

    return of_text(docs, "doc_id", "text").mapInArrow(run, tagged_ddl(PIECE))


def _flat(values: pa.Array) -> tuple:
    if pa.types.is_list(values.type):
        return len(values), packed(pc.list_value_length(values).to_numpy()), packed(values.flatten().to_numpy())
    return len(values), packed(values.to_numpy().view(np.uint32)), str(values.type)


def _opened(n: int, first: bytes, rest: bytes | str) -> pa.Array:
    numbers = unpacked(first, n)
    if isinstance(rest, str):
        return pa.array(numbers.view({"int32": np.int32, "float": np.float32}[rest]))
    offsets = np.append(0, np.cumsum(numbers)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(unpacked(rest, int(offsets[-1])).astype(np.int32)))


def _packed_values(values: DataFrame, key: dict[str, pa.DataType], value: str, late: Callable[[list[str]], pa.Array] | None) -> DataFrame:
    """Rows ('', chunk, chunk, null, blob) from (chunk, number, late, value): numbers and values by chunk.

    The values of rows with a late piece are what the function late makes of those pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            chunk, number = (table.column(c).to_numpy() for c in ("chunk", "number"))
            order = np.argsort(chunk, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0)), len(order))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = table.take(pa.array(order[a:b]))
                parts = [own] if late is None else [own.filter(pc.is_null(own.column("late"))), own.filter(pc.is_valid(own.column("late")))]
                for part, slow in zip(parts, (False, True), strict=False):
                    if part.num_rows:
                        made = late(part.column("late").to_pylist()) if slow else pa.concat_arrays(part.column(value).chunks)
                        name = int(chunk[order[a]])
                        yield batch_of(key, home=[name], chunk=[name], blob=[pickle.dumps((packed(part.column("number").to_numpy()), *_flat(made)))])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ROWS:
                yield from out()
        if sum(b.num_rows for b in held):
            yield from out()
        give_back()

    return values.mapInArrow(run, tagged_ddl(key))


def joined_back(docs: DataFrame, splitter: Callable, once: Callable[[DataFrame], DataFrame], value: str, finish: Callable, schema: str, counted: bool = False, chunk_bytes: int = CHUNK_BYTES, **rest) -> DataFrame:
    """Apply `once` to the distinct pre-tokens (piece) of all documents, then `finish` to each chunk; see `through_one_exchange`."""
    return through_one_exchange(tagged(docs, splitter, counted, chunk_bytes), PIECE, once, value, finish, schema, **rest)


def through_one_exchange(
    rows: DataFrame, key: dict[str, pa.DataType], once: Callable[[DataFrame], DataFrame], value: str, finish: Callable, schema: str,
    prepare: Callable = lambda values: values, late: tuple[Column, Callable[[list[str]], pa.Array]] | None = None,
) -> DataFrame:
    """Apply `once` to the distinct keys of rows as `tagged` gives them, then `finish` to each chunk.

    once takes the key's columns and home and returns them with value: an int, a float or an array of ints. late is a
    condition on piece and a function: values of pieces that meet it are made by the function, where the others are
    gathered. finish(prepare(values), ids, sizes, lengths, numbers, counts) takes the chunk's values by number (an Arrow
    array) and some of its documents, counts being None where the blobs hold none, and returns a pandas frame of schema.
    """
    n, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*key, "home"]
    rows = rows.repartition(n, *by)

    def only(documents: bool) -> DataFrame:
        """The rows of one kind. The test reads every column and, as it isn't deterministic to the planner, stays above the exchange, so that there is one."""
        kind = F.col("blob").isNotNull() if documents else F.col("blob").isNull()
        for c in (*by, "number", "chunk"):
            kind = kind & F.col(c).isNotNull()
        return rows.where(F.when(kind, F.monotonically_increasing_id()).otherwise(-1) >= 0)

    pairs = only(False)
    done = once(pairs.groupBy(*by).agg(F.lit(1).alias("one")).select(*by))
    condition, function = late if late is not None else (F.lit(False), None)
    late_piece = F.when(condition, F.col("piece")) if late is not None else F.lit(None).cast("string")
    values = pairs.join(done.hint("shuffle_hash"), by).select("chunk", "number", late_piece.alias("late"), value)
    gathered = _packed_values(values, key, value, function).repartition(n, *by)
    columns = [c.split()[0] for c in schema.split(", ")]

    def of_chunk(own: pd.DataFrame, documents: pd.DataFrame) -> pd.DataFrame:
        blobs = [pickle.loads(b) for b in own["blob"]]  # noqa: S301  (written above)
        numbers = np.concatenate([unpacked(b[0], b[1]) for b in blobs]) if blobs else np.zeros(0, np.uint32)
        made = pa.concat_arrays([_opened(*b[1:]) for b in blobs]) if blobs else pa.array([], pa.int32())
        order = np.argsort(numbers)
        parts, prepared = [], None
        for blob in documents["blob"]:
            n_words, ids, sizes, lengths, row, counts = pickle.loads(blob)  # noqa: S301
            if prepared is None:
                if len(order) != n_words or not np.array_equal(numbers[order], np.arange(n_words)):
                    raise RuntimeError("the values of a chunk are not those of its documents; stage input whose order may change")
                prepared = prepare(made.take(pa.array(order)))
            total = int(lengths.sum())
            parts.append(finish(prepared, ids, sizes, lengths, unpacked(row, total), unpacked(counts, total) if counts else None))
        give_back()
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)

    return gathered.groupBy(*by).cogroup(only(True).groupBy(*by)).applyInPandas(of_chunk, schema)


def nullable(values: list) -> pd.Series:
    """Doc ids, which may be null, as whole numbers."""
    return pd.array([None if v is None or v != v else int(v) for v in values], dtype="Int64")
