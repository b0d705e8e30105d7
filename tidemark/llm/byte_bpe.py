"""Byte-level BPE: ranked merges folded by higher-order functions over the bytes of distinct words.

Bytes are held as pairs of hex digits, so that joining two parts is joining two strings. The rank map is a literal: an
array of small JSON maps, addressed by the crc32 of a part. Its size is the vocabulary's, whatever the input. The fold
copies its state at each merge, so words over LONG bytes are merged from a heap instead, to the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pieces import joined_back, nullable
from tidemark.llm.token_counts import splitter

SLOTS = 1 << 14
NONE = 2**31 - 1
LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(table: Column, part: Column) -> Column:
    slot = F.get(table, (F.crc32(part.cast("binary")) % SLOTS).cast("int"))
    return F.coalesce(F.try_element_at(slot, part), F.lit(NONE))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_parts(word: Column, table: Column) -> Column:
    """The parts (hex) of a word (hex) after all merges, least rank first and leftmost among equals.

    The fold's state holds the parts and the rank of each neighbouring pair; a merge works out two ranks anew. It has a
    step for each byte but the first; once no pair has a rank, the state passes through.
    """
    n = (F.length(word) / 2).cast("int")
    none = F.array().cast("array<int>")

    def start(parts: Column) -> Column:
        ranks = F.zip_with(
            F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: rank_of(table, F.concat(a, b))
        )
        return F.struct(parts.alias("parts"), ranks.alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        parts, ranks = state["parts"], state["ranks"]

        def merge(m: Column) -> Column:
            at, joined = m["at"], m["joined"]
            left = F.when(at > 1, F.array(rank_of(table, F.concat(F.get(parts, at - 2), joined)))).otherwise(none)
            right = F.when(at < F.size(ranks), F.array(rank_of(table, F.concat(joined, F.get(parts, at + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(joined), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.size(ranks))).alias("ranks"),
            )

        def found(least: Column) -> Column:
            at = F.array_position(ranks, least).cast("int")
            pair = _let(at, lambda i: F.struct(i.alias("at"), F.concat(F.get(parts, i - 1), F.get(parts, i)).alias("joined")))
            return F.when(F.coalesce(least, F.lit(NONE)) == NONE, state).otherwise(_let(pair, merge))

        return _let(F.array_min(ranks), found)

    singles = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(word, i * 2 + 1, F.lit(2)))
    return F.when(n < 2, F.array(word)).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), _let(singles, start), step, lambda s: s["parts"]))


def encoded_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """words (piece, ...) with ids, the ids of every distinct word of up to LONG bytes."""
    word = F.hex(F.col("piece").cast("binary"))

    def encode(table: Column) -> Column:
        folded = lambda w: F.transform(merged_parts(w, table), lambda p: rank_of(table, p))
        return _let(word, lambda w: _let(rank_of(table, w), lambda whole: F.when(whole != NONE, F.array(whole)).otherwise(folded(w))))

    return words.select("*", F.when(~_long(), _let(rank_map(ranks), encode)).alias("ids"))


def _long() -> Column:
    return F.octet_length("piece") > LONG


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same merges, from a heap of neighbouring pairs: n log n steps for n bytes."""
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # starts of the parts beside the part at each start
    heap = [(rank, k, k + 2) for k in range(len(word) - 1) if (rank := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * len(word))
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = after[start]
        if not alive[start] or middle >= len(word) or after[middle] != end:
            continue  # one of the two has been merged since
        alive[middle], after[start] = 0, end
        if end < len(word):
            before[end] = start
            if (rank := ranks.get(word[start : after[end]])) is not None:
                heapq.heappush(heap, (rank, start, after[end]))
        if before[start] >= 0 and (rank := ranks.get(word[before[start] : end])) is not None:
            heapq.heappush(heap, (rank, before[start], end))
    at, out = 0, []
    while at < len(word):
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


def byte_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, ids, n_tokens, ids_sha256, decoded and decoded_sha256 for every row of docs (doc_id, text, ...).

    ids are joined by spaces and decoded is the decoded bytes; both are left out without keep_ids. Null and empty texts have
    no ids, repeated rows and rows without a doc_id are encoded each, other columns of docs are not read, and an empty docs
    gives no rows. Texts and words are of any length, as far as a document's joined ids stay under 2 GB, the most that a value
    of a table can hold; beyond that Arrow raises an error.
    """
    spark = docs.sparkSession
    missing = sorted({bytes([b]) for b in range(256)} - ranks.keys())
    if missing:
        raise ValueError(f"the ranks lack {len(missing)} single bytes")
    known = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def late(pieces: list[str]) -> pa.Array:
        return pa.array([heap_ids(p.encode(), known.value) for p in pieces], pa.list_(pa.int32()))

    def prepare(ids: pa.ListArray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """By number: the ids joined by spaces, the bytes that they stand for, and how many they are."""
        tokens: list[bytes | None] = [None] * (max(known.value.values()) + 1)
        for token, rank in known.value.items():
            tokens[rank] = token
        if not len(ids):
            return pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int64)
        offsets, flat = ids.offsets, ids.values
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(map(str, range(len(tokens)))).take(flat)), " ")
        raw = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.binary()).take(flat)), b"")
        return texts, raw, pc.list_value_length(ids).to_numpy().astype(np.int64)

    def finish(prepared, ids, sizes, lengths, numbers, _) -> pd.DataFrame:
        texts, raw, n_ids = prepared
        total, ends = np.append(0, np.cumsum(n_ids[numbers])), np.cumsum(lengths)
        out = {"doc_id": nullable(ids), "n_bytes": np.asarray(sizes), "n_tokens": total[ends] - total[ends - lengths]}
        offsets, at = pa.array(np.append(0, ends).astype(np.int32)), pa.array(numbers)
        by_doc = [pc.binary_join(pa.ListArray.from_arrays(offsets, v.take(at)), gap) for v, gap in ((texts, " "), (raw, b""))]
        out |= {"ids_sha256": _digests(by_doc[0]), "decoded_sha256": _digests(by_doc[1])}
        return pd.DataFrame(out | ({"ids": by_doc[0].to_pylist(), "decoded": by_doc[1].to_pylist()} if keep_ids else {}))

    schema = "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded binary" if keep_ids else "")
    once: Callable[[DataFrame], DataFrame] = lambda words: encoded_words(words, ranks)
    return joined_back(docs, splitter(pattern), once, "ids", finish, schema, prepare=prepare, late=(_long(), late), chunk_bytes=32 << 20)


def _digests(values: pa.Array) -> list[str]:
    """The SHA-256 of every value's bytes."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1 + values.offset)[values.offset :].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
