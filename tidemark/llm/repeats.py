"""Removal of byte strings that also start in an earlier document.

The method is the difference-cover one with a cover that the text itself chooses. Any string of LENGTH bytes has one
sampled position, the least hash among the K-byte strings in it (rightmost positions of equal strings count as one), so
equal strings are sampled alike wherever they stand, which is what a difference cover is for.

1. Sample. A document is a row of stretches: runs of LENGTH-byte strings with one sampled K-byte string. Documents are dealt
   into groups; each group sends the hashes of its sampled strings, sorted and without repeats, to buckets.
2. Sort the samples in their buckets. A group hears which of its samples other groups have too, one bit each.
3. Recurse where the sample is shared: those stretches go to the same buckets with their bytes. Stretches equal to one of a
   smaller document are removed; where stretches of one sample differ, their LENGTH-byte strings are named, sorted and
   compared with their neighbours in order. A bucket takes its samples in turn, about SLICE_BYTES of their stretches at a time.
   Of samples with over MANY stretches in all groups together, no bytes but the strings' names go on, each to the bucket of
   the name, so that such a sample is no single task's.

Names are 64-bit hashes, but for samples over MANY compared only among equal samples (38 bits or more), in place of ranks: equality of 50-byte
prefixes is all that is asked, and ranks of all suffixes would need several sorts of every position. README.md says where
this departs from the algorithm with a fixed cover.

Buckets and groups are remainders of hashes, not values, and their number follows the bytes of text. A sample is a least hash, whose
high bits are mostly zero: the bucket is made of its low ones. Most samples are of one
document, so most stretches cost the disk about four bytes, whatever the number of buckets. Of equal stretches a group sends
those of its least document only, so a string that many documents share fills no bucket. A stretch is known by its document's place
among the group's. Null and empty texts lose nothing. A null doc_id is not smaller or larger than any. Rows that repeat a
doc_id do not remove from one another. Texts are of any length and are cut nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_codes, free_name, give_back, mixed, of_text, text_bytes

LENGTH, K = 50, 20
GROUP_BYTES = 4 << 20  # of text, for each group of documents; a bucket holds the samples of about twice that
SLICE_BYTES = 2 << 20  # of text whose positions are hashed at a time
MANY = 1 << 15  # stretches of one sample, over all groups; with more, their strings are dealt by name
_CODES = byte_codes(31)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstd of their byte planes, all in one frame."""
    head = np.array([len(arrays), *(v for a in arrays for v in (a.dtype.num, len(a)))], np.int32).tobytes()
    raw = head + b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a))
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.int32, np.uint64, np.int64)}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), asbytes=True)
    n_arrays = int(np.frombuffer(raw, np.int32, 1)[0])
    out, at = [], 4 + 8 * n_arrays
    for kind, n in np.frombuffer(raw, np.int32, 2 * n_arrays, 4).reshape(-1, 2).tolist():
        dtype = _KINDS[kind]
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Each value less the one before, which np.cumsum undoes."""
    return np.diff(values, prepend=values.dtype.type(0))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each position on, by doubling."""
    part, size, power = _CODES[data], 1, _BASE
    whole, done, left = None, 0, length
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if whole is None:
                    whole, done = part, size
                else:
                    n = max(len(part) - done, 0)
                    whole = whole[:n] * power + part[done : done + n]
                    done += size
            left >>= 1
            if not left:
                return whole[: max(len(data) - length + 1, 0)]
            n = max(len(part) - size, 0)
            part = part[:n] * power + part[size : size + n]
            power, size = power * power, size * 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, start, strings, sample, content) of every stretch; start counts from the document's head."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sample = least(mixed(window_hashes(data, k)), length - k + 1)
    n = len(sample)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = doc[:n] == doc[length - 1 : length - 1 + n]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (sample[1:] != sample[:-1]) | (doc[1:n] != doc[: n - 1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(edge)
    strings = np.diff(np.append(start, n))
    start, strings = start[whole[start]], strings[whole[start]]
    # A run over one sampled string that comes again and again is cut, so that its first and last string hold all its bytes.
    most = length - k + 1
    parts = -(-strings // most)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    strings = np.minimum(np.repeat(strings, parts) - step * most, most)
    start = np.repeat(start, parts) + step * most
    names = window_hashes(data, length)
    return doc[start].astype(np.int64), start - offsets[doc[start]], strings, sample[start], _content(names, start, strings)


def _content(names: np.ndarray, start: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """A hash of all bytes of stretches, from the names of their first and last string."""
    content = names[start] * np.uint64(0xC2B2AE3D27D4EB4F) + names[start + strings - 1] * np.uint64(0x9FB21C651E98DF25)
    return mixed(content + strings.astype(np.uint64))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a row of docs with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 for every row of docs
    (doc_id, text, ...); with_text, the columns of docs with text as it remains (bytes of a character cut in two are left
    out), and n_chars, where docs has it, to match.
    """
    names_out = docs.columns
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_dest = max(12, -(-total // GROUP_BYTES))
    bits = max(6, int(n_dest - 1).bit_length() - 1)
    mark, dest = free_name(docs, "row_mark"), free_name(docs, "row_dest")
    rows = docs if with_text else docs.select("doc_id", "text")
    rows = rows.withColumn(mark, F.xxhash64("doc_id", "text"))
    rows = rows.withColumn(dest, F.pmod(F.col(mark), F.lit(n_dest)).cast("int"))
    blobs = f"bucket int, {dest} int, blob binary"

    def made(found: list[tuple[int, int, bytes]]) -> pa.Table:
        give_back()
        return pa.table({"bucket": pa.array([b for b, _, _ in found], pa.int32()), dest: pa.array([d for _, d, _ in found], pa.int32()), "blob": pa.array([x for _, _, x in found], pa.binary())})

    def told_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
        return list(zip(table.column("bucket").to_pylist(), table.column(dest).to_pylist(), table.column("blob").to_pylist(), strict=True))

    def codes_of(sample: np.ndarray) -> np.ndarray:
        """The bits of a sample that are sent: the low ones, its bucket, before the 32 high ones."""
        return (sample & np.uint64((1 << bits) - 1)) << np.uint64(32) | sample >> np.uint64(32)

    def by_bucket(codes: np.ndarray) -> list[tuple[int, slice]]:
        """The buckets of sorted codes, and where each one's lie."""
        cuts = np.searchsorted(codes, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        return [(int(b), slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]

    def in_order(texts: pa.Table) -> tuple[np.ndarray, ...]:
        """Ids, bytes and offsets of the group's documents; its stretches by sample, content and id, what begins a sample, and which are equal to one of a smaller id."""
        ids, _, data, offsets = _distinct(texts, mark)
        doc, start, strings, sample, content = _sliced(data, offsets, length, k)
        codes = codes_of(sample)
        order = np.lexsort((doc, content, codes))
        doc, start, strings, codes, content = (c[order] for c in (doc, start, strings, codes, content))
        group = _heads(codes)
        head = group | _heads(content)
        later = ids[doc] > ids[doc[head]][np.cumsum(head) - 1]
        return ids, data, offsets, doc, start, strings, codes, group, later

    def sampled(key: tuple, texts: pa.Table) -> pa.Table:
        """The group's samples, and of how many stretches each would send the bytes."""
        *_, codes, group, later = in_order(texts)
        if not len(codes):
            return made([])
        at = np.flatnonzero(group)
        codes, times = codes[at], np.minimum(np.add.reduceat((~later).astype(np.int64), at), 65535).astype(np.uint16)
        return made([(b, key[0].as_py(), pack(steps(codes[own].astype(np.uint32)), times[own])) for b, own in by_bucket(codes)])

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        """Of each group's samples, in order, whether another group has it, and whether it has over MANY stretches."""
        told = told_of(table)
        sent = [unpack(blob) for _, _, blob in told]
        codes = [np.cumsum(c, dtype=np.uint32) for c, _ in sent]
        _, which, groups = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        which = which.ravel()
        many = np.bincount(which, np.concatenate([n for _, n in sent])) > MANY
        cuts = np.cumsum([len(c) for c in codes])[:-1]
        shared, many = np.split((groups > 1)[which], cuts), np.split(many[which], cuts)
        return made([(b, d, pack(np.packbits(s), np.packbits(m))) for (b, d, _), s, m in zip(told, shared, many, strict=True) if s.any() or m.any()])

    def looked(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        """Stretches with a shared sample go to its bucket; those that the group itself finds to be removed, through any bucket."""
        ids, data, offsets, doc, start, strings, codes, group, later = in_order(texts)
        if not len(doc):
            return made([])
        own_dest = key[0].as_py()
        at = np.flatnonzero(group)
        shared, many = np.zeros(len(at), bool), np.zeros(len(at), bool)  # the group's samples, in order, are those it sent
        where = dict(by_bucket(codes[at]))
        for b, _, blob in told_of(told):
            own = where[b]
            shared[own], many[own] = (np.unpackbits(v, count=own.stop - own.start).astype(bool) for v in unpack(blob))
        lowest, highest = np.minimum.reduceat(ids[doc], at), np.maximum.reduceat(np.where(later, ids.min(), ids[doc]), at)
        which = np.cumsum(group) - 1
        ask = (shared | (lowest < highest))[which] & ~later
        by_name = ask & many[which]
        gone, found = [(doc[later], start[later], strings[later])], []
        if by_name.any():
            doc_of, place = np.repeat(doc[by_name], strings[by_name]), _spans(start[by_name], strings[by_name])
            names = _names_at(data, offsets[doc_of] + place, length)
            names, doc_of, place, known = _by_name(names, ids[doc_of], doc_of, place)
            gone.append((doc_of[known], place[known], np.ones(known.sum(), np.int64)))
            names, doc_of, place = names[~known], doc_of[~known], place[~known]
            for b, own in by_bucket(names >> np.uint64(32 - bits)):
                found.append((b, own_dest, b"\2" + pack(steps(names[own]), doc_of[own].astype(np.uint32), ids[doc_of[own]], place[own].astype(np.uint32))))
        told_gone = [np.concatenate(c) for c in zip(*gone, strict=True)]
        if len(told_gone[0]):
            found.append((own_dest % (1 << bits), own_dest, b"\0" + _runs(*told_gone)))
        ask &= ~by_name
        doc, start, strings, codes = (c[ask] for c in (doc, start, strings, codes))
        for b, own in by_bucket(codes):
            put = np.lexsort((start[own], doc[own]))
            d, s, n, code = (c[own][put] for c in (doc, start, strings, codes))
            held = data[_spans(offsets[d] + s, n + (length - 1))]
            found.append((b, own_dest, b"\1" + pack(steps(d.astype(np.uint32)), steps(ids[d]), s.astype(np.uint32), n.astype(np.uint8), code.astype(np.uint32), held)))
        return made(found)

    def compared_strings(key: tuple, table: pa.Table) -> pa.Table:
        told = told_of(table)
        found = [row for row in told if row[2][0] == 0]
        parts, named = [], []
        for _, d, blob in told:
            if blob[0] == 1:
                doc, ids, start, strings, code, held = unpack(blob[1:])
                parts.append((np.full(len(doc), d, np.int32), np.cumsum(doc, dtype=np.uint32), np.cumsum(ids), start, strings, code, held))
            elif blob[0] == 2:
                names, doc, ids, place = unpack(blob[1:])
                named.append((np.full(len(doc), d, np.int32), doc, ids, place, np.cumsum(names, dtype=np.uint64)))
        del told
        gone = []
        if named:
            to, doc, ids, place, names = (np.concatenate(c) for c in zip(*named, strict=True))
            del named
            _, to, doc, place, later = _by_name(names, ids, to, doc, place)
            gone.append((to[later], doc[later], place[later].astype(np.int64), np.ones(later.sum(), np.int64)))
        if parts:
            *columns, data = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            sizes = columns[4].astype(np.int64) + (length - 1)
            order = np.argsort(columns[5], kind="stable")
            at = (np.cumsum(sizes) - sizes)[order]
            columns, sizes = [c[order] for c in columns], sizes[order]
            # Whole samples in turn: a slice ends with the sample that fills it.
            heads = np.flatnonzero(_heads(columns[5]))
            part = (np.cumsum(sizes) - sizes)[heads] // SLICE_BYTES
            edges = [*heads[np.append(True, part[1:] != part[:-1])].tolist(), len(order)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                gone += of_slice(*(c[a:b] for c in columns), data[_spans(at[a:b], sizes[a:b])])
            del data
        if not gone:
            return made(found)
        to, doc, start, strings = (np.concatenate(c) for c in zip(*gone, strict=True))
        order = np.argsort(to, kind="stable")
        to, doc, start, strings = to[order], doc[order], start[order], strings[order]
        edges = np.append(np.flatnonzero(_heads(to)), len(to))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found.append((key[0].as_py(), int(to[a]), b"\0" + _runs(doc[a:b], start[a:b], strings[a:b])))
        return made(found)

    def of_slice(to: np.ndarray, doc: np.ndarray, ids: np.ndarray, start: np.ndarray, strings: np.ndarray, code: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of stretches that lie one after the other in data: (group, document, start, strings) to be removed."""
        start, strings = start.astype(np.int64), strings.astype(np.int64)
        sizes = strings + (length - 1)
        first = np.cumsum(sizes) - sizes
        names = mixed(window_hashes(data, length))
        content = _content(names, first, strings)
        order = np.lexsort((ids, content, code))
        to, doc, ids, start, strings, code, content, first = (c[order] for c in (to, doc, ids, start, strings, code, content, first))
        group = _heads(code)
        head = group | _heads(content)
        later = ids > ids[head][np.cumsum(head) - 1]
        at = np.flatnonzero(group)
        several = (np.add.reduceat(head.astype(np.int64), at) > 1) & (np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at))
        look = several[np.cumsum(group) - 1] & ~later
        gone = [(to[later], doc[later], start[later], strings[later])]
        to, doc, ids, start, strings, code, first = (c[look] for c in (to, doc, ids, start, strings, code, first))
        if len(to):
            which = np.repeat(np.arange(len(to)), strings)
            names, place = names[_spans(first, strings)], _spans(start, strings)
            order = np.lexsort((ids[which], names, code[which]))
            which, names, place = which[order], names[order], place[order]
            head = _heads(code[which]) | _heads(names)
            later = ids[which] > ids[which[head]][np.cumsum(head) - 1]
            which, place = which[later], place[later]
            gone.append((to[which], doc[which], place, np.ones(len(which), np.int64)))
        return gone

    def kept(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not len(texts):
            return result.empty_table()
        data, offsets = _bytes_of(texts.column("text"))
        row = _distinct(texts, mark)[1]
        change = np.zeros(len(data) + 1, np.int32)
        same = _repeated(texts, mark)
        for _, _, blob in told_of(told):
            doc, start, strings = unpack(blob[1:])
            first = offsets[row[np.cumsum(doc, dtype=np.uint32)]] + start
            np.add.at(change, first, 1)
            np.add.at(change, first + strings + (length - 1), -1)
        gone = np.cumsum(change[:-1]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        head[inner] = gone[inner]
        removed, spans = (np.append(0, np.cumsum(v)) for v in (gone, head))
        left = data[~gone]
        del change, gone, head
        give_back()
        at = offsets - removed[offsets]
        by_row = [left[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        from_row = np.array(same)  # rows equal in doc_id and text take the verdict of the first
        by_row = [by_row[r] for r in same]
        counts = {"n_bytes": np.diff(offsets), "n_removed": np.diff(removed[offsets])[from_row], "n_spans": np.diff(spans[offsets])[from_row]}
        if with_text:
            texts_left = [b.decode("utf-8", "ignore") for b in by_row]
            out = {c: texts.column(c) for c in names_out} | {"text": pa.array(texts_left, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts_left]).cast(result.field("n_chars").type)
            return pa.table([out[c] for c in names_out], schema=result)
        out = {"doc_id": texts.column("doc_id")} | {c: pa.array(v.astype(np.int64)) for c, v in counts.items()}
        out["kept_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for b in by_row])
        return pa.table(out).cast(result)

    if with_text:
        from pyspark.sql.pandas.types import to_arrow_schema

        spark_result = docs.schema
        result = to_arrow_schema(spark_result)
    else:
        spark_result = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
        result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    placed = of_text(rows, *rows.columns).repartition(n_dest, dest)
    first = placed.groupBy(dest).applyInArrow(sampled, blobs).groupBy("bucket").applyInArrow(compared, blobs)
    second = placed.groupBy(dest).cogroup(first.groupBy(dest)).applyInArrow(looked, blobs).groupBy("bucket").applyInArrow(compared_strings, blobs)
    return placed.groupBy(dest).cogroup(second.groupBy(dest)).applyInArrow(kept, spark_result)


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _heads(values: np.ndarray) -> np.ndarray:
    """Where values differ from the one before."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def _by_name(names: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """names and columns by name and id, and whether the name has a smaller id too."""
    order = np.lexsort((ids, names))
    names, ids = names[order], ids[order]
    head = _heads(names)
    return names, *(c[order] for c in columns), ids > ids[head][np.cumsum(head) - 1]


def _names_at(data: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """The names of the strings at these positions of data, about SLICE_BYTES of it hashed at a time."""
    names = np.empty(len(where), np.uint64)
    part = where // SLICE_BYTES
    for p in np.unique(part).tolist():
        own = part == p
        names[own] = mixed(window_hashes(data[p * SLICE_BYTES : (p + 1) * SLICE_BYTES + length - 1], length))[where[own] - p * SLICE_BYTES]
    return names


def _runs(doc: np.ndarray, start: np.ndarray, strings: np.ndarray) -> bytes:
    """Strings to remove, packed; stretches that follow one another are one run."""
    order = np.lexsort((start, doc))
    doc, start, strings = doc[order].astype(np.int64), start[order].astype(np.int64), strings[order].astype(np.int64)
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + strings[:-1])))
    return pack(steps(doc[head].astype(np.uint32)), start[head].astype(np.uint32), np.add.reduceat(strings, head).astype(np.uint32))


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.RecordBatch.from_arrays([pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)], ["text"]), "text")


def _distinct(texts: pa.Table, mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, bytes, offsets) of the distinct rows with a doc_id, by doc_id and mark; rows tells the first of each in texts."""
    valid = np.flatnonzero(texts.column("doc_id").is_valid().to_numpy())
    ids, marks = (texts.column(c).take(valid).to_numpy() for c in ("doc_id", mark))
    order = np.lexsort((marks, ids))
    head = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0))[: len(order)]
    rows = order[head]
    return ids[rows], valid[rows], *_bytes_of(texts.column("text").take(valid[rows]))


def _sliced(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> list[np.ndarray]:
    """`stretches`, whole documents of about SLICE_BYTES at a time."""
    part = offsets[:-1] // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        doc, *own = stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, k)
        parts.append((doc + a, *own))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _repeated(texts: pa.Table, mark: str) -> list[int]:
    """For each row, the first row with its (doc_id, mark)."""
    seen: dict[tuple, int] = {}
    return [seen.setdefault(key, r) for r, key in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column(mark).to_pylist(), strict=True))]
