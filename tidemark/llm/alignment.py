"""Cross-tokenizer alignment of two tokenizers' tokens on the same bytes.

One pass over the texts encodes them with both tokenizers, a whole Arrow batch at a time: the tokens of all its documents
stand one after another, their ends are counted once by byte offset (bincount), a group ends where both tokenizers end, and
differences of prefix sums at the documents' own offsets give each document's numbers. Every stretch between two ends of
either kind is one link, the A and B tokens that hold it.

How many documents hold a pair is counted over the whole corpus: a chunk of documents (CHUNK_BYTES of text) gives one row
for each distinct pair with its number of documents, these are summed, and the sums go back to the chunks that hold the
pair. Neither a hot source nor a frequent pair makes a group larger than the number of chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, of_text, staged

CHUNK_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
MAX_KNOWN, MAX_KNOWN_CHARS = 250_000, 1 << 22
SPACE = "▁"
CUT = re.compile(r"(?<=\S) ")
OUT = {"chunk": pa.string(), "number": pa.int32(), "pair": pa.int64(), "held": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "links": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
OUT_DDL = "chunk string, number int, pair long, held long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, links array<int>, times array<int>"


def byte_level_bytes(entry: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary: printable bytes stand for themselves, the others for 256, 257, ..."""
    return bytes(map(_byte_of().__getitem__, entry))


@cache
def _byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: <0xHH> is a byte, the lower block a space."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


class Ragged:
    """Arrays of numbers of unlike lengths, one after another."""

    def __init__(self, rows: list) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        self.values = np.fromiter(chain.from_iterable(rows), np.int32, int(self.sizes.sum()))

    def extend(self, rows: list) -> None:
        more = Ragged(rows)
        self.starts = np.append(self.starts, more.starts + len(self.values))
        self.sizes, self.values = np.append(self.sizes, more.sizes), np.append(self.values, more.values)

    def cut(self, n: int) -> None:
        if n < len(self.sizes):
            self.values = self.values[: self.starts[n]]
            self.sizes, self.starts = self.sizes[:n], self.starts[:n]

    def take(self, which: np.ndarray) -> np.ndarray:
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.values[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Side:
    """One tokenizer: how it encodes pieces, its tokens' bytes, and how ids are written within a group and at its end."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], vocabulary: list[bytes], within: str, last: str) -> None:
        self.encode, self.bytes = encode, Ragged(vocabulary)
        self.within = np.array([f"{k}{within}" for k in range(len(vocabulary))], object)
        self.last = np.array([f"{k}{last}" for k in range(len(vocabulary))], object)

    def agrees(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each document, whether its tokens' bytes are its own (data up to ends)."""
        size = np.diff(np.append(0, ends))
        made_ends = np.append(0, np.cumsum(self.bytes.sizes[ids]))[np.cumsum(counts)]
        made = np.diff(np.append(0, made_ends))
        good = made == size
        if good.all():
            unlike = np.append(0, np.cumsum(self.bytes.take(ids).astype(np.uint8) != data))
            return unlike[ends] == unlike[ends - size]
        kept = ids[np.repeat(good, counts)]
        out = np.zeros(len(ends), bool)
        if good.any():
            out[good] = self.agrees(kept, counts[good], data[np.repeat(good, size)], np.cumsum(size[good]))
        return out


def side_a(tokenizer_json: str) -> Side:
    """A byte-level BPE of the tokenizers library; a piece is encoded after a space."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    made = {k: byte_level_bytes(entry) for entry, k in json.loads(tokenizer_json)["model"]["vocab"].items()}
    encode = lambda pieces: [e.ids for e in tokenizer.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
    return Side(encode, [made.get(k, b"") for k in range(max(made) + 1)], ",", "|")


def side_b(model: bytes) -> Side:
    """A sentencepiece BPE, which puts a space before a piece itself."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    lone = processor.piece_to_id(SPACE)
    names = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    encode = lambda pieces: [i if p else [lone] for p, i in zip(pieces, processor.encode(pieces, num_threads=1), strict=True)]
    return Side(encode, [b"" if processor.is_control(k) or processor.is_unknown(k) else piece_bytes(p) for k, p in enumerate(names)], ",", ";")


class Encoder:
    """Texts to the ids of several tokenizers by pieces, each piece encoded once.

    A text is cut before every space that stands behind a character other than white space. No token of a byte-level BPE with
    the usual pattern, and none of a sentencepiece BPE without pieces of that kind, holds such a place, so that the pieces'
    tokens are the text's.
    """

    def __init__(self, sides: tuple[Side, ...]) -> None:
        self.sides, self.numbers, self.known = sides, _Numbers(), [Ragged([]) for _ in sides]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By tokenizer: the ids of all texts one after another, and how many each has."""
        parts = []
        for text in texts:
            pieces = CUT.split(text)
            parts.append(np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces)))
        new = list(islice(self.numbers, len(self.known[0].sizes), None))
        for a in range(0, len(new), 10_000):
            for side, known in zip(self.sides, self.known, strict=True):
                known.extend(side.encode(new[a : a + 10_000]))
        which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))
        out = [(known.take(which), np.diff(np.append(0, np.cumsum(known.sizes[which]))[ends])) for known in self.known]
        # The first pieces stay known, as frequent ones come early; memory is theirs and one batch's
        chars = sum(map(len, new))
        while len(self.numbers) > MAX_KNOWN or (chars > MAX_KNOWN_CHARS and new):
            last, _ = self.numbers.popitem()
            if chars > MAX_KNOWN_CHARS:
                new.pop()
                chars -= len(last)
        for known in self.known:
            known.cut(len(self.numbers))
        return out


def alignment(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of a batch of texts, each taken after a space: tokens of A and B, groups, links and written groups by document.

    Returns (n_a, n_b, n_groups, n_links, written, pairs of all links), where a pair is A id * 2**32 + B id. Texts that
    either tokenizer does not give back have no tokens.
    """
    n, (a, b) = len(texts), encoder.sides
    raw = [b" " + t.encode() for t in texts]
    ids, counts = zip(*encoder(texts), strict=True)
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    good = a.agrees(ids[0], counts[0], data, np.cumsum(size)) & b.agrees(ids[1], counts[1], data, np.cumsum(size))
    ids = [i[np.repeat(good, c)] for i, c in zip(ids, counts, strict=True)]
    counts = [np.where(good, c, 0) for c in counts]
    ends = np.cumsum(np.where(good, size, 0))
    total = int(ends[-1]) if n else 0
    token_ends = [np.cumsum(side.bytes.sizes[i]) for side, i in zip((a, b), ids, strict=True)]
    at = [np.bincount(e, minlength=total + 1) for e in token_ends]
    both, either = (at[0] > 0) & (at[1] > 0), (at[0] > 0) | (at[1] > 0)
    groups, links = np.cumsum(both), np.cumsum(either)
    upto = [np.append(0, x[ends]) for x in (groups, links)]
    where = np.flatnonzero(either)
    of = [i[np.cumsum(x)[where - 1]] for i, x in zip(ids, at, strict=True)]
    pairs = (of[0].astype(np.int64) << 32) | of[1]
    # A's tokens of a group, then B's, in the order of groups
    group = [groups[e - 1] for e in token_ends]
    ahead = [np.append(0, np.cumsum(np.bincount(g, minlength=int(groups[-1])))) for g in group]
    written = np.empty(len(ids[0]) + len(ids[1]), object)
    written[np.arange(len(ids[0])) + ahead[1][group[0]]] = np.where(both[token_ends[0]], a.last[ids[0]], a.within[ids[0]])
    written[np.arange(len(ids[1])) + ahead[0][group[1] + 1]] = np.where(both[token_ends[1]], b.last[ids[1]], b.within[ids[1]])
    edges = np.append(0, np.cumsum(counts[0] + counts[1]))
    said = ["".join(written[p:q])[:-1] for p, q in zip(edges[:-1], edges[1:], strict=True)]
    return counts[0], counts[1], np.diff(upto[0]), np.diff(upto[1]), said, pairs


@lru_cache(1)
def both(tokenizer_json: str, model: bytes) -> Encoder:
    """Tokenizers and the pieces they know, kept by a worker for its next task."""
    return Encoder((side_a(tokenizer_json), side_b(model)))


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(kind) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in OUT.items()], names=list(OUT))


def tokens_of(docs: DataFrame, tokenizer_json: str, model: bytes, keep_groups: bool, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: (chunk, number, pair, held) for the pairs of a chunk, and the chunk's documents with their links by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = both(tokenizer_json, model)
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk = uuid.uuid4().hex
            pairs, number = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            rows = np.split(number.astype(np.int64), np.cumsum([len(h[0]) for h in held])[:-1])
            docs_of = np.zeros(len(pairs), np.int64)
            for (_, local, document, times, columns), at in zip(held, rows, strict=True):
                numbers = at[local]
                docs_of += np.bincount(numbers, minlength=len(pairs))
                offsets = np.searchsorted(document, np.arange(len(columns["doc_id"]) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (numbers, times)]
                yield _batch(chunk=[chunk] * len(columns["doc_id"]), **columns, links=lists[0], times=lists[1])
            for p in range(0, len(pairs), 50_000):
                part = pairs[p : p + 50_000]
                yield _batch(chunk=[chunk] * len(part), number=np.arange(p, p + len(part)), pair=part, held=docs_of[p : p + len(part)])
            held.clear()
            give_back()

        for batch in cut(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = np.flatnonzero([t != "" for t in texts])
            n_a, n_b, n_groups, n_links, said, pairs = alignment(encoder, [texts[k] for k in own])
            whole = {"doc_id": batch.column("doc_id")}
            for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
                whole[name] = np.zeros(len(texts), np.int64)
                whole[name][own] = values
            groups = [""] * len(texts)
            for k, g in zip(own, said, strict=True):
                groups[k] = g
            whole["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            if keep_groups:
                whole["groups"] = groups
            # Of each document, its distinct pairs and how often each is there
            distinct, number = np.unique(pairs, return_inverse=True)
            document = np.repeat(own, n_links)
            keys, times = np.unique(document * np.int64(max(len(distinct), 1)) + number, return_counts=True)
            held.append((distinct, keys % max(len(distinct), 1), keys // max(len(distinct), 1), times, whole))
            size += batch.nbytes
            if size >= chunk_bytes:
                yield from out()
                size = 0
        if held:
            yield from out()

    return of_text(docs, "doc_id", "text").mapInArrow(run, OUT_DDL)


def aligned(docs: DataFrame, tokenizer_json: str, model: bytes, keep_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if kept) of every row of docs (doc_id, text).

    A is a byte-level BPE of the tokenizers library; B a sentencepiece BPE without pieces that have a space behind another
    character. Both encode a space and the text. A link is a pair of tokens whose byte ranges overlap; its count is the number of rows of docs that hold the
    pair of ids, n_best the links whose count is their A id's highest (ties too), count_sum the sum over links. groups writes
    the ids as a1,a2|b1;a3|b2,b3. Null and empty texts, and those whose bytes a tokenizer does not give back, have no tokens:
    zeros and ''. Repeated rows, and rows without a doc_id, are documents of their own; other columns of docs are not read; an
    empty docs gives no rows. A text of any length is encoded as a whole, in the memory of one task (about 100 bytes a byte).
    """
    rows = staged(tokens_of(docs, tokenizer_json, model, keep_groups, chunk_bytes), "alignment")
    pairs = rows.where(F.col("pair").isNotNull()).select("chunk", "number", "pair", "held")
    documents = rows.where(F.col("pair").isNull()).drop("number", "pair", "held")
    # One or two chunks a task, however many there are
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.where("number = 0").count() // 2)
    count = pairs.groupBy("pair").agg(F.sum("held").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    scored = count.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))
    values = pairs.join(scored, "pair").select(F.col("chunk").alias("of_chunk"), "number", "count", "best").repartition(n, "of_chunk")

    def finish(own: pa.Table, held: pa.Table) -> pa.Table:
        order = np.argsort(own.column("number").to_numpy())
        count, best = (own.column(c).to_numpy()[order] for c in ("count", "best"))
        links, times = (held.column(c).combine_chunks() for c in ("links", "times"))
        number, times = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(links.value_lengths().to_numpy()))
        sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (times * best[number], times * count[number])]
        return held.drop_columns(["chunk", "links", "times"]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long"
    out = values.groupBy("of_chunk").cogroup(documents.repartition(n, "chunk").groupBy("chunk")).applyInArrow(finish, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else []))
