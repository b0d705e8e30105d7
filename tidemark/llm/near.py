"""Near-duplicates by BagMinHash: weighted Jaccard of the multisets of five-word shingles.

Signatures. A shingle's weight is its count. For every shingle a Poisson process over (time, signature position, weight
level) is defined by the shingle's hash alone; the weight axis is cut in dyadic blocks [0, 1), [1, 2), [2, 4), ... A text
takes the points whose level lies under its weight, and component i of its signature is the first such point of position
i. Two texts agree in a component with probability equal to their weighted Jaccard similarity. Times past the point where
all components must have been hit are not generated; where some component was missed, a later time is tried.

Candidates agree in a whole band of components; every candidate pair is then verified exactly on the shingle counts.

Only one of each set of texts with equal word sequences (`key`) takes part; the copies are joined back at the end, never
paired. Pairs of a bucket are not listed. Each text meets the centre of each of its buckets, the text that shares most
bands in all (`centre_pairs`); verified links make components. What is left are the pairs of a bucket in two components:
they go through an exact prefix and positional filter on their shingles (`crossing_pairs`), so that none as similar as the
threshold is lost. One shared band makes a candidate in buckets of any size, and rows grow with texts, not with pairs.

Texts of under five words are their own single shingle; texts without words (null, empty) group with nothing. Very long
texts are cut nowhere. Rows that repeat a doc_id with different texts are one class; equal rows are copies. Columns of docs
but doc_id and text are not read; those of keep_one's input come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, free_name, give_back, mixed, of_text, small, staged, text_bytes, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
M = BANDS * ROWS
SLOTS = 1 << 18  # of the table that orders shingles by how many texts hold them
MAX_IDS = 2_000_000  # candidates' ids that may be broadcast: 16 MB; more are joined by a shuffle
_MULT = np.random.default_rng(21).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles of texts whose word hashes are words[at[k]:at[k + 1]]."""
    n = np.diff(at)
    sizes = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), sizes)
    start = np.repeat(at[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = np.zeros(len(start), np.uint64)
    for k in range(WORDS):
        inside = k < n[text]
        h = (h ^ np.where(inside, words[np.minimum(start + k, max(len(words) - 1, 0))], np.uint64(0))) * _MULT[k]
        h ^= h >> np.uint64(29)
    h = mixed(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(seed: np.ndarray, rate: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(process, time, bits) of the first points, then the second ones, ... of Poisson processes up to a time each."""
    live = np.arange(len(seed))
    time, state = np.zeros(len(seed)), seed.copy()
    while len(live):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(_uniform(state)) / rate[live]
        stay = time < until[live]
        live, time, state = live[stay], time[stay], state[stay]
        if len(live):
            yield live, time, mixed(state ^ np.uint64(0xA24BAED4963EE407))


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """(n_texts, M) signature components as 32-bit codes; 0 throughout for texts without shingles."""
    level = np.zeros(len(count), np.int64) if not len(count) else np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0)
    item = np.repeat(np.arange(len(h)), level + 1)
    block = np.arange(len(item)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(block > 0, 2.0 ** np.maximum(block - 1, 0), 0.0)
    width = np.where(block > 0, low, 1.0)
    seed = mixed(h[item] + block.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    weight, owner = count[item].astype(np.float64), text[item]
    total = np.bincount(text, count, n_texts)
    best = np.full(n_texts * M, np.inf)
    code = np.zeros(n_texts * M, np.uint64)
    reach = np.log(M) + 3.0  # components not hit by this time are hit later, in another round
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[owner])
        until = reach / total[owner[own]]
        # A process of all M components has M times a component's rate; times are in units of one component.
        for live, time, bits in _points(seed[own], width[own] * M, until):
            row = own[live]
            inside = low[row] + width[row] * _uniform(mixed(bits)) < weight[row]
            row, time, bits = row[inside], time[inside], bits[inside]
            slot = owner[row] * M + (bits % np.uint64(M)).astype(np.int64)
            order = np.lexsort((time, slot))
            slot, time, bits = slot[order], time[order], bits[order]
            head = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
            slot, time, bits = slot[head], time[head], bits[head]
            better = time < best[slot]
            best[slot[better]], code[slot[better]] = time[better], bits[better]
        full = np.isfinite(best.reshape(n_texts, M)).all(1)
        todo &= ~full
        reach *= 2
    return (code >> np.uint64(32)).astype(np.uint32).reshape(n_texts, M)


def signed(docs: DataFrame) -> DataFrame:
    """(key, text_id, id, total, bands) of docs (doc_id, text); id is the doc_id.

    key stands for the word sequence (null without words), text_id is 64 of its bits, total is the number of shingles and
    bands the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", 3 << 20):
            words, at = word_hashes(*text_bytes(batch, "text"))
            text, h, count = shingles(words, at)
            codes = signatures(text, h, count, batch.num_rows).astype(np.uint64)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mixed(bands * np.uint64(31) + codes[:, r::ROWS] + np.uint64(r + 1))
            total = np.bincount(text, count, batch.num_rows).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS, pa.array(bands.view(np.int64).ravel()))
            keys = _keys(words, at)
            yield pa.RecordBatch.from_arrays([keys, _text_ids(keys), batch.column("doc_id"), pa.array(total), lists], ["key", "text_id", "id", "total", "bands"])
        give_back()

    return of_text(docs, "doc_id", "text").mapInArrow(run, "key binary, text_id long, id long, total long, bands array<long>")


def _keys(words: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits for each text's word sequence; null for texts without words."""
    n = np.diff(at)
    k = (np.arange(len(words)) - np.repeat(at[:-1], n)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    some = np.flatnonzero(n)
    out: list[bytes | None] = [None] * len(n)
    if len(some):
        a = mixed(np.add.reduceat(words * mixed(k), at[some]) + n[some].astype(np.uint64))
        b = mixed(np.add.reduceat(mixed(words ^ k) * k, at[some]))
        for i, x, y in zip(some.tolist(), a.tolist(), b.tolist(), strict=True):
            out[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
    return pa.array(out, pa.binary())


def _text_ids(keys: pa.Array) -> pa.Array:
    """The first 64 bits of every key."""
    return pa.array([None if k is None else int.from_bytes(k[:8], "big", signed=True) for k in keys.to_pylist()], pa.int64())


def _bag(h: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted shingle hashes, their upper 48 bits, and the counts over 1."""
    more = np.flatnonzero(count > 1).astype(np.uint32)
    parts = [np.array([len(h), len(more)], np.uint32), (h >> np.uint64(32)).astype(np.uint32), (h >> np.uint64(16)).astype(np.uint16), more, count[more].astype(np.uint32)]
    return b"".join(p.tobytes() for p in parts)


def _opened(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(v) for v in np.frombuffer(bag, np.uint32, 2))
    h = (np.frombuffer(bag, np.uint32, n, 8).astype(np.uint64) << np.uint64(16)) | np.frombuffer(bag, np.uint16, n, 8 + 4 * n)
    count = np.ones(n, np.int64)
    count[np.frombuffer(bag, np.uint32, m, 8 + 6 * n)] = np.frombuffer(bag, np.uint32, m, 8 + 6 * n + 4 * m)
    return h, count


def _counted(docs: DataFrame) -> DataFrame:
    """(id, bag) of docs (text), one row a text_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", 3 << 20):
            words, at = word_hashes(*text_bytes(batch, "text"))
            text, h, count = shingles(words, at)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            bags = [_bag(h[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_text_ids(_keys(words, at)), pa.array(bags, pa.binary())], ["id", "bag"])
        give_back()

    return of_text(docs, "text").mapInArrow(run, "id long, bag binary").groupBy("id").agg(F.first("bag").alias("bag"))


def _similar(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags have a weighted Jaccard similarity of threshold or more."""

    @F.pandas_udf("double")
    def jaccard(x, y):
        import pandas as pd

        def one(p: bytes, q: bytes) -> float:
            (hp, cp), (hq, cq) = _opened(p), _opened(q)
            at = np.minimum(np.searchsorted(hp, hq), max(len(hp) - 1, 0))
            both = np.minimum(cp[at], cq)[hp[at] == hq].sum() if len(hp) and len(hq) else 0
            total = cp.sum() + cq.sum() - both
            return float(both / total) if total else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    left = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(jaccard("bag_a", "bag_b") >= threshold).select("a", "b")


def shared_bands(reps: DataFrame) -> DataFrame:
    """(bucket, id, total, n): a row for each band that a text of reps (id, total, bands) shares with n - 1 others."""
    rows = reps.select("id", "total", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id", "total")
    return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")


def centre_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: each text with the centre of each of its buckets, once.

    A bucket's centre is the text that shares most bands with others in all. The original of a family of edited copies
    does, so that most of its copies meet the one text to which they are nearest, whichever bands they kept.
    """
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id", "total")).alias("centre"))
    rows = shared.join(centres, "bucket").where((F.col("id") != F.col("centre.id")) & _alike(F.col("total"), F.col("centre.total"), threshold))
    return rows.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


def _alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether multisets of x and y shingles can be as similar as threshold."""
    return F.least(x, y) >= threshold * F.greatest(x, y)


def components(links: DataFrame) -> DataFrame:
    """(id, class) of all ids in links (a, b): the least id each is linked to over any number of links."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class"))
    found = staged(found, "classes")
    while True:
        near = edges.join(found.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("class").alias("m")).withColumnRenamed("a", "id")
        lower = found.join(near, "id").select("id", F.least("class", "m").alias("class"), (F.col("m") < F.col("class")).alias("fell"))
        lower = staged(lower, "classes")
        if lower.where("fell").isEmpty():
            return lower.drop("fell")
        jump = lower.select(F.col("id").alias("class"), F.col("class").alias("next"))
        found = staged(lower.join(jump, "class").select("id", F.col("next").alias("class")), "classes")


def _texts(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of docs that stand for ids, and others of the same doc_id, where it has several."""
    wanted = staged(reps.join(small(ids, MAX_IDS), "id", "left_semi").select("doc_id").distinct(), "wanted")
    return docs.where("doc_id is not null").join(small(wanted, MAX_IDS), "doc_id", "left_semi").select("text")


def crossing_pairs(bags: DataFrame, rest: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b), a < b, of rest (id, total, class) in different classes that may be as similar as threshold.

    Shingles are put in one order, that of the counts of their slots (rarest first) and then their hashes. Two texts as
    similar as threshold share a shingle; from the first they share on, both hold all that they share. So that one lies
    where at least threshold of the text's total is left (prefix filter), and both have enough left there for the overlap
    that the threshold asks of the two totals (positional filter). The order decides only how many pairs pass: what a copy
    has that no other text has comes first, so a copy that was changed too much has used up its prefix before it reaches
    what the family shares.
    """
    own = staged(bags.join(small(rest, MAX_IDS), "id"), "rest")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                n += np.bincount((_opened(bag)[0] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])
        give_back()

    counts = np.zeros(SLOTS, np.int64)
    seen = own.select("bag").mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    order_of = bags.sparkSession.sparkContext.broadcast(counts)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for bag in batch.column("bag").to_pylist():
                h, count = _opened(bag)
                order = np.lexsort((h, order_of.value[(h % np.uint64(SLOTS)).astype(np.int64)]))
                h, count = h[order], count[order]
                left = count.sum() - (np.cumsum(count) - count)
                head = left >= threshold * count.sum() * (1 - 1e-12)
                parts.append((h[head].view(np.int64), left[head]))
                sizes.append(int(head.sum()))
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            h, left = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "total", "class")), pa.array(h), pa.array(left)], ["id", "total", "class", "shingle", "left"])
        give_back()

    found = staged(own.mapInArrow(heads, "id long, total long, class long, shingle long, left long"), "heads")
    several = found.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("shingle")
    found = found.join(several, "shingle", "left_semi")
    x, y = found.alias("x"), found.alias("y")
    least_common = F.lit(threshold / (1 + threshold) * (1 - 1e-12)) * (F.col("x.total") + F.col("y.total"))
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.class") != F.col("y.class"))
    near = same & _alike(F.col("x.total"), F.col("y.total"), threshold) & (F.least("x.left", "y.left") >= least_common)
    return x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def similar_pairs(docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b), a < b, of reps (id, doc_id, total, bands): enough to join all that candidates link."""
    shared = staged(shared_bands(reps), "shared")
    pairs = staged(centre_pairs(shared, threshold), "pairs")
    bags = staged(_counted(_texts(docs, reps, shared.select("id").distinct())), "bags")
    links = staged(_similar(pairs, bags, threshold), "links")
    rows = shared.join(components(links), "id", "left").select("bucket", "id", "total", F.coalesce("class", "id").alias("class"))
    apart = rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket")
    rest = staged(rows.join(apart, "bucket", "left_semi").select("id", "total", "class").distinct(), "rest")
    more = staged(crossing_pairs(bags, rest, threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(staged(_similar(more, bags, threshold), "links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_size for every row of docs (doc_id, text, ...).

    class_id is the least doc_id of the rows that copies and links of threshold or more join to this one. Rows without
    words or without a doc_id are classes of their own (class_id is the doc_id).
    """
    signs = staged(signed(docs), "signs")
    usable = signs.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    reps = usable.groupBy("key").agg(F.min("text_id").alias("text_id"), F.min("id").alias("doc_id"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    reps = staged(reps.withColumnRenamed("text_id", "id"), "reps")
    links = similar_pairs(docs, reps.drop("key"), threshold)
    # One doc_id may stand on rows of several texts: they are one class.
    one = usable.groupBy("id").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a < b").select("id", "a")
    one = usable.join(one, "id").where("text_id > a").select("a", F.col("text_id").alias("b")).distinct()
    found = components(links.unionByName(one))
    least = reps.join(found, "id").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    found = found.join(least, "class").select("id", "class_id")
    classes = reps.select("key", "id", "doc_id").join(found, "id", "left").select("key", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = signs.select("key", F.col("id").alias("doc_id")).join(classes, "key", "left")
    out = staged(out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("class_id").isNotNull()).alias("grouped")), "members")
    sizes = out.where("grouped").groupBy("class_id").agg(F.count("*").alias("class_size"))
    joined = out.join(sizes.where("class_size > 1").withColumn("grouped", F.lit(True)), ["class_id", "grouped"], "left")
    return joined.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, but one row only of each class of near_duplicates: its least doc_id's.

    Of rows that repeat that doc_id, the one with the least text stays. Rows without words or without a doc_id all stay.
    """
    members = near_duplicates(docs.select("doc_id", "text"), threshold)
    gone = staged(members.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone, MAX_IDS), "doc_id", "left_anti").select(*docs.columns)
    again = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    place = free_name(docs, "place")
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    several = kept.where(worded).join(again, "doc_id", "left_semi")
    first = several.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1).select(*docs.columns)
    rest = kept.where(~worded).unionByName(kept.where(worded).join(again, "doc_id", "left_anti").select(*docs.columns))
    return rest.unionByName(first)
