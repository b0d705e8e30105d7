"""Exact top-k inner products by norm-bucketed retrieval.

Components become floor(scale * x). Vectors are grouped by length (quarter octaves of the norm), within a length by their
leading coordinate, and cut in buckets of up to BUCKET. A bucket's summary is its greatest length and the range of each
coordinate in it; queries are cut in blocks in the same way.

1. Seeds: each block meets the SEEDS buckets that bound it highest. The k-th best product found is each query's threshold.
2. Buckets: a block and a bucket part unless some query's threshold can be reached, by the bucket's length or by the ranges
   of its coordinates. Only what is left is copied to the block.
3. In a bucket, a query needs a cosine of its k-th best product over the two lengths: above 1 the bucket is passed over
   (length pruning); from SHARP on, coordinates prune: a vector's COORDINATES largest coordinates of the query must lie in the
   ranges that such a cosine leaves; below it, vectors that are too short are left out. Survivors are verified by products of
   whole numbers.

How much is pruned depends on the vectors: of many lengths or directions most is, of random directions and one length next to
nothing can be. Vectors that are null, or hold null or non-finite components, take no part. Vectors of unequal width are
compared only with those of their own width. Repeated vec_ids are rows of their own, as candidates and as queries; a query's
own row is no candidate, another row with its vec_id is. Ties go to the smaller vec_id. Other columns are not read, and no
queries or no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import give_back, staged

QUERIES, BUCKET, STRIP = 512, 1024, 16
SUMMARIES = 512  # of buckets that one row holds
SHARP, COORDINATES, SEEDS = 0.75, 3, 2


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm, width) of vectors (vec_id, embedding) that take part."""
    cells = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    v = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound).select("vec_id", cells.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("width"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(n, -1)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (row, vec_id, v, norm, width) in blocks of up to `size` of one width and partition, in their order.

    (block, width, n, ids, rows, cells, longest, low, high): low and high are the least and greatest of each coordinate.
    """
    schema = pa.schema([("width", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "cells")), ("longest", pa.float64()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            edges = np.flatnonzero(np.diff(width) != 0) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                for c in range(a, b, size):
                    part = batch.slice(c, min(size, b - c))
                    cells = part.column("v").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
                    one = {
                        "width": int(width[a]), "n": part.num_rows, "ids": part.column("vec_id").to_numpy().tobytes(), "rows": part.column("row").to_numpy().tobytes(),
                        "cells": cells.tobytes(), "longest": float(part.column("norm").to_numpy().max()), "low": cells.min(0).tobytes(), "high": cells.max(0).tobytes(),
                    }
                    yield pa.RecordBatch.from_pylist([one], schema)

    made = rows.mapInArrow(run, "width int, n int, ids binary, rows binary, cells binary, longest double, low binary, high binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def _grouped(found: DataFrame, size: int, name: str) -> DataFrame:
    """found in blocks of alike vectors: one range of (width, length, leading coordinate) a partition; staged, so that blocks keep their numbers."""
    strongest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    lead = F.array_position(F.transform("v", lambda x: F.abs(x)), strongest)
    found = found.withColumns({"band": F.floor(4 * F.log2(F.greatest("norm", F.lit(1.0)))), "lead": lead * F.signum(F.get("v", (lead - 1).cast("int")))})
    order = (F.desc("width"), F.desc("band"), "lead", "vec_id")
    n = max(1, -(-found.count() // (4 * size)))
    return staged(_packed(found.repartitionByRange(n, *order).sortWithinPartitions(*order), size), name)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties to smaller ids; -1 ids stand for none."""
    if scores.shape[1] > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        n = int((scores >= cut).sum(1).max())
        at = np.argpartition(-scores, min(n, scores.shape[1]) - 1, axis=1)[:, :n] if n < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products, in float64 where it holds them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ v.T


NONE = -(2**62)


def search(q: np.ndarray, buckets: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (scores, ids) of each query in buckets of (cells, ids), and the number of products computed.

    Products under floor, a threshold a query, need not be found.
    """
    n, verified = len(q), 0
    best, who = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
    floor = np.full(n, NONE) if floor is None else floor
    q_norm = np.sqrt(np.square(q.astype(np.float64)).sum(1))
    leads = np.argsort(-np.abs(q), axis=1, kind="stable")[:, : min(COORDINATES, q.shape[1])]
    for v, ids in buckets:
        norm = np.sqrt(np.square(v.astype(np.float64)).sum(1))
        longest = norm.max(initial=0)
        least = np.maximum(best[:, -1], floor)
        need = np.where(least == NONE, -np.inf, least.astype(np.float64))
        cosine = np.divide(need, q_norm * longest, out=np.where(need > 0, np.inf, -np.inf), where=q_norm * longest > 0)
        live = np.flatnonzero(cosine <= 1 + 1e-9)
        sharp = cosine[live] >= SHARP
        for own, by_coordinates in ((live[~sharp], False), (live[sharp], True)):
            if not len(own):
                continue
            if by_coordinates:
                # A unit vector at cosine c from the query has each coordinate within c s +- sqrt((1 - c^2) (1 - s^2)) of the query's s.
                unit = np.divide(v, norm[:, None], out=np.zeros(v.shape), where=norm[:, None] > 0)
                c, keep = np.clip(cosine[own], 0, 1)[:, None], np.ones((len(own), len(v)), bool)
                for j in range(leads.shape[1]):
                    s = np.divide(q[own, leads[own, j]], q_norm[own], out=np.zeros(len(own)), where=q_norm[own] > 0)[:, None]
                    spread, at = np.sqrt(np.clip(1 - c**2, 0, 1) * np.clip(1 - s**2, 0, 1)), unit[:, leads[own, j]].T
                    # Below the range only of s, above it only where the cosine may still fall to c.
                    keep &= np.where(s >= 0, at >= c * s - spread - 1e-6, at <= c * s + spread + 1e-6)
                some = np.flatnonzero(keep.any(0))
            else:
                some = np.flatnonzero(norm >= np.divide(need[own], q_norm[own], out=np.full(len(own), -np.inf), where=q_norm[own] > 0).min() - 1e-6)
            if not len(some):
                continue
            verified += len(own) * len(some)
            scores = _products(q[own], v[some])
            all_ids = np.broadcast_to(ids[some][None], scores.shape)
            best[own], who[own] = _best(np.hstack([best[own], scores]), np.hstack([who[own], all_ids]), k)
    return best, who, verified


def bounds(q: np.ndarray, longest: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, buckets): no product of a query with a vector of a bucket is greater, by lengths and by ranges of coordinates."""
    q = q.astype(np.float64)
    by_length = np.sqrt(np.square(q).sum(1))[:, None] * longest[None] * (1 + 1e-12)
    return np.minimum(by_length, np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64))


def _cells(row: dict, name: str = "cells") -> np.ndarray:
    return np.frombuffer(row[name], np.int64).reshape(-1 if row["width"] else row["n"], row["width"])


def _partners(blocks: DataFrame, buckets: DataFrame, floors: DataFrame | None, seeds: int) -> DataFrame:
    """(block, bucket): of each block the `seeds` buckets of the highest bounds, or, with floors, all that may reach them.

    Only summaries of buckets meet the blocks here, SUMMARIES in a row.
    """
    summary = buckets.select(F.struct(F.col("block").alias("bucket"), "width", "n", "longest", "low", "high").alias("s"), F.floor(F.col("block") / 1).alias("_k"))
    n = max(1, -(-buckets.count() // SUMMARIES))
    strips = summary.withColumn("strip", F.pmod(F.xxhash64("_k"), F.lit(n))).groupBy("strip").agg(F.collect_list("s").alias("all"))
    asked = blocks.select("block", "width", "n", "cells")
    asked = asked.withColumn("floors", F.lit(None).cast("binary")) if floors is None else asked.join(floors, "block")
    both = asked.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(strips, "strip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                alike = [s for s in row["all"] if s["width"] == row["width"]]
                if not alike:
                    continue
                low, high = (np.stack([np.frombuffer(s[c], np.int64) for s in alike]) for c in ("low", "high"))
                most = bounds(_cells(row), np.array([s["longest"] for s in alike]), low, high)
                if row["floors"] is None:
                    score = most.max(0)
                else:
                    floor = np.frombuffer(row["floors"], np.int64)
                    score = np.where((most >= floor[:, None] - 1e-6 * np.abs(floor[:, None]) - 1e-6).any(0), most.max(0), -np.inf)
                found = np.flatnonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["block"])), pa.array([alike[k]["bucket"] for k in found], pa.int64()), pa.array(score[found])], ["block", "bucket", "bound"])

    pairs = both.mapInArrow(run, "block long, bucket long, bound double")
    if floors is not None:
        return pairs.select("block", "bucket")
    first = Window.partitionBy("block").orderBy(F.desc("bound"), "bucket")
    return pairs.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= seeds).select("block", "bucket")


def _met(blocks: DataFrame, buckets: DataFrame, pairs: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """(block, place, query_id, row, self, vec_id, score): the k best of each query of a block in the buckets of pairs."""
    strip = F.pmod(F.xxhash64("bucket"), F.lit(STRIP))
    pairs = staged(pairs, "pairs")
    copied = pairs.join(buckets.withColumnRenamed("block", "bucket"), "bucket").withColumn("strip", strip)
    asked = blocks.select("block", "width", "n", "ids", "rows", "cells")
    asked = asked.withColumn("floors", F.lit(None).cast("binary")) if floors is None else asked.join(floors, "block")
    asked = asked.join(pairs.select("block", strip.alias("strip")).distinct(), "block")

    def meet(key: tuple, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        theirs = sorted(theirs.select(["bucket", "width", "n", "ids", "cells", "longest"]).to_pylist(), key=lambda r: (-r["longest"], r["bucket"]))
        for row in ours.to_pylist():
            q = _cells(row)
            floor = None if row["floors"] is None else np.frombuffer(row["floors"], np.int64)
            scores, ids, _ = search(q, [(_cells(r), np.frombuffer(r["ids"], np.int64)) for r in theirs if r["width"] == row["width"]], k, floor)
            real = scores != NONE
            each = real.sum(1)
            own = np.square(q).sum(1)
            out.append((np.full(each.sum(), row["block"]), np.repeat(np.arange(len(q)), each), np.repeat(np.frombuffer(row["ids"], np.int64), each), np.repeat(np.frombuffer(row["rows"], np.int64), each), np.repeat(own, each), ids[real], scores[real]))
        give_back()
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
        return pa.table(dict(zip(("block", "place", "query_id", "row", "self", "vec_id", "score"), map(pa.array, parts), strict=True)))

    schema = "block long, place long, query_id long, row long, self long, vec_id long, score long"
    return asked.groupBy("block", "strip").cogroup(copied.groupBy("block", "strip")).applyInArrow(meet, schema)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of vectors for each row of queries (both vec_id, embedding).

    queries are rows of vectors. k + 1 are searched for, as a query's own row is among them; one row with the query's vec_id
    and its product with itself is then left out. Vectors that are null, empty, or hold a null or a value that is not finite, and
    rows without a vec_id, take no part. Ties go to the smaller vec_id; no queries, or no vectors, give no rows.
    """
    numbered = lambda df: whole(df, scale).withColumn("row", F.monotonically_increasing_id())
    buckets = _grouped(staged(numbered(vectors), "vectors"), BUCKET, "buckets")
    blocks = _grouped(staged(numbered(queries), "queries"), QUERIES, "blocks")
    first = _met(blocks, buckets, _partners(blocks, buckets, None, SEEDS), None, k + 1)
    by_place = Window.partitionBy("block", "place").orderBy(F.desc("score"))
    kth = first.withColumn("_k", F.row_number().over(by_place)).where(F.col("_k") == k + 1).select("block", F.struct("place", "score").alias("p"))
    kth = kth.groupBy("block").agg(F.collect_list("p").alias("all"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                floor = np.full(row["n"], NONE)
                for p in row["all"] or []:
                    floor[p["place"]] = p["score"]
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "floors": [floor.tobytes()]})

    floors = staged(blocks.select("block", "n").join(kth, "block", "left").mapInArrow(filled, "block long, floors binary"), "floors")
    found = _met(blocks, buckets, _partners(blocks, buckets, floors, 0), floors, k + 1)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    found = found.withColumn("own", own).withColumn("_o", F.row_number().over(Window.partitionBy("row", "own").orderBy("vec_id"))).where(~(F.col("own") & (F.col("_o") == 1)))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
