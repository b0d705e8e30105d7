"""Class-conditional Kneser-Ney models of toxic and ordinary text.

A word is read as a chain: its first 4 bytes, 6, 8, and the whole word, each given the one before. The words of all
labelled training rows are counted exactly, by class. Each link of the chain has the class's share, discounted by what the
numbers of links seen once and twice give, and what
the discount frees goes to one backoff that the classes share: a link's share of the distinct words that its parent
begins. A word that is rare or new is therefore scored by the longest beginning known, and past that the classes differ
only in how readily they back off. A text's log-likelihood ratio is normalised by its length; a logistic curve, fitted
on training rows that the counts leave out, turns it into a score.

Nothing of the corpus is kept in a table of fixed size, and no word is dropped. The distinct words of all documents go down
the chain by joins, and come back to the documents in chunks (`pieces.through_one_exchange`), as pre-tokens do for token
counts. Words stand apart by 128 bits: 32 for each beginning and 32 for the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, held_out, label_of, of_text, small, staged, text_bytes, word_hashes
from tidemark.llm.pieces import CHUNK_BYTES, GROUP_WORDS, batch_of, chunk_name, nullable, packed, tagged_ddl, through_one_exchange

HEADS = (4, 6, 8)
WORD = {"head": pa.int64(), "tail": pa.int64()}
LEAST_DISCOUNT, MOST_DISCOUNT = 0.5, 0.98
STRONG = 1.5
MAX_LINKS = 1_000_000  # links of the chain that may be broadcast: about 100 MB as a hash table; more are joined by a shuffle
MAX_LABELS = 4_000_000  # rows of (doc_id, label) that may be broadcast: 64 MB


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of the batch's texts, (beginnings of 4 and 6 bytes, beginning of 8 and the whole), and the texts' n + 1 offsets in them."""
    whole, at, *heads = word_hashes(*text_bytes(batch, "text"), HEADS)
    upper = lambda h: h & np.uint64(0xFFFFFFFF00000000)
    lower = lambda h: h >> np.uint64(32)
    return np.stack([upper(heads[0]) | lower(heads[1]), upper(heads[2]) | lower(whole)], axis=1).view(np.int64), at


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of words, and which of them each row is."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    ranked = words[order]
    head = np.append(True, (ranked[1:] != ranked[:-1]).any(1))
    which = np.empty(len(words), np.int64)
    which[order] = np.cumsum(head) - 1
    return ranked[head], which


def word_counts(docs: DataFrame) -> DataFrame:
    """(head, tail, toxic, plain): counts of words in docs (text, label); summed in each task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            words, label = (np.concatenate(c) for c in zip(*held, strict=True))
            own, which = _distinct(words)
            toxic = np.bincount(which, label, len(own)).astype(np.int64)
            plain = np.bincount(which, minlength=len(own)) - toxic
            for a in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (own[:, 0], own[:, 1], toxic, plain)], ["head", "tail", "toxic", "plain"])

        for batch in cut(batches, "text"):
            words, at = words_of(batch)
            held.append((words, np.repeat(batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield from out()
                held.clear()
        if held:
            yield from out()
        give_back()

    rows = of_text(docs, "text", "label").mapInArrow(run, "head long, tail long, toxic long, plain long")
    return rows.groupBy("head", "tail").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _discounts(links: DataFrame) -> dict[str, float]:
    """Of each class n1 / (n1 + 2 n2), where n1 links stand once and n2 twice; four numbers."""
    n = links.agg(*[F.count_if(F.col(kind) == k).alias(f"{kind}{k}") for kind in ("toxic", "plain") for k in (1, 2)]).first()
    made = {kind: n[f"{kind}1"] / max(n[f"{kind}1"] + 2 * n[f"{kind}2"], 1) for kind in ("toxic", "plain")}
    return {kind: min(max(d, LEAST_DISCOUNT), MOST_DISCOUNT) for kind, d in made.items()}


def word_ratios(words: DataFrame, counts: DataFrame) -> DataFrame:
    """words (head, tail, home) with ratio: log P(toxic) - log P(plain) of every word by the counts (head, tail, toxic, plain).

    words in the counts or not go down the chain together. A link without counts takes the ratio of backing off after its
    parent, and its descendants keep it.
    """
    levels = [F.shiftrightunsigned("head", 32), F.col("head"), F.shiftrightunsigned("tail", 32), F.col("tail")]
    links = [f"link{k}" for k in range(len(levels))]
    keys = lambda k: ["link0"] if k == 0 else ["link1"] if k == 1 else ["link1", "link2"] if k == 2 else ["link1", "link3"]
    named = lambda df: df.withColumns(dict(zip(links, levels, strict=True)))
    counts = staged(named(counts), "counts")
    sums = lambda *by: counts.groupBy(*by).agg(
        F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), F.count("*").alias("kinds"), F.count_if(F.col("toxic") > 0).alias("toxic_kinds"), F.count_if(F.col("plain") > 0).alias("plain_kinds")
    )

    discounts = [_discounts(sums(*keys(k))) for k in range(len(levels))]

    def back(kind: str, p: str, k: int) -> Column:
        """The share that a class's discount of links k frees after parent p; all of it after one that the class lacks."""
        return F.when(F.col(f"{p}{kind}") > 0, discounts[k][kind] * F.col(f"{p}{kind}_kinds") / F.col(f"{p}{kind}")).otherwise(F.lit(1.0))

    def share(kind: str, k: int) -> Column:
        own = F.when(F.col(f"p_{kind}") > 0, F.greatest(F.col(kind) - discounts[k][kind], F.lit(0.0)) / F.col(f"p_{kind}")).otherwise(F.lit(0.0))
        return own + back(kind, "p_", k) * F.col("kinds") / F.col("p_kinds")

    columns = ("toxic", "plain", "kinds", "toxic_kinds", "plain_kinds")
    root = sums().na.fill(0)
    both = (F.col("toxic") > 0) & (F.col("plain") > 0)
    unseen = F.when(both, F.log((F.col("toxic_kinds") / F.col("toxic")) / (F.col("plain_kinds") / F.col("plain")))).otherwise(0.0)
    above, by = root.select(*(F.col(c).alias(f"p_{c}") for c in columns), F.lit(0.0).alias("upto"), unseen.alias("p_back")), []  # one row
    for k in range(len(levels)):
        own = sums(*keys(k), *([links[k - 1]] if k and links[k - 1] not in keys(k) else []))
        linked = own.join(above, by) if by else own.join(above)
        linked = linked.withColumn("upto", F.col("upto") + F.log(share("toxic", k) / share("plain", k)))
        made = F.col("upto") + F.log(back("toxic", "", k + 1) / back("plain", "", k + 1)) if k < len(levels) - 1 else F.col("upto")
        by = keys(k)
        # The ratio of what backs off after this link; of the last link, of the word itself.
        above = staged(linked.select(*by, *(F.col(c).alias(f"p_{c}") for c in columns), "upto", made.alias("p_back")), f"chain{k}")
        found = above.select(*by, F.col("p_back").cast("float").alias("found"))
        asked = words.select("head", "tail", "home", *([] if k == 0 else ["ratio"]), *[levels[int(link[-1])].alias(link) for link in by])
        before = F.lit(None).cast("float") if k == 0 else F.col("ratio")
        words = asked.join(small(found, MAX_LINKS), by, "left").select("head", "tail", "home", F.coalesce("found", before).alias("ratio"))
    start = root.select(unseen.cast("float").alias("unseen"))
    return words.join(start).select("head", "tail", "home", F.coalesce("ratio", "unseen").alias("ratio"))


def _tagged(docs: DataFrame, chunk_bytes: int = 2 * CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) as `pieces.tagged` gives them, with words of two numbers in place of pieces, counted by document."""

    def out(task: int, at: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, sizes, words, lengths = [i for h in held for i in h[0]], [n for h in held for n in h[1]], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        own, which = _distinct(words)
        chunk = chunk_name(task, at, own.tobytes())
        for a in range(0, len(own), 50_000):
            part = own[a : a + 50_000]
            yield batch_of(WORD, head=part[:, 0], tail=part[:, 1], home=np.zeros(len(part), np.int64), chunk=np.full(len(part), chunk), number=np.arange(a, a + len(part), dtype=np.int32))
        pairs, n = np.unique(np.repeat(np.arange(len(ids)), lengths) * max(len(own), 1) + which, return_counts=True)
        doc, number = pairs // max(len(own), 1), pairs % max(len(own), 1)
        each = np.bincount(doc, minlength=len(ids))
        ends = np.cumsum(each)
        part = ends // GROUP_WORDS
        for p in np.unique(part):
            docs_of = np.flatnonzero(part == p)
            a, b = int(docs_of[0]), int(docs_of[-1]) + 1
            span = slice(ends[a] - each[a], ends[b - 1])
            blob = pickle.dumps((len(own), ids[a:b], sizes[a:b], each[a:b], packed(number[span]), packed(n[span])))
            yield batch_of(WORD, home=[chunk], chunk=[chunk], number=[a], blob=[blob])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, held = TaskContext.get().partitionId(), 0, []
        for batch in cut(batches, "text"):
            words, offsets = words_of(batch)
            sizes = np.diff(text_bytes(batch, "text")[1]).tolist()
            held.append((batch.column("doc_id").to_pylist(), sizes, words, np.diff(offsets)))
            at += 1
            if sum(sum(h[1]) for h in held) >= chunk_bytes:
                yield from out(task, at, held)
                held.clear()
                give_back()
        if held:
            yield from out(task, at + 1, held)
            held.clear()
        give_back()

    return of_text(docs, "doc_id", "text").mapInArrow(run, tagged_ddl(WORD))


def measured(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, mean, strong, n) of docs (doc_id, text): the mean ratio of a text's words, the mean with only those above STRONG, and the number of words."""

    def finish(ratio: np.ndarray, ids, sizes, lengths, numbers, n) -> pd.DataFrame:
        ends, n = np.cumsum(lengths), n.astype(np.float64)
        sums = [np.append(0, np.cumsum(v)) for v in (ratio[numbers] * n, np.where(ratio[numbers] > STRONG, ratio[numbers], 0) * n, n)]
        total, strong, words = (v[ends] - v[ends - lengths] for v in sums)
        return pd.DataFrame({"doc_id": nullable(ids), "mean": total / np.maximum(words, 1), "strong": strong / np.maximum(words, 1), "n": words.astype(np.int64)})

    once = lambda words: word_ratios(words, counts)
    return through_one_exchange(_tagged(docs), WORD, once, "ratio", finish, "doc_id long, mean double, strong double, n long", prepare=lambda r: r.to_numpy().astype(np.float64))


def _curve(mean: np.ndarray, strong: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The inputs of the logistic curve: length-normalised ratios, as they are and against their chance scatter."""
    root = np.sqrt(np.maximum(n, 1))
    return np.column_stack([np.ones(len(n)), np.clip(mean, -1, 1), np.clip(strong, 0, 1), np.clip(mean * root, -8, 8), np.clip(strong * root, 0, 8), np.log1p(n)])


SCALE = np.array([1, 0.1, 0.1, 1.0, 1.0, 1.0])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    x = x / SCALE
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, max_fit: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3) and ratio for every row of docs (doc_id, text, ...).

    Of the training rows, one fold fits the curve (no more than max_fit rows, those of the least hash) and the others, all
    of them, are counted. Null and empty texts have a ratio of 0 and get a score like any other; repeated rows are scored
    each; a null doc_id is not held out and has no label; other columns of docs are not read; an empty docs gives no rows,
    and without labels of both classes every ratio is that of equal models. Texts are of any length.
    """
    curve_fold = (fold + 1) % folds
    own = label_of(labels, "toxic").where(~held_out(F.col("doc_id"), folds, fold))
    counted = own.where(~held_out(F.col("doc_id"), folds, curve_fold))
    texts = docs.select("doc_id", "text")
    counts = word_counts(texts.join(small(counted, MAX_LABELS), "doc_id").select("text", "label"))
    found = staged(measured(texts, counts), "measured")
    fitted = own.where(held_out(F.col("doc_id"), folds, curve_fold)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    rows = found.join(F.broadcast(fitted), "doc_id").select("label", "mean", "strong", "n").toArrow()  # bounded by max_fit
    x, y = _curve(*(rows.column(c).to_numpy() for c in ("mean", "strong", "n"))), rows.column("label").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the fit must not depend on the order in which rows arrive
    beta = [float(v) for v in fit_curve(x[order], y[order]) / SCALE] if len(y) else [0.0] * len(SCALE)
    root = F.sqrt(F.greatest("n", F.lit(1)))
    clip = lambda c, a, b: F.greatest(F.least(c, F.lit(float(b))), F.lit(float(a)))
    inputs = [F.lit(1.0), clip(F.col("mean"), -1, 1), clip(F.col("strong"), 0, 1), clip(F.col("mean") * root, -8, 8), clip(F.col("strong") * root, 0, 8), F.log1p("n")]
    z = sum((b * c for b, c in zip(beta[1:], inputs[1:], strict=True)), F.lit(beta[0]))
    scored = found.withColumn("score", 1 / (1 + F.exp(-clip(z, -30, 30))))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("mean").alias("ratio"))
