"""Temperature mixing of sources, realised as budgeted block permutations. Only DataFrame functions are used.

A source's weight is its share of all tokens to the power alpha, normalised. Bisection finds the largest alpha of at most
1 whose weights have the target entropy (a share of the most that so many sources can have); a second bisection finds the
least alpha at which no source is repeated more than max_repeats times; the larger of the two is used. A source's budget
is its weight of the token budget: whole epochs of the source, then the part of one more.

A source is cut in blocks of about block_tokens by a hash of its rows. Each epoch permutes the blocks and the rows in
them: a row of an epoch has its block's place and its own place in the block, which are hashes that give the order. In the last epoch blocks are taken in the permutation's order while they fit; of the one block that fits in part,
rows are taken while they fit. So only sums of blocks, and the rows of one block a source, are ever ordered together.

Tokens are runs of characters other than white space; null and empty texts have none and come with their block. A
source without any token has no weight, so none of its rows is taken. A null source is a source of its own. Rows that repeat are rows of their own; rows equal in doc_id and text stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import small

STEPS = 48
SLACK, LEAST_SLACK = 1e-12, 1e-6  # of a budget's part, and of a token, that the bisection may miss
RANGE_DIGITS = 3  # hex digits of a place that make a range
MAX_SOURCES, MAX_BLOCKS = 100_000, 500_000  # rows that may be broadcast


def _bisected(low: float, high: float, holds) -> Column:
    """The end of a bisection of [low, high]: holds(alpha) is true at low and turns false once."""
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return F.when(holds(middle), F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: (s["low"] + s["high"]) / 2)


def _powers(shares: Column, alpha: Column) -> Column:
    return F.transform(shares, lambda p: F.pow(p, alpha))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def source_weights(sizes: DataFrame, entropy_share: float = 0.97, max_repeats: float = 4.0, budget: int | None = None) -> DataFrame:
    """(source_key, n_tokens, alpha, weight, budget) from (source_key, n_tokens): one row a source.

    budget is the number of tokens asked for in all; None asks for as many as there are. Where it is above max_repeats times all
    tokens no weights can keep the limit, and sources are taken in proportion. alpha and weight are told to 9 digits; budgets are of
    the unrounded ones, so that the smallest source keeps its part, and what falls short of a whole token by no more than the
    bisection's own error is one: a source at max_repeats gets all its epochs.
    """
    one = sizes.where("n_tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source_key", "n_tokens"))).alias("all"))
    one = one.withColumn("total", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"]))
    one = one.withColumn("shares", F.transform("all", lambda x: x["n_tokens"] / F.col("total")))
    asked = F.col("total") if budget is None else F.lit(budget).cast("long")

    def entropy(alpha: Column) -> Column:
        # Of weights w / z: log z - sum(w log w) / z
        w = _powers(F.col("shares"), alpha)
        return F.log(_sum(w)) - _sum(F.transform(w, lambda x: x * F.log(x))) / _sum(w)

    def repeats(alpha: Column) -> Column:
        # Of a source: weight * asked / tokens; the most is the smallest source's, for alpha below 1
        w = _powers(F.col("shares"), alpha)
        return F.array_max(F.zip_with(w, "all", lambda x, s: x / s["n_tokens"])) / _sum(w) * asked

    target = F.lit(entropy_share) * F.log(F.size("all").cast("double"))
    by_entropy = _bisected(0.0, 1.0, lambda a: entropy(a) >= target)
    by_repeats = _bisected(0.0, 1.0, lambda a: repeats(a) > max_repeats)
    by_repeats = F.when(repeats(F.lit(0.0)) <= max_repeats, 0.0).otherwise(by_repeats)
    by_entropy = F.when(entropy(F.lit(1.0)) >= target, 1.0).otherwise(by_entropy)
    one = one.withColumn("alpha", F.greatest(by_entropy, by_repeats)).withColumn("powers", _powers(F.col("shares"), F.col("alpha")))
    one = one.withColumn("powers_sum", _sum(F.col("powers"))).withColumn("asked", asked)
    rows = one.select("alpha", "powers_sum", "asked", F.explode(F.arrays_zip("all", "powers")).alias("s"))
    weight = F.col("s.powers") / F.col("powers_sum")
    budgets = F.floor(weight * F.col("asked") * (1 + SLACK) + LEAST_SLACK)
    return rows.select(
        F.col("s.all.source_key").alias("source_key"), F.col("s.all.n_tokens").alias("n_tokens"), F.round("alpha", 9).alias("alpha"), F.round(weight, 9).alias("weight"), budgets.alias("budget")
    )


def mixed_rows(docs: DataFrame, entropy_share: float = 0.97, max_repeats: float = 4.0, budget: int | None = None, block_tokens: int = 50_000, seed: int = 0) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) that the mix takes, once for each epoch.

    Adds mix_source, mix_epoch (from 0), mix_block, mix_tokens, mix_block_place and mix_row_place. An epoch of a source is its
    rows in the order of (mix_block_place, mix_block, mix_row_place). Columns of docs whose names begin with mix_ are left out.
    Null and empty texts come with their block; a source without any token has no weight, and its rows are not taken. Texts are
    of any length; one longer than a block makes its block longer. Ties in places are broken by block and by row mark; repeated
    rows, rows without a doc_id too, stand or fall together. An empty docs gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    slim = docs.select(key.alias("mix_source"), tokens.alias("mix_tokens"), mark.alias("mix_mark"))
    sizes = slim.groupBy(F.col("mix_source").alias("source_key")).agg(F.sum("mix_tokens").alias("n_tokens"))
    weights = source_weights(sizes, entropy_share, max_repeats, budget)
    weights = weights.select(
        F.col("source_key").alias("mix_source"),
        F.greatest(F.floor(F.col("n_tokens") / block_tokens), F.lit(1)).alias("mix_blocks"),
        F.floor(F.col("budget") / F.col("n_tokens")).alias("mix_whole"),
        (F.col("budget") % F.col("n_tokens")).alias("mix_rest"),
    )
    weights = small(weights.persist(), MAX_SOURCES)
    block = F.pmod(F.conv(F.substring("mix_mark", 1, 8), 16, 10).cast("long"), F.col("mix_blocks"))
    place = lambda *c: F.md5(F.concat_ws("|", *c).cast("binary"))
    last = F.col("mix_whole").cast("string")
    blocks = slim.join(weights, "mix_source").groupBy("mix_source", block.alias("mix_block"), "mix_whole", "mix_rest").agg(F.sum("mix_tokens").alias("size"))
    # Running sums in the order of the blocks' places, by ranges of places: no task holds all blocks of a source.
    blocks = blocks.withColumn("place", place("mix_source", F.col("mix_block").cast("string"), last)).withColumn("range", F.substring("place", 1, RANGE_DIGITS)).persist()
    before = Window.partitionBy("mix_source").orderBy("range")  # 16 ** RANGE_DIGITS rows a source
    ranges = blocks.groupBy("mix_source", "range").agg(F.sum("size").alias("held"))
    ranges = ranges.select("mix_source", "range", (F.sum("held").over(before) - F.col("held")).alias("ahead"))
    blocks = blocks.join(ranges, ["mix_source", "range"])
    blocks = blocks.withColumn("upto", F.col("ahead") + F.sum("size").over(Window.partitionBy("mix_source", "range").orderBy("place", "mix_block")))
    blocks = blocks.select("mix_source", "mix_block", (F.col("upto") <= F.col("mix_rest")).alias("mix_fits"), (F.col("mix_rest") - F.col("upto") + F.col("size")).alias("mix_room"))
    blocks = blocks.where("mix_fits OR mix_room > 0").persist()
    # Of each block that fits in part (one a source at most): the marks of the rows that fit.
    partial = slim.join(weights, "mix_source").withColumn("mix_block", block).join(small(blocks.where("NOT mix_fits").select("mix_source", "mix_block", "mix_room"), MAX_SOURCES), ["mix_source", "mix_block"])
    marks = partial.groupBy("mix_source", "mix_block", "mix_mark", "mix_room", "mix_whole").agg(F.sum("mix_tokens").alias("size"))
    in_block = Window.partitionBy("mix_source", "mix_block").orderBy(place("mix_mark", last), "mix_mark")
    marks = marks.withColumn("upto", F.sum("size").over(in_block)).where("upto <= mix_room").select("mix_source", "mix_mark", F.lit(True).alias("mix_taken"))
    rows = docs.withColumns({"mix_source": key, "mix_tokens": tokens, "mix_mark": mark}).join(weights, "mix_source").withColumn("mix_block", block)
    rows = rows.join(small(blocks.select("mix_source", "mix_block", "mix_fits"), MAX_BLOCKS), ["mix_source", "mix_block"], "left")
    rows = rows.join(small(marks.persist(), MAX_BLOCKS), ["mix_source", "mix_mark"], "left")
    copies = (F.col("mix_whole") + F.when(F.coalesce("mix_fits", F.lit(False)) | F.coalesce("mix_taken", F.lit(False)), 1).otherwise(0)).cast("int")
    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*[docs[c] for c in docs.columns], "mix_source", F.explode(epochs).alias("mix_epoch"), "mix_block", "mix_tokens", "mix_mark")
    epoch = F.col("mix_epoch").cast("string")  # the last is mix_whole, so that its places are those it was taken by
    rows = rows.withColumns({"mix_block_place": place("mix_source", F.col("mix_block").cast("string"), epoch), "mix_row_place": place("mix_mark", epoch)})
    return rows.drop("mix_mark")
