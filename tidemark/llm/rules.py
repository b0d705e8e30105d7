"""Quality rules as weak supervision: rules vote or abstain, and a posterior takes the place of all-must-pass filtering.

Each rule votes good, bad or not at all on a document's statistics. Documents with the same votes count alike, so the
expectation-maximisation that estimates how often each rule is right (of good and of bad documents apart) and how many are
good runs over vote patterns, of which there are at most 3 ** rules whatever the input: they are gathered into one row, over
which an aggregate fold repeats its steps. The posterior of each pattern goes back to the documents by a join. Estimates come
from the documents that the base rules leave open: those they reject repeat themselves, fire several rules at once and would
make repetition the only fault there is.

Only built-in functions are used. The conditions of the rules are plain SQL, so that the test query reads the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Name, vote for good, vote against; neither is no vote. No rule votes on a document without words.
RULES = (
    ("symbols", "n_symbols <= 0.01 * word_chars", "n_symbols > 0.1 * word_chars"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 6 * n_words", "word_chars < 2 * n_words OR word_chars > 7 * n_words"),
    ("repeated_words", "n_repeat_words <= 0.2 * n_words", "n_repeat_words > 0.5 * n_words"),
    ("repeated_lines", "n_lines >= 2 AND n_dup_lines = 0", "n_dup_lines > 0.3 * n_lines"),
    ("ends_of_lines", "n_ended_lines >= 0.6 * n_lines", "n_ended_lines < 0.2 * n_lines"),
    ("variety", "n_words >= 50 AND n_words <= 1000 AND n_distinct >= 0.3 * n_words", "n_words >= 50 AND n_distinct < 0.1 * n_words"),
    ("length", "n_words >= 50 AND n_words <= 100000", "n_words < 10"),
    ("marked_words", "n_symbols <= 0.05 * n_words", "n_symbols > 0.3 * n_words"),
    ("digits", "n_digits <= 0.05 * word_chars", "n_digits > 0.2 * word_chars"),
)
MIN_WORDS, MAX_REPEATED = 50, 50
STEPS = 40
#: Before any vote is seen: the share of good documents, how often a vote is right of good and of bad ones, and the weight of that.
PRIOR, RIGHT_GOOD, RIGHT_BAD, WEIGHT = 0.8, 0.9, 0.6, 2.0
#: A rule keeps its sense: of the votes on bad documents at least this share is bad.
LEAST_BAD = 0.2
#: Documents that fail, whatever the votes.
FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics of every text, and those that only rules read. Windows of words are told apart by 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", "text", F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("text") - _without(F.col("text"), SPACE_CHARS)).alias("word_chars"), _without(F.col("text"), SYMBOLS).alias("n_symbols"), _without(F.col("text"), "0123456789").alias("n_digits"),
    )  # fmt: skip
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_digits", n.alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size(F.filter("lines", lambda line: line.rlike(r"[.!?][\x20\x09-\x0D]*\z"))).alias("n_ended_lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )  # fmt: skip
    # Windows found twice or more: beside an equal one, once sorted. Most texts have none, which needs no sorting.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get("windows", k)["h"] == x["h"]  # noqa: E731
    found = F.transform("windows", lambda x, k: F.when(F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"]))
    rows = rows.withColumn("found", F.sort_array(F.filter(found, lambda i: i.isNotNull()))).drop("windows")
    own = F.transform("found", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("found", k + 1) - i, F.lit(3))))
    covered = F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0))
    rows = rows.withColumn("n_repeat_words", covered).drop("found")
    return rows.select("doc_id", *[F.col(c).cast("long") for c in (*BASE, "n_digits", "n_distinct", "n_lines", "n_ended_lines")])


def votes(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A rule's vote is 2 (good), 0 (bad) or 1 (none); a document's votes are the digits of a number in base 3."""
    total = F.lit(0).cast("long")
    for k, (_, good, bad) in enumerate(rules):
        total = total + F.when(F.col("n_words") == 0, 1).when(F.expr(good), 2).when(F.expr(bad), 0).otherwise(1) * F.lit(3**k).cast("long")
    return total


def accuracies(documents: DataFrame, n_rules: int, steps: int = STEPS) -> DataFrame:
    """Of documents (votes, open), one row: prior, right_good and right_bad by rule, and patterns (votes, v, n).

    right_good is how often a rule's vote on a good document is good, right_bad how often on a bad one it is bad. n counts the
    open documents, which alone are learned from; every pattern is there.
    """
    digits = F.array(*[(F.floor(F.col("votes") / 3**k) % 3).cast("int") for k in range(n_rules)])
    patterns = documents.groupBy("votes").agg(F.count_if("open").cast("double").alias("n")).select(F.struct("votes", digits.alias("v"), "n").alias("p"))
    one = patterns.agg(F.sort_array(F.collect_list("p")).alias("patterns"))  # at most 3 ** n_rules
    same = lambda x: F.array(*[F.lit(x)] * n_rules)  # noqa: E731
    start = F.struct(F.lit(PRIOR).alias("prior"), same(RIGHT_GOOD).alias("right_good"), same(RIGHT_BAD).alias("right_bad"))
    rules = F.sequence(F.lit(0), F.lit(n_rules - 1))

    def share(held: Column, weight: str, k: Column, vote: int, right: float) -> Column:
        of = lambda wanted: F.aggregate(held, F.lit(0.0), lambda a, x: a + F.when(wanted(x["v"]), x[weight]).otherwise(0.0))  # noqa: E731
        return (of(lambda v: F.get(v, k) == vote) + WEIGHT * right) / (of(lambda v: F.get(v, k) != 1) + WEIGHT)

    def step(state: Column, _: Column) -> Column:
        def parted(p: Column) -> Column:
            return _let(posterior(p["v"], state), lambda r: F.struct(p["v"].alias("v"), (p["n"] * r).alias("good"), (p["n"] * (1 - r)).alias("bad")))

        def made(held: Column) -> Column:
            total = lambda weight: F.aggregate(held, F.lit(0.0), lambda a, x: a + x[weight])  # noqa: E731
            prior = (total("good") + WEIGHT * PRIOR) / (total("good") + total("bad") + WEIGHT)
            return F.struct(prior.alias("prior"), F.transform(rules, lambda k: share(held, "good", k, 2, RIGHT_GOOD)).alias("right_good"), F.transform(rules, lambda k: F.greatest(F.lit(LEAST_BAD), share(held, "bad", k, 0, RIGHT_BAD))).alias("right_bad"))

        return _let(F.transform("patterns", parted), made)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("state"), "patterns").select("state.*", "patterns")


def posterior(v: Column, state: Column) -> Column:
    """How probable it is that a document with the votes v (2 good, 0 bad, 1 none) is good."""
    chance = lambda rates, agree: F.aggregate(F.arrays_zip(v.alias("v"), state[rates].alias("r")), F.lit(1.0), lambda a, x: a * F.when(x["v"] == 1, 1.0).when(x["v"] == agree, x["r"]).otherwise(1 - x["r"]))  # noqa: E731
    good, bad = state["prior"] * chance("right_good", 2), (1 - state["prior"]) * chance("right_bad", 0)
    return good / (good + bad)


def quality_rules(docs: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, votes and posterior of every row of docs (doc_id, text).

    kept is false for documents that fail the base rules (under 50 words, or over half of them in repeated windows), else
    whether the posterior reaches threshold. Null and empty texts have no words, fail, and get no votes; repeated rows, and rows
    without a doc_id, are judged each; other columns are not read; an empty docs gives no rows. Texts are of any length.
    """
    held = staged(statistics(docs).withColumns({"votes": votes(rules), "open": ~F.expr(FAILED)}), "rules")
    state = F.struct("prior", "right_good", "right_bad")
    found = accuracies(held, len(rules)).select(F.explode(F.transform("patterns", lambda p: F.struct(p["votes"].alias("votes"), posterior(p["v"], state).alias("posterior")))).alias("p")).select("p.*")
    rows = held.join(F.broadcast(found), "votes")  # at most 3 ** rules rows
    return rows.select("doc_id", *BASE, (~F.col("open")).alias("base_failed"), (F.col("open") & (F.col("posterior") >= threshold)).alias("kept"), "votes", F.round("posterior", 4).alias("posterior"))


def rules_sql(rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> str:
    """The same over the table documents, for DuckDB: windows by a window function, the estimation by a recursive query."""
    k = range(len(rules))
    vote = lambda good, bad: f"CASE WHEN n_words = 0 THEN 1 WHEN {good} THEN 2 WHEN {bad} THEN 0 ELSE 1 END"  # noqa: E731
    chance = lambda rates, agree: " * ".join(f"CASE v[{j + 1}] WHEN 1 THEN 1.0::DOUBLE WHEN {agree} THEN {rates}[{j + 1}] ELSE 1 - {rates}[{j + 1}] END" for j in k)  # noqa: E731
    good, bad = f"prior * {chance('rg', 2)}", f"(1 - prior) * {chance('rb', 0)}"
    share = lambda w, j, agree, right: f"(sum(CASE WHEN v[{j + 1}] = {agree} THEN n * {w} ELSE 0 END) + {WEIGHT * right}) / (sum(CASE WHEN v[{j + 1}] <> 1 THEN n * {w} ELSE 0 END) + {WEIGHT})"  # noqa: E731
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT row, doc_id, text, list_filter(string_split_regex(text, '{SPACES}'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines,
         length(regexp_replace(text, '{SPACES}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits
  FROM d
), p AS (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM s WHERE len(words) >= 3
), w AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS times FROM p
), r AS (SELECT row, CAST(count(DISTINCT x) AS BIGINT) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS x FROM w WHERE times > 1) GROUP BY row
), f AS (
  SELECT s.doc_id, len(words) AS n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         n_digits, len(list_distinct(words)) AS n_distinct, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][ 	-]*\z'))) AS n_ended_lines
  FROM s LEFT JOIN r USING (row)
), g AS (SELECT *, [{", ".join(vote(a, b) for _, a, b in rules)}] AS v, {FAILED} AS failed FROM f
), patterns AS (SELECT v, CAST(count(*) FILTER (NOT failed) AS DOUBLE) AS n FROM g GROUP BY v
), em AS (
  SELECT 0 AS step, {PRIOR}::DOUBLE AS prior, [{", ".join([f"{RIGHT_GOOD}::DOUBLE"] * len(rules))}] AS rg, [{", ".join([f"{RIGHT_BAD}::DOUBLE"] * len(rules))}] AS rb
  UNION ALL
  SELECT step + 1, (sum(n * r) + {WEIGHT * PRIOR}) / (sum(n) + {WEIGHT}), [{", ".join(share("r", j, 2, RIGHT_GOOD) for j in k)}], [{", ".join(f"greatest({LEAST_BAD}, {share('(1 - r)', j, 0, RIGHT_BAD)})" for j in k)}]
  FROM (SELECT step, v, n, good / (good + bad) AS r FROM (SELECT step, v, n, {good} AS good, {bad} AS bad FROM em, patterns WHERE step < {STEPS})) GROUP BY step
), found AS (SELECT v, good / (good + bad) AS posterior FROM (SELECT v, {good} AS good, {bad} AS bad FROM em, patterns WHERE step = {STEPS}))
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in BASE)}, failed AS base_failed, NOT failed AND posterior >= {threshold} AS kept,
       CAST({" + ".join(f"v[{j + 1}] * {3**j}" for j in k)} AS BIGINT) AS votes, round(posterior, 4) AS posterior
FROM g JOIN found USING (v)"""
