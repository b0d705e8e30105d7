"""Nulls, repeats, long texts and clashing names for every operator and stage; and independent versions of what they compute."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio, boosting, toxicity
from tidemark.llm.boosting import Trees
from tidemark.llm.byte_bpe import byte_bpe, heap_ids, read_ranks
from tidemark.llm.inner_products import bounds, search, top_inner_products
from tidemark.llm.licenses import license_scan
from tidemark.llm.mixing import mixed_rows, source_weights
from tidemark.llm.near import keep_one, near_duplicates
from tidemark.llm.quality import NAMES, keep_good, quality, statistics
from tidemark.llm.repeats import suffix_dedup
from tidemark.llm.token_counts import token_counts

LONG = " ".join(f"w{k * 7919 % 99991}" for k in range(60_000))  # about 400 KB
WORD = "".join(chr(97 + (k * k * 31 + k) % 26) for k in range(20_000))  # one pre-token
CLASHES = ("score", "bucket", "mix_block", "place", "piece", "home", "chunk", "head", "label", "class", "id", "key", "key2", "grouped", "row_mark", "held_out", "blob")
ROWS = [(None, "nobody's text, twice over"), (None, "nobody's text, twice over"), (1, "one text " * 20), (1, "one text " * 20), (1, "another text of the same number " * 5), (2, LONG), (3, LONG), (4, None), (5, ""), (6, WORD), (7, "\u0000 K \U0001f642")]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") < 5, "a"), "n_chars": F.length("text")})
    return df.withColumns({c: F.lit("own") for c in CLASHES}).coalesce(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")


def texts_of(df, *columns):
    return sorted([tuple(r) for r in df.select("doc_id", *columns).collect()], key=repr)


def test_audio(hard):
    rows = audio.audio_features(hard).drop("media", "tensors", "segments").collect()
    want = sorted(((i, len((t or "").encode())) for i, t in ROWS), key=repr)
    assert sorted(((r.doc_id, r.n_bytes) for r in rows), key=repr) == want
    by_size = {r.n_bytes: r for r in rows}
    payload = audio.padded(WORD.encode())
    assert by_size[len(WORD)].payload_sha256 == hashlib.sha256(payload).hexdigest() and by_size[len(WORD)].feature.startswith(f"{len(payload) // 96 - 1}x")


def test_audio_features_one_by_one():
    """Resampling and spectra by plain sums."""
    for payload in (audio.padded(b""), audio.padded(bytes(range(256)) * 4), audio.padded("ünïcödé ".encode() * 70)):
        x = np.concatenate([np.zeros(24), np.frombuffer(payload, np.uint8).astype(float) - 128, np.zeros(24)])
        y = [np.rint((audio._low_pass() * x[3 * k : 3 * k + 48]).sum() / 256) for k in range(len(payload) // 3)]
        n, k = np.arange(64)[None], np.arange(33)[:, None]
        wave = [np.rint(64 * f(2 * np.pi * n * k / 64) * np.hanning(64)) for f in (np.cos, np.sin)]
        mel = [audio.fixed_log2(sum((w * np.array(y[a : a + 64])).sum(1) ** 2 for w in wave) @ audio.MEL) for a in range(0, len(y) - 63, 32)]
        made = audio.features([payload, payload])
        assert (made[0]["mel"] == np.array(mel)).all() and (made[1]["mel"] == made[0]["mel"]).all()
        values, offsets, starts, ends = audio.tensors([m["mel"] for m in made])
        assert values.type == audio.TENSOR and audio.as_arrow_tensors(values.storage).equals(values) and offsets[1] == -(-len(mel) // 32)
        assert (values.to_numpy_ndarray()[0].ravel()[: min(len(mel), 32) * 16] == np.array(mel)[:32].ravel() / 16).all() and starts[0] == 0 and abs(ends[offsets[1] - 1] - ((len(mel) - 1) * 32 + 64) / 16_000) < 1e-12


def test_suffix_dedup(hard):
    rows = texts_of(suffix_dedup(hard), "n_bytes", "n_removed")
    long = len(LONG)
    assert (2, long, 0) in rows and (3, long, long) in rows and rows.count((None, 25, 0)) == 2 and (6, len(WORD), 0) in rows and rows.count((1, 180, 0)) == 2
    kept = suffix_dedup(hard, with_text=True)
    assert kept.columns == hard.columns and kept.where("score <> 'own'").count() == 0


def test_near_duplicates(hard):
    rows = texts_of(near_duplicates(hard), "class_id", "class_size")
    assert rows.count((1, 1, 3)) == 3 and (3, 2, 2) in rows and rows.count((None, None, 1)) == 2 and (6, 6, 1) in rows and (4, 4, 1) in rows
    kept = keep_one(hard)
    assert kept.columns == hard.columns and sorted(Counter(r.doc_id for r in kept.collect()).items(), key=repr) == sorted({None: 2, 1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 7: 1}.items(), key=repr)


def test_tokens(hard):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS), key=repr)
    assert texts_of(byte_bpe(hard.repartition(3), ranks, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == want
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        got = texts_of(token_counts(hard, file.read(), public_tokenizers.PATTERN), "n_bytes", "n_tokens")
    assert got == sorted(((i, len((t or "").encode()), len(counts.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS), key=repr)
    for word in ("a" * 5000, "abab" * 700 + "z", "ünïcödé" * 300, "x"):
        assert heap_ids(word.encode(), ranks) == library.encode_ordinary(word)
    tokens = {r: t for t, r in ranks.items()}
    assert b"".join(map(tokens.__getitem__, heap_ids(b"ab" * 500_000, ranks))) == b"ab" * 500_000  # a word of 1 MB


def test_scores(hard, labels):
    for f in (quality, toxicity.toxicity):
        rows = f(hard, labels).collect()
        assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in ROWS), key=repr) and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None) and len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert keep_good(hard, labels).columns == hard.columns


def test_mixing(hard):
    rows = mixed_rows(hard.drop("n_chars")).toPandas()
    assert "mix_source" in rows and "bucket" in rows and rows["mix_block"].dtype != object
    assert not rows.duplicated(["doc_id", "text", "mix_epoch"]).all()


def test_pipeline(spark, hard, labels, tmp_path):
    import corpus_pipeline as pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for own in (hard.drop("mix_block"), hard.drop("mix_block").limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES[1:], 1):
            out = stage(spark, own, str(tmp_path))
            own = out if k == 4 else spark.createDataFrame(out.collect(), out.schema)
            assert k == 4 or own.columns == hard.drop("mix_block").columns
        assert {"doc_id", "n_tokens", "ids_sha256"} <= set(own.columns) and own.count() >= 0
    assert pipeline.STAGES[0][1](spark, hard, str(tmp_path)).columns == hard.columns


def test_bisection_and_permutation_by_hand(spark):
    """Weights by a plain bisection, and each epoch's rows by sorting hashes."""
    sizes = {"a": 4000, "b": 900, "c": 100}
    rows = [(k, "w " * 10, s) for s, n in sizes.items() for k in range({"a": 0, "b": 1000, "c": 2000}[s], {"a": 0, "b": 1000, "c": 2000}[s] + n // 10)]
    out = mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy_share=0.8, max_repeats=3.0, block_tokens=50, seed=4).toPandas()
    share = np.array([n / 5000 for n in sizes.values()])

    def entropy(a):
        p = share**a / (share**a).sum()
        return -(p * np.log(p)).sum()

    def repeats(a):
        return (share**a / (share**a).sum() * 5000 / np.array(list(sizes.values()))).max()

    def bisect(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            low, high = ((low + high) / 2, high) if holds((low + high) / 2) else (low, (low + high) / 2)
        return (low + high) / 2

    alpha = max(bisect(lambda a: entropy(a) >= 0.8 * math.log(3)), 0.0 if repeats(0.0) <= 3 else bisect(lambda a: repeats(a) > 3))
    budget = share**alpha / (share**alpha).sum() * 5000
    md5 = lambda *c: hashlib.md5("|".join(c).encode()).hexdigest()
    for (name, n), asked in zip(sizes.items(), budget, strict=True):
        own = out[out["mix_source"] == f"={name}"]
        whole, rest = divmod(math.floor(asked + 1e-6), n)
        marks = {i: md5("4", str(i), hashlib.md5(t.encode()).hexdigest()) for i, t, s in rows if s == name}
        blocks = {i: int(m[:8], 16) % max(n // 50, 1) for i, m in marks.items()}
        want = [(i, e) for e in range(whole) for i in marks]
        for b in sorted(set(blocks.values()), key=lambda b: (md5(f"={name}", str(b), str(whole)), b)):
            inside = sorted((i for i in blocks if blocks[i] == b), key=lambda i: (md5(marks[i], str(whole)), marks[i]))
            if 10 * len(inside) <= rest:
                want += [(i, whole) for i in inside]
                rest -= 10 * len(inside)
            else:
                want += [(i, whole) for i in inside[: rest // 10]]
                break
        assert sorted(zip(own["doc_id"], own["mix_epoch"], strict=True)) == sorted(want)
        assert (own["mix_row_place"] == [md5(marks[i], str(e)) for i, e in zip(own["doc_id"], own["mix_epoch"], strict=True)]).all()


def chain_ratios(texts: list[tuple[str, int]], asked: list[str]) -> dict[str, float]:
    """Class-conditional Kneser-Ney over the beginnings of words, in plain dictionaries."""
    words = [Counter(), Counter()]
    for text, label in texts:
        words[label].update(x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()))
    chain_of = lambda w: [*((w[:k], len(w) <= k) for k in (4, 6, 8)), w]  # noqa: E731  (a word that ends there is another link)
    levels = [chain_of(w) for w in {*words[0], *words[1]}]
    counts: dict = {}
    for chain in levels:
        w = chain[3]
        for depth, link in enumerate([b"", *chain]):
            own = counts.setdefault((depth, link), {"n": [0, 0], "kinds": 0, "own": [0, 0]})
            own["kinds"] += 1
            for c in (0, 1):
                own["n"][c] += words[c][w]
                own["own"][c] += words[c][w] > 0
    disc = {}
    for depth in range(1, 5):
        for c in (0, 1):
            n1, n2 = (sum(v["n"][c] == k for (d, _), v in counts.items() if d == depth) for k in (1, 2))
            disc[depth, c] = min(max(n1 / max(n1 + 2 * n2, 1), 0.5), 0.98)
    free = lambda v, depth, c: disc[depth, c] * v["own"][c] / v["n"][c] if v["n"][c] else 1.0
    out = {}
    for w in asked:
        b = w.lower().encode()
        total, done = 0.0, False
        root = counts.get((0, b""))
        if root is None or not all(root["n"]):
            out[w] = 0.0
            continue
        above = root
        for depth, link in enumerate(chain_of(b), 1):
            own = counts.get((depth, link))
            if own is None:
                out[w] = total + math.log(free(above, depth, 1) / free(above, depth, 0)) if depth > 1 else math.log((root["own"][1] / root["n"][1]) / (root["own"][0] / root["n"][0]))
                done = True
                break
            p = [(max(own["n"][c] - disc[depth, c], 0) / above["n"][c] if above["n"][c] else 0.0) + free(above, depth, c) * own["kinds"] / above["kinds"] for c in (0, 1)]
            total += math.log(p[1] / p[0])
            above = own
        if not done:
            out[w] = total
    return out


def test_word_ratios_by_hand(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["stupidity", "stupidly", "stupid", "stupendous", "pleasant", "pleasure", "please", "a", "the", "rain", "rainfall", "rainy", "idiot", "idiotic"]
    texts = [(" ".join(rng.choice(vocabulary, 12, p=np.roll(np.linspace(0.01, 0.133, 14), 5 * (k % 2)) / np.linspace(0.01, 0.133, 14).sum())), k % 2) for k in range(8)]
    counts = toxicity.word_counts(spark.createDataFrame(texts, "text string, label int"))
    asked = [*vocabulary, "stupidest", "pleasantly", "rainbow", "zebra", "thé"]
    got = {r.doc_id: r["mean"] for r in toxicity.measured(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), counts).collect()}
    want = chain_ratios(texts, asked)
    for k, w in enumerate(asked):
        assert abs(got[k] - want[w]) < 1e-5, w


def test_trees_and_statistics_by_hand():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 5))
    trees = boosting.fit(x, (x[:, 1] > 0.2).astype(float), trees=12)

    def one(row: np.ndarray, t: Trees) -> float:
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < t.feature.shape[1]:
                node = 2 * node + 1 + int(row[t.feature[k, node]] > t.threshold[k, node])
            total += t.value[k, node - t.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    np.testing.assert_allclose(trees.score(x), [one(row, trees) for row in x])
    texts = ["", "Two words.\nTwo words.\nThree more WORDS | here!", "ééé 12 12 12"]
    raw = [t.encode() for t in texts]
    made = statistics(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    for row, text, b in zip(made, texts, raw, strict=True):
        words, own = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)], dict(zip(NAMES, row, strict=True))
        lines = re.findall(r"[^\n]*\n|[^\n]+$", text)
        assert own["share_upper"] == sum(65 <= c < 91 for c in b) / max(len(b), 1) and own["share_high"] == sum(c > 127 for c in b) / max(len(b), 1)
        assert math.isclose(own["distinct_words"], len(set(words)) / max(len(words), 1)) and math.isclose(own["log_words"], math.log1p(len(words)))
        assert math.isclose(own["commonest_word"], max(Counter(words).values(), default=0) / max(len(words), 1)) and math.isclose(own["bars_a_word"], text.count("|") / max(len(words), 1))
        assert math.isclose(own["repeated_lines"], 1 - len(set(lines)) / max(len(lines), 1))


def test_products_pruned_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(0, 1, (4000, 16)) * rng.lognormal(0, 1.5, (4000, 1)) * 64).astype(np.int64)
    order = np.argsort(-np.square(v).sum(1))
    buckets = [(v[order[a : a + 250]], order[a : a + 250]) for a in range(0, 4000, 250)]
    q = rng.normal(0, 64, (20, 16)).astype(np.int64)
    best, who, products = search(q, buckets, 5)
    want = -np.sort(-(q @ v.T), axis=1)[:, :5]
    assert (best == want).all() and ((q[:, None] * v[who]).sum(2) == best).all() and products < 0.4 * 20 * 4000
    low, high, longest = (np.array([f(b) for b, _ in buckets]) for f in (lambda b: b.min(0), lambda b: b.max(0), lambda b: np.sqrt(np.square(b).sum(1)).max()))
    assert (bounds(q, longest, low, high) >= np.array([(q @ b.T).max(1) for b, _ in buckets]).T - 1e-6).all()
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, x, "own") for i, x in rows], "vec_id long, embedding array<float>, row string")
    got = sorted(map(tuple, top_inner_products(df, df.where("vec_id = 1"), k=2).collect()))
    assert got == sorted([(1, 1, 1, 65536), (1, 2, 1, 32768)] * 2 + [(1, 1, 1, 32768), (1, 2, 1, 32768)])


def test_licenses_across_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and\n * associated documentation files"
    rows = [(1, mit), (2, "all rights\nreserved"), (3, "all the rights we have reserved"), (4, "THIS WOR\u212a IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE"), (5, mit[:70]), (6, "x " * 50_000 + mit), (7, "This Work is\nlicensed under the GNU general public license")]
    out = {r.doc_id: r for r in license_scan(spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, words string")).collect()}
    assert out[1].labels == "mit" and out[1].score == 1.0 and out[2].labels == "all-rights-reserved" and out[3].labels == "" and out[5].labels == ""
    assert out[4].labels == "" and out[7].labels == "gpl-3" and out[7].score < 0.9  # the Kelvin sign is no k
    assert out[6].labels == "mit" and out[6].blocks[0]["first"] >= 50_000


def test_crc_of_a_null_id_is_not_held_out(spark):
    from tidemark.llm.common import held_out

    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {None: False} | {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in (1, 2, 3)}


def test_suffix_dedup_writes_less_than_its_input(spark, monkeypatch):
    """Samples of one document only cost the exchange little, in many groups and buckets too."""
    monkeypatch.setattr("tidemark.llm.repeats.GROUP_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(4000)])
    texts = [" ".join(words[rng.integers(0, 4000, 250)]) for _ in range(1000)]
    shared = " ".join(words[rng.integers(0, 4000, 20)])
    texts[5], texts[700] = texts[5] + shared, shared + texts[700]
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = {r.doc_id: r.n_removed for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {700} and len(shared) <= got[700] <= len(shared) + 2
    assert written() - before < 1.1 * sum(map(len, texts))


def test_suffix_dedup_takes_shared_samples_in_slices(spark, monkeypatch):
    """Where most samples are shared, a bucket hashes a slice at a time; samples in many stretches are compared by name."""
    from tidemark.llm import repeats

    hashed, slice_bytes = repeats.window_hashes, 1 << 14
    rng = np.random.default_rng(7)
    phrases = ["".join(chr(97 + c) for c in rng.integers(0, 26, 45)) for _ in range(150)]
    common = "least of all hashes in a line of every text"  # other bytes around it each time
    texts = [" ".join([phrases[p] for p in rng.integers(0, 150, 12)] + [f"{i % 90:05}{common}{i % 70:05}"]) for i in range(500)]
    seen: set[bytes] = set()
    want = {}
    for i, text in enumerate(t.encode() for t in texts):
        own = [text[j : j + 50] for j in range(len(text) - 49)]
        gone = {j + d for j, s in enumerate(own) if s in seen for d in range(50)}
        seen.update(own)
        want[i] = len(gone)
    assert sum(want.values()) > 10_000

    def bounded(data, length):
        if len(data) > 3 * slice_bytes:
            raise AssertionError(f"{len(data)} bytes hashed at once")
        return hashed(data, length)

    monkeypatch.setattr(repeats, "window_hashes", bounded)
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1 << 13)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for many in (1 << 15, 40, 0):
        monkeypatch.setattr(repeats, "MANY", many, raising=False)
        assert {r.doc_id: r.n_removed for r in repeats.suffix_dedup(df).collect()} == want


def test_a_source_at_the_limit_gets_all_its_epochs(spark):
    """The smallest source's budget is max_repeats times its tokens, at sizes where rounding would cost whole tokens."""
    for top in (4_000, 4_000_000_000):
        sizes = [("=a", top), ("=b", top * 9 // 40), ("=c", top // 40)]
        rows = source_weights(spark.createDataFrame(sizes, "source_key string, n_tokens long"), entropy_share=0.8, max_repeats=3.0).collect()
        budgets = {r.source_key: r.budget for r in rows}
        assert budgets["=c"] == 3 * (top // 40)
        assert sum(n for _, n in sizes) - 2 <= sum(budgets.values()) <= sum(n for _, n in sizes)
