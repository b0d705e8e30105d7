"""Each operator on a small table of hard cases, beside a brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio, boosting, near, repeats
from tidemark.llm.byte_bpe import byte_bpe, read_ranks
from tidemark.llm.inner_products import top_inner_products
from tidemark.llm.licenses import license_scan
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near import keep_one, near_duplicates
from tidemark.llm.quality import keep_good, quality
from tidemark.llm.repeats import suffix_dedup
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import toxicity

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty kelp lagoon mossy noble oasis prairie quartz river slate tundra".split()


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(99, 14)
TEXTS = [
    (0, prose(0, 60), "a"), (1, prose(0, 60), "a"), (2, prose(0, 60) + " coda", "b"), (3, prose(3, 40) + " " + PASSAGE, "b"), (4, PASSAGE + " " + prose(4, 30), "c"),
    (5, None, "a"), (6, "", None), (7, "hi", "a"), (8, "ünïcödé 日本語 🙂 " * 6, "c"), (9, "Released under the MIT License.\nAll fine.", "b"), (10, prose(10, 3000), "a"), (11, "a" * 300, "b"), (12, "a" * 180, "b"),
    (13, "This is licensed under\ncc by nc 4.0 <|endoftext|> x", "c"), (14, "   \n\n\t", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), 0.5, "x", 1) for i, t, s in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, mix_block int")
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_audio_round_trip(docs, none):
    rows = by_id(audio.audio_features(docs))
    for i, text, _ in TEXTS:
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert audio.samples(r.media) == payload and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.tensors and all(len(t["values"]) == audio.TENSOR_FRAMES * audio.MELS for t in r.tensors)
    assert rows[0].feature == rows[1].feature != rows[2].feature and rows[5].feature == rows[6].feature
    assert audio.audio_features(none).count() == 0


def removed(texts: dict[int, str], length: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        b = texts[i].encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, text in texts.items():
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup(docs, none, spark):
    want = removed({i: t or "" for i, t, _ in TEXTS})
    got = by_id(suffix_dedup(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert want[1][1] == len(TEXTS[1][1]) and 0 < want[4][1] < want[4][0] and want[12][1] == 180
    assert suffix_dedup(none).count() == 0
    kept = suffix_dedup(docs, with_text=True)
    assert kept.columns == docs.columns and by_id(kept)[1].text == "" and by_id(kept)[1].n_chars == 0
    twice = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(twice).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(PASSAGE))]


def test_suffix_dedup_of_a_run_of_more_than_65535_strings(spark):
    texts = {1: "a" * 60, 2: "a" * 100_000, 3: "b" + "a" * 70_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(suffix_dedup(df))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(texts)
    assert got[2].n_removed == 100_000


def test_window_hashes_and_stretches():
    data = np.frombuffer((PASSAGE * 3).encode(), np.uint8)
    h = repeats.window_hashes(data, 50)
    assert len(h) == len(data) - 49 and len(set(h.tolist())) == len({bytes(data[k : k + 50]) for k in range(len(h))})


def test_mixing(docs, none, spark):
    rows = spark.createDataFrame([(i, "w " * 50, "big" if i < 300 else "small") for i in range(320)], "doc_id long, text string, source string")
    out = mixed_rows(rows, entropy_share=1.0, max_repeats=3.0, block_tokens=500).toPandas()
    n = out.groupby("mix_source")["mix_tokens"].sum()
    assert n["=small"] <= 3 * 20 * 50 and n["=big"] < 300 * 50 and n["=small"] > 2.5 * 20 * 50
    assert out.groupby("doc_id").size().max() <= 3 and not out.duplicated(["doc_id", "mix_epoch"]).any()
    again = mixed_rows(rows.repartition(7), entropy_share=1.0, max_repeats=3.0, block_tokens=500).toPandas()
    assert sorted(zip(out.doc_id, out.mix_epoch, strict=True)) == sorted(zip(again.doc_id, again.mix_epoch, strict=True))
    hard = mixed_rows(docs).toPandas()
    assert set(hard["mix_source"]) == {"=a", "=b", "=c"} and mixed_rows(none).count() == 0  # the null source has no tokens


def test_mixing_permutes_every_epoch(spark):
    rows = spark.createDataFrame([(i, "w " * 50, "big" if i < 300 else "small") for i in range(320)], "doc_id long, text string, source string")
    out = mixed_rows(rows, entropy_share=1.0, max_repeats=3.0, block_tokens=200).toPandas()
    small = out[out["mix_source"] == "=small"].sort_values(["mix_epoch", "mix_block_place", "mix_block", "mix_row_place"])
    epochs = [e for _, e in small.groupby("mix_epoch")]
    assert len(epochs) == 3 and [len(e) for e in epochs[:2]] == [20, 20]
    orders = [tuple(e["mix_block"].drop_duplicates()) for e in epochs[:2]]
    assert set(orders[0]) == set(orders[1]) and orders[0] != orders[1]  # blocks in another order
    assert all((e["mix_block"].diff().fillna(1) != 0).sum() == e["mix_block"].nunique() for e in epochs)  # each block together
    inside = [{b: tuple(r["doc_id"]) for b, r in e.groupby("mix_block")} for e in epochs[:2]]
    assert all(set(inside[0][b]) == set(inside[1][b]) for b in inside[0]) and inside[0] != inside[1]  # rows in another order


def test_quality_and_toxicity_of_hard_cases(docs, none, labels):
    for f, folds, fold, at in ((quality, 3, 1, 0.5), (toxicity, 4, 2, 0.3)):
        rows = by_id(f(docs, labels))
        assert set(rows) == {i for i, *_ in TEXTS}
        for i, r in rows.items():
            assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and r.predicted == int(r.score >= at)
        assert rows[0].score == rows[1].score and rows[5].score == rows[6].score
        assert f(none, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(TEXTS)
    assert keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = (quality if name == "quality" else toxicity)(docs, labels).where("held_out").join(labels.select("doc_id", name), "doc_id").toPandas()
    rank, y = rows["score"].rank(), rows[name] == 1
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.9


def test_trees_learn_a_rule():
    x = np.random.default_rng(1).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((boosting.fit(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_inner_products(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 1, (300, 8)) * rng.choice([0.1, 1, 5], (300, 1))).astype(np.float32)
    vectors[7] = vectors[8] = vectors[9]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = top_inner_products(df, df.where("vec_id % 50 = 0 OR vec_id = 1003")).collect()
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if i < 300 or i == 1003}
    want = []
    for q in [k for k in whole if k % 50 == 0 or k == 1003]:
        best = sorted((-(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted((int(a), b, int(c), int(s)) for a, b, c, s in want)
    assert top_inner_products(df.limit(0), df.limit(0)).count() == 0


def test_byte_bpe_is_the_library(docs, none):
    import tiktoken

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(byte_bpe(docs, ranks, public_tokenizers.PATTERN))
    for i, text, _ in TEXTS:
        ids = library.encode_ordinary(text or "")
        assert rows[i].ids == " ".join(map(str, ids)) and rows[i].n_tokens == len(ids) and bytes(rows[i].decoded) == (text or "").encode()
    assert byte_bpe(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_token_counts_are_the_library_s(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        content = file.read()
    rows = by_id(token_counts(docs, content, public_tokenizers.PATTERN))
    for i, text, _ in TEXTS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 512)
    assert token_counts(none, content, public_tokenizers.PATTERN).count() == 0


def classes(texts: dict[int, str], threshold: float = 0.8) -> dict[int, int]:
    bags = {}
    for i, t in texts.items():
        words = [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode())]
        bags[i] = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
    found = {i: i for i in texts}
    for _ in range(len(texts)):
        for a in texts:
            for b in texts:
                both = sum((bags[a] & bags[b]).values())
                if both and both >= threshold * sum((bags[a] | bags[b]).values()):
                    found[a] = found[b] = min(found[a], found[b])
    return found


def test_near_duplicates(docs, none):
    rows = by_id(near_duplicates(docs))
    assert {i: r.class_id for i, r in rows.items()} == classes({i: t or "" for i, t, _ in TEXTS})
    assert rows[0].class_size == 3 and rows[5].class_size == 1
    assert near_duplicates(none).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in TEXTS} - {1, 2}


def test_a_large_bucket_of_near_copies(spark):
    base = prose(7, 400).split()
    texts = {}
    for k in range(60):
        own = list(base)
        own[(k * 6) % 400] = f"w{k}"
        texts[k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.class_id for r in near_duplicates(df).collect()} == {0} == set(classes(texts).values())


def versions(seed: int, n: int, step: int) -> list[str]:
    """n versions of a text, each with `step` more of its 400 words changed for good; only neighbours are near enough."""
    own, out = [f"s{seed}x{k}" for k in range(400)], []
    for v in range(n):
        own = list(own)
        for k in range(step):
            own[(v * step + k) * 13 % 400] = f"v{seed}x{v}x{k}"
        out.append(" ".join(own))
    return out


def with_bands(monkeypatch, bands: dict[int, list[int]]) -> None:
    """near.signed with the given bands a doc_id instead of the texts' own."""
    signed = near.signed
    at = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for pair in bands.items() for x in pair])
    monkeypatch.setattr(near, "signed", lambda docs: signed(docs).withColumn("bands", at[F.col("id")].cast("array<long>")))


def test_a_link_between_the_later_texts_of_two_classes(spark, monkeypatch):
    a1, a2, b2, b1 = versions(5, 4, 6)
    texts = {1: a1, 2: b1, 3: a2, 4: b2} | {10 + k: prose(50 + k, 400) for k in range(14)}
    bands = {i: [7] * 5 + [1000 * i + k for k in range(11)] for i in texts}
    for i in texts:  # a small bucket each for a1, a2 and for b1, b2
        bands[i][9] = {1: 1, 3: 1, 2: 2, 4: 2}.get(i, bands[i][9])
    with_bands(monkeypatch, bands)
    want = classes(texts)
    assert [want[i] for i in (1, 2, 3, 4)] == [1] * 4
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == want


def test_one_shared_band_makes_a_candidate_in_a_large_bucket(spark, monkeypatch):
    one, other = versions(8, 2, 6)
    texts = {1: one, 2: other} | {10 + k: prose(50 + k, 400) for k in range(14)}
    with_bands(monkeypatch, {i: [7] + [1000 * i + k for k in range(15)] for i in texts})
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert found == classes(texts) and found[2] == 1


def test_a_chain_of_versions_with_shuffled_ids(spark):
    ids = np.random.default_rng(4).permutation(40)
    texts = {int(i): t for i, t in zip(ids, versions(6, 40, 5), strict=True)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == classes(texts)


def test_near_copies_of_one_of_several_texts_of_a_doc_id(spark):
    one, other = prose(60, 100), prose(61, 100)
    df = spark.createDataFrame([(5, one), (5, other), (3, one + " coda"), (9, other + " coda"), (7, prose(62, 100))], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(df).collect()) == [(3, 3, 4), (5, 3, 4), (5, 3, 4), (7, 7, 1), (9, 3, 4)]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    text = np.repeat([0, 1], 400)
    both = near.signatures(text, np.append(h, h), np.append(a, b), 2)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / near.M)


def test_license_scan(docs, none):
    rows = by_id(license_scan(docs))
    assert (rows[9].n_base, rows[9].base_labels, rows[9].score) == (1, "mit", 1.0) and "mit" in rows[9].labels
    assert rows[13].base_labels == "cc-by-nc" and (rows[13].first_word, rows[13].last_word) == (4, 4)
    assert rows[5].n_words == 0 and rows[5].labels == "" and rows[5].first_word is None
    assert all(r.labels == "" and r.score == 0 for i, r in rows.items() if i not in (9, 13))
    assert license_scan(none).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    own = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, own, d)
        if k < 4:
            assert out.columns == docs.columns
        own = spark.createDataFrame(out.toPandas(), out.schema) if k < 4 else out
    rows = own.toPandas()
    assert 0 < len(rows) < 2 * docs.count() and (rows["n_tokens"] >= 0).all()
    assert isinstance(rows, pd.DataFrame) and docs.where(F.col("doc_id").isin(rows["doc_id"].tolist())).count() == rows["doc_id"].nunique()


def test_components_of_very_large_ids(spark):
    from tidemark.llm.near import components

    big = 2**62
    links = spark.createDataFrame([(big, big + 1), (big + 4, big + 5), (big, big + 5), (big + 8, big + 9)], "a long, b long")
    found = {r["id"]: r["class"] for r in components(links).collect()}
    assert found == {big: big, big + 1: big, big + 4: big, big + 5: big, big + 8: big + 8, big + 9: big + 8}
