"""Quality rules, alignment and conversation repair beside brute force, and their hard cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import turns
from tidemark.llm.alignment import aligned, byte_level_bytes, piece_bytes
from tidemark.llm.rules import BASE, LEAST_BAD, PRIOR, RIGHT_BAD, RIGHT_GOOD, STEPS, WEIGHT, accuracies, quality_rules
from tidemark.llm.turns import Repair, cheapest, damaged, repaired_conversations, repaired_turns

LONG = " ".join(f"w{k * 7919 % 99991}" for k in range(60_000))
CLASHES = ("votes", "open", "v", "n", "p", "chunk", "pair", "number", "words", "posterior", "of_chunk", "best", "count")
TEXTS = [
    (None, "nobody's text, twice over"), (None, "nobody's text, twice over"), (1, "a b c a b c a b"), (1, "one more\n\none more\none more"), (2, LONG), (3, None), (4, ""), (5, "x" * 20_000), (6, "tab\tand\x00nul \U0001f642 ü  "),
    (7, "a▁b"), (8, "<s> <|endoftext|> <0x41></s>"), (9, " "), (10, "the end "), (11, "the end.\n "), (13, "a\n \nb \n c\u00a0 d  e \x1c f\u3000 g \t"), (14, " \n lead"), (12, "word " * 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in CLASHES}).repartition(3)


def statistics_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


def test_statistics_and_base(docs):
    rows = quality_rules(docs).collect()
    want = sorted(((i, *statistics_of(t)) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in BASE)) for r in rows), key=repr) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert {r.doc_id for r in rows if r.kept} == {2}
    assert quality_rules(docs.limit(0)).count() == 0


def test_estimates_by_a_plain_loop(spark):
    """Four rules that are right 9, 8, 7 and 6 times of 10, one of which abstains half the time."""
    random = np.random.default_rng(3)
    good = random.random(4000) < 0.7
    right = random.random((4000, 4)) < [0.9, 0.8, 0.7, 0.6]
    v = np.where(right == good[:, None], 2, 0)
    v[random.random(4000) < 0.5, 3] = 1
    codes = v @ 3 ** np.arange(4)
    got = accuracies(spark.createDataFrame([(int(c), k % 50 > 0) for k, c in enumerate(codes)], "votes long, open boolean"), 4).first()
    rows = v[np.arange(4000) % 50 > 0]
    prior, a, b = PRIOR, np.full(4, RIGHT_GOOD), np.full(4, RIGHT_BAD)
    for _ in range(STEPS):
        p = prior * np.where(rows == 1, 1, np.where(rows == 2, a, 1 - a)).prod(1)
        q = (1 - prior) * np.where(rows == 1, 1, np.where(rows == 0, b, 1 - b)).prod(1)
        r = (p / (p + q))[:, None]
        prior = (r.sum() + WEIGHT * PRIOR) / (len(rows) + WEIGHT)
        a = ((r * (rows == 2)).sum(0) + WEIGHT * RIGHT_GOOD) / ((r * (rows != 1)).sum(0) + WEIGHT)
        b = np.maximum(LEAST_BAD, (((1 - r) * (rows == 0)).sum(0) + WEIGHT * RIGHT_BAD) / (((1 - r) * (rows != 1)).sum(0) + WEIGHT))
    assert np.allclose([got.prior, *got.right_good, *got.right_bad], [prior, *a, *b], atol=1e-9)
    assert abs(got.prior - 0.7) < 0.1 and got.right_good[0] > got.right_good[2]


def test_rules_against_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    clean, poor = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(r.kept for r in clean) and sum(not r.kept for r in poor) >= 0.8 * len(poor) > 5


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def aligned_by_force(texts, a, b):
    out = []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = [byte_level_bytes(a.id_to_token(i)) for i in ids[0]], [piece_bytes(b.id_to_piece(i)) for i in ids[1]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append(([], [], [], Counter()))
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        groups, links, p, q = [], Counter(), 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p2, q2 = ends[0].index(cut, p) + 1, ends[1].index(cut, q) + 1
            groups.append((ids[0][p:p2], ids[1][q:q2]))
            for i in range(p, p2):
                for j in range(q, q2):
                    if ends[0][i] - len(raw[0][i]) < ends[1][j] and ends[1][j] - len(raw[1][j]) < ends[0][i]:
                        links[ids[0][i], ids[1][j]] += 1
            p, q = p2, q2
        out.append((*ids, groups, links))
    held = Counter(pair for *_, links in out for pair in links)
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    rows = []
    for x, y, groups, links in out:
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        best = sum(n for pair, n in links.items() if held[pair] == most[pair[0]])
        rows.append((len(x), len(y), len(groups), sum(links.values()), best, sum(n * held[pair] for pair, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if said else "", said))
    return rows


def test_alignment(spark, docs, libraries):
    more = [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = TEXTS + more
    tables = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    files = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    got = aligned(tables, *files, keep_groups=True, chunk_bytes=100_000).collect()
    want = [(i, *row) for (i, _), row in zip(texts, aligned_by_force([t or "" for _, t in texts], *libraries), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].n_a == 0 and by_id[7].groups_sha256 == "" and by_id[9].n_a > 0 and by_id[3].n_links == 0
    assert aligned(docs, *files).columns[-1] == "groups_sha256" and aligned(docs.limit(0), *files).count() == 0


def by_force(rows):
    """All ways through a conversation, as (cost, audit, turns) by state, without windows."""
    ways = {0: (0, "", ())}

    def insert(ways):
        for _ in range(3):
            for s, (c, a, t) in list(ways.items()):
                for role, to in (("user", 2), ("assistant", 3)):
                    if (s == 2) == (to == 3):
                        ways[to] = min(ways.get(to, (9**9,)), (c + 5, a + "I", (*t, f"{role}:")), key=lambda w: w[:2])
        return ways

    ways = insert(ways)
    for role, text, wrong in rows:
        after = {}
        for s, (c, a, t) in ways.items():
            moves = [(s, 2, "D", ())]
            if wrong not in ("blank", "duplicate"):
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                extra = 5 * (wrong == "truncated")
                moves += [(to, extra, "K", (f"{role}:{text}",))] if to else []
                moves += [(3, 1 + extra, "R", (f"assistant:{text}",))] if s == 2 else [(2, 1 + extra, "R", (f"user:{text}",))]
            for to, cost, letter, more in moves:
                after[to] = min(after.get(to, (9**9,)), (c + cost, a + letter, (*t, *more)), key=lambda w: w[:2])
        ways = insert(after)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])


def conversation_by_force(rows):
    """rows (conv, turn, role, text) of one conversation, before damage."""
    left = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in left:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in left if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(left, left[1:], strict=False))
    cost, audit, out = by_force([(r, t, f) for (_, r, t), f in zip(left, faults, strict=True)])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), len(left)), out


def made_conversations():
    random = np.random.default_rng(11)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(int(random.integers(1, 14))):
            role = [None, "", "user", "assistant", "system", "assistant", "user", "umpire"][random.integers(8)]
            text = [None, "", " \t", "Yes.", "No", "Why?", f"Text {turn}.", f"Text {turn} of {conv}. ", "Fine! \n"][random.integers(9)]
            rows.append((conv, None if random.random() < 0.05 else turn // 2 if random.random() < 0.1 else turn, role, text))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    rows += [(501, t, "assistant", f"Turn {t // 7}" + "." * (t % 3)) for t in range(1500)]
    rows += [(502, t, "system", "") for t in range(1200)] + [(503, 1, "user", "Hot. ")] * 700
    dropped = next(c for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")], dropped


def test_repair(spark):
    rows, dropped = made_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"absent": F.lit("own"), "copy": F.lit(1), "fault": F.lit(7)}).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repaired_conversations(damaged(df)).collect()}
    want = {c: conversation_by_force([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got.keys() == want.keys()
    for c, (summary, _) in want.items():
        assert got[c] == summary, c
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)
    whole = repaired_turns(damaged(df)).orderBy("conv_id", "place").collect()
    for c, (summary, out) in want.items():
        own = [r for r in whole if r.conv_id == c]
        assert [f"{r.role}:{r.text}" for r in own] == list(out) and "".join(r.edit for r in own) == summary[6].replace("D", "")
    assert repaired_conversations(damaged(df.limit(0))).count() == 0


def test_windows_hold_few_turns(monkeypatch):
    """A long conversation's turns leave as they are decided, whatever its faults."""
    monkeypatch.setattr(turns, "WINDOW", 16)
    random = np.random.default_rng(5)
    repair, given, most = Repair(lambda *turn: given.append(turn)), [], 0
    for k in range(5000):
        repair.add(k, ["user", "assistant", "system"][random.integers(3)], f"{k}.", int(random.choice([0, 0, 0, 1, 3])))
        most = max(most, len(repair.held))
    repair.end()
    assert most < 100 and len(given) > 2000


def test_priority_is_cost_then_audit():
    assert cheapest({0: (0, "")}, [("u", 0), ("u", 0)], True) == {3: (1, "KR")}
    assert cheapest({0: (0, "")}, [("a", 0)], True) == {0: (2, "D")}
    assert cheapest({0: (0, "")}, [("s", 0), ("s", 0), ("u", 0), ("a", 0)], True) == {3: (2, "DKKK")}
