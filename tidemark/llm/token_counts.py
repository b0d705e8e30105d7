"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies and summed.

Ids are never kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back
from tidemark.llm.pieces import joined_back, nullable


def splitter(pattern: str, specials: tuple[str, ...] = ()) -> Callable[[], Callable[[str], list[str]]]:
    """A function that makes the function that cuts a text into pre-tokens.

    A special string inside a text is a piece of its own, marked by a leading zero byte; the stretches between are cut
    on their own, as the libraries do.
    """

    def make():
        found = regex.compile(pattern).findall
        if not specials:
            return found
        apart = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")

        def cut_text(text: str) -> list[str]:
            if not any(s in text for s in specials):
                return found(text)
            out = []
            for k, stretch in enumerate(apart.split(text)):
                out += ["\0" + stretch] if k % 2 else found(stretch)
            return out

        return cut_text

    return make


def special_strings(tokenizer_json: str) -> tuple[str, ...]:
    return tuple(t["content"] for t in json.loads(tokenizer_json).get("added_tokens", []))


def counts_once(pieces: DataFrame, tokenizer_json: str, specials: tuple[str, ...]) -> DataFrame:
    """pieces (piece, ...) with n, the tokens of every distinct pre-token."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        marked = {"\0" + s for s in specials}
        for words in batches:
            plain = ["" if p in marked else p for p in words]
            n = np.array([len(e.ids) for e in tokenizer.encode_batch(plain, add_special_tokens=False)], np.int32)
            n[words.isin(marked).to_numpy()] = 1
            yield pd.Series(n)
        del tokenizer
        give_back()

    return pieces.select("*", count("piece").alias("n"))


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs (doc_id, text, ...).

    tokenizer_json is the content of a byte-level BPE file of the tokenizers library whose pre-tokens pattern gives. Null and
    empty texts have no tokens, repeated rows and rows without a doc_id are counted each, other columns of docs are not read,
    and an empty docs gives no rows. Texts and words are of any length.
    """
    specials = special_strings(tokenizer_json)

    def finish(n: np.ndarray, ids, sizes, lengths, numbers, counts) -> pd.DataFrame:
        total = np.append(0, np.cumsum(n[numbers] * counts.astype(np.int64)))
        ends = np.cumsum(lengths)
        return pd.DataFrame({"doc_id": nullable(ids), "n_bytes": np.asarray(sizes), "n_tokens": total[ends] - total[ends - lengths]})

    once = lambda pieces: counts_once(pieces, tokenizer_json, specials)
    out = joined_back(docs, splitter(pattern, specials), once, "n", finish, "doc_id long, n_bytes long, n_tokens long", counted=True, prepare=lambda n: n.to_numpy().astype(np.int64))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
