"""Similarity of two texts. Token and n-gram parts are built-ins; the sequence part is an Arrow-batched UDF.

Spark has no longest common subsequence, and its ``levenshtein`` counts substitutions as one edit, which is
another measure. The UDF keeps one row of the comparison as the bits of an integer, so a character of the
one text costs a few operations on as many bits as the other text has characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from claimloom.functions import text as T

#: Characters of a content that the sequence part reads, and shares of the parts (fixed values).
SEQUENCE_CHARS = 500
TITLE_SHARES = (0.60, 0.40)
CONTENT_SHARES = (0.45, 0.35, 0.20)
PHRASE_WORDS, MOST_PHRASES = (6, 5), 5
#: Characters up to which bits are set one by one.
SHORT = 1000


def positions(a: str) -> dict[str, int]:
    """Of each character the places it has, as bits."""
    where: dict[str, int] = {}
    if len(a) <= SHORT:
        for k, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << k
        return where
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(a)], strict=True):
        bits = np.zeros(len(a), np.uint8)
        bits[order[i:j]] = 1
        where[chr(codes[order[i]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return where


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full  # a cleared bit: the subsequence grows at this place
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """Twice the common subsequence over both lengths; 0 where a text is empty."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def ratios(texts: list[str], wanted: np.ndarray) -> np.ndarray:
    """``ratio`` of each two texts that are ``wanted``, 0 elsewhere. Of each text all longer ones it meets are one row of bits, with one that
    stays clear between them, so that its characters are gone through once, not once a pair."""
    out, order = np.zeros((len(texts), len(texts))), sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    places: dict[int, dict[str, int]] = {}
    for k, j in enumerate(order):
        others = [i for i in order[:k] if wanted[i, j] or wanted[j, i]]
        if not others or not texts[j]:
            continue
        where, full, starts, at = dict.fromkeys(texts[j], 0), 0, [], 0
        for i in others:
            if i not in places:
                places[i] = positions(texts[i])
            for c in where:
                where[c] |= places[i].get(c, 0) << at
            full |= (1 << len(texts[i])) - 1 << at
            starts.append(at)
            at += len(texts[i]) + 1
        row = full
        for c in texts[j]:
            hit = row & where[c]
            row = ((row + hit) | (row - hit)) & full
        for i, start in zip(others, starts, strict=True):
            common = len(texts[i]) - (row >> start & (1 << len(texts[i])) - 1).bit_count()
            out[i, j] = out[j, i] = 2 * common / (len(texts[i]) + len(texts[j]))
    return out


@F.pandas_udf(DoubleType())
def sequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def title(norm_a: Column, norm_b: Column, words_a: Column, words_b: Column, seq: Column) -> Column:
    """Of two titles in similarity form, their content words and their sequence similarity."""
    mixed = F.round(TITLE_SHARES[0] * T.jaccard(words_a, words_b) + TITLE_SHARES[1] * seq, 3)
    return F.when((norm_a == "") | (norm_b == ""), F.lit(0.0)).when(norm_a == norm_b, F.lit(1.0)).otherwise(mixed)


def content(norm_a: Column, norm_b: Column, words_a: Column, words_b: Column, grams_a: Column, grams_b: Column, seq: Column) -> Column:
    """Of two texts in similarity form, their content words, trigrams and the sequence similarity of their beginnings."""
    one, two, three = CONTENT_SHARES
    mixed = F.round(one * T.jaccard(words_a, words_b) + two * seq + three * T.jaccard(grams_a, grams_b), 3)
    return F.when((norm_a == "") | (norm_b == ""), F.lit(0.0)).when(norm_a == norm_b, F.lit(1.0)).otherwise(mixed)


def phrases(grams_a: list[Column], grams_b: list[Column]) -> Column:
    """Shared word sequences, longer ones first, in the order of the first text; ``grams_*`` by ``PHRASE_WORDS``."""
    return F.slice(F.concat(*[F.array_intersect(a, b) for a, b in zip(grams_a, grams_b, strict=True)]), 1, MOST_PHRASES)
