"""Language by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters, words parted by one
blank), most frequent first. A document gets the language whose profile is nearest by the
out-of-place distance between the two orders.

An n-gram's code holds its code points as they are, so no two letters of any script fall together.
The only bounded sample is that of the labelled documents from which the profiles are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import id_hash, map_texts, texts_of

FOLDS, HELD = 4, 2
SAMPLE = 40_000
RANKS = 300
UNKNOWN = "und"
# Characters whose n-grams are counted at once; longer texts go through in steps.
STEP = 1 << 20
# Bits of a code point within a code.
BITS = 21


# What stands for the blank in a code: no letter, and not 0, so that codes of 1, 2 and 3 places never meet.
GAP = 1


@cache
def _letters() -> np.ndarray:
    """Every code point that is a letter, ``GAP`` in the place of the others."""
    return np.array([c if chr(c).isalpha() else GAP for c in range(0x110000)], np.int64)


def gram_codes(s: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Codes of the n-grams whose middle place (of two: the second) is at ``lo`` to ``hi`` of the letters ``s``.

    Words are padded by one blank; no n-gram crosses a word's end.
    """
    before = s[lo - 1 : hi - 1] if lo else np.concatenate([[GAP], s[: hi - 1]])
    here = s[lo:hi]
    after = np.append(s[lo + 1 : hi + 1], np.full(int(hi == s.size), GAP))
    letter = here != GAP
    two = ((before << BITS) | here)[letter | (before != GAP)]
    three = ((before << 2 * BITS) | (here << BITS) | after)[letter]
    end = [int(here[-1]) << BITS | GAP] if hi == s.size and letter[-1] else []  # the blank behind a last word
    return np.concatenate([here[letter], two, np.array(end, np.int64), three])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a whole text, in order, and how often each is there."""
    s = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, s.size, STEP):
        found, often = np.unique(gram_codes(s, lo, min(lo + STEP, s.size)), return_counts=True)
        codes, counts = add_counts([codes, found], [counts, often]) if codes.size else (found, often)
    return codes, counts


def add_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several tables of counts as one."""
    all_codes, number = np.unique(np.concatenate(codes), return_inverse=True)
    return all_codes, np.bincount(number, np.concatenate(counts), all_codes.size).astype(np.int64)


def _language_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], texts_of(frame["text"])):
            held.setdefault(lang, []).append(gram_counts(text))
        held = {lang: [add_counts(*map(list, zip(*found)))] for lang, found in held.items()}
    for lang, found in held.items():
        yield pd.DataFrame({"lang": lang, "code": found[0][0], "n": found[0][1]})


def learn(docs: DataFrame, sample: int = SAMPLE, ranks: int = RANKS) -> dict[str, list[int]]:
    """Profiles from about ``sample`` documents with a language outside the held-out fold, drawn by hash."""
    known = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & (F.coalesce(id_hash(), F.lit(HELD)) % FOLDS != HELD)
    )
    total = known.count()  # reads ids and languages only; a null text teaches nothing
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    counts = known.mapInPandas(_language_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    rows = top.select("lang", "rank", "code").collect()  # at most `ranks` rows a language
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def rank_text(text: str, ranks: int = RANKS) -> np.ndarray:
    """A text's most frequent n-grams in order; equal counts go by code."""
    codes, counts = gram_counts(text)
    if codes.size > ranks:
        least = np.partition(counts, counts.size - ranks)[counts.size - ranks]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:ranks]


def distances(ranked: np.ndarray, known: np.ndarray, place: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """Out-of-place distance to each profile, from 0 to 1: the mean of how far each n-gram is from its rank.

    ``known`` are the codes of all profiles in order, ``place[i, j]`` the rank of code j in profile i
    (``ranks`` where it is not there); an n-gram that a profile has not is ``ranks`` away.
    """
    at = np.minimum(np.searchsorted(known, ranked), known.size - 1)
    where = np.where(known[at] == ranked, place[:, at], ranks)
    return np.where(where == ranks, ranks, np.abs(where - np.arange(ranked.size))).sum(1) / (ranks * ranked.size)


def predict(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: language and score.

    The score is the second distance's share of the two least ones (1 less the distance where one
    language is known). A null text or one without a letter gets ``und`` and 0. Equal distances go
    to the first language by name. ``keep`` names columns to pass through.
    """
    names = sorted(profiles)
    known = np.unique(np.array([c for p in profiles.values() for c in p] or [GAP], np.int64))
    place = np.full((len(names), known.size), ranks, np.int64)
    for i, name in enumerate(names):
        place[i, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))

    def make():
        def nearest(text: str) -> tuple[str, float]:
            ranked = rank_text(text, ranks)
            if not ranked.size or not names:
                return UNKNOWN, 0.0
            apart = distances(ranked, known, place, ranks)
            order = np.argsort(apart, kind="stable")
            first = float(apart[order[0]])
            if len(names) == 1:
                return names[0], 1.0 - first
            both = first + float(apart[order[1]])
            return names[order[0]], 1.0 - first / both if both > 0 else 0.5

        def run(texts: list[str]) -> dict:
            found = [nearest(t) for t in texts]
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return run

    return map_texts(docs, keep or ["doc_id"], make, "lang_pred string, score double")
