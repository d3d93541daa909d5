"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

Single words and word pairs are hashed into a fixed number of buckets. One multinomial is counted
over the trusted documents and one over the whole raw corpus; a document's mean log ratio per
n-gram is compared with a fixed threshold, the same for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import BLANK, WordSplitter, map_texts, text_groups, texts_of, windows

BUCKETS = 1 << 16
SAMPLE = 50_000
SMOOTHING = 1.0
# Mean log ratio per n-gram below which a document is turned down.
LEAST_RATIO = -0.2
SYMBOLS = "#*$%&|<>"


def _buckets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text each belongs to."""
    owner = np.repeat(np.arange(counts.size), counts)
    pairs, at = windows(hashes, counts, 2)
    both = np.concatenate([hashes, pairs]) % np.uint64(BUCKETS)
    return both.astype(np.int64), np.concatenate([owner, owner[at]])


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, total = WordSplitter("run"), np.zeros(BUCKETS, np.int64)
    for frame in frames:
        texts = texts_of(frame["text"])
        for lo, hi in text_groups(texts):
            hashes, counts, _ = words.split(texts[lo:hi])
            total += np.bincount(_buckets(hashes, counts)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over whole texts; every task sends at most one row per bucket."""
    rows = docs.select("text").mapInPandas(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS)
    total[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return total


def trusted_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts of about ``sample`` documents labelled as good, drawn by hash; only the drawn ids are sent around."""
    known = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    return docs.select("doc_id", "text").join(F.broadcast(known.distinct()), "doc_id", "left_semi")


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log of trusted over raw share of every bucket. Without a trusted document all are 0."""
    raw, good = bucket_counts(docs), bucket_counts(trusted_sample(docs, labels, sample))
    if not good.sum():
        return np.zeros(BUCKETS, np.float32)
    share = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    # the trusted counts lean on the raw shares, so buckets unseen among them stay near even
    lean = SMOOTHING * BUCKETS
    return np.log((good + lean * share) / (good.sum() + lean) / share).astype(np.float32)


MADE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, kept boolean"
)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that the text holds twice or more."""
    keys, at = windows(hashes, counts, 3)
    owner = np.repeat(np.arange(counts.size), counts)
    if not keys.size:
        return np.zeros(counts.size, np.int64)
    order = np.lexsort((keys, owner[at]))
    k, o = keys[order], owner[at][order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    inside = np.zeros(hashes.size, dtype=bool)
    first = at[order[twice]]
    for step in range(3):
        inside[first + step] = True
    return np.bincount(owner[inside], minlength=counts.size)


def judge(docs: DataFrame, ratios: np.ndarray, least_ratio: float = LEAST_RATIO, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)`` with its statistics and verdict.

    ``base_failed`` marks fewer than 50 words, or more than half of them in repeated three-word
    windows; such documents are not kept. The others are kept if ``ratio``, the mean log ratio of
    their n-grams, is at least ``least_ratio``. A null or empty text has no words and fails.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        words = WordSplitter("run")

        def part(texts: list[str]) -> tuple[np.ndarray, ...]:
            hashes, n, chars = words.split(texts)
            bucket, owner = _buckets(hashes, n)
            total = np.bincount(owner, weights=sent.value[bucket], minlength=len(texts))
            ratio = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts])
            lines = np.array([duplicate_lines(t) for t in texts])
            repeat = repeated_words(hashes, n)
            failed = (n < 50) | (100 * repeat > 50 * n)
            return n, chars, symbols, lines, repeat, failed, ratio, ~failed & (ratio >= least_ratio)

        def run(texts: list[str]) -> dict:
            parts = [part(texts[lo:hi]) for lo, hi in text_groups(texts)]
            names = [f.split()[0] for f in MADE.split(", ")]
            return {k: np.concatenate([p[i] for p in parts]) if parts else [] for i, k in enumerate(names)}

        return run

    return map_texts(docs, keep or ["doc_id"], make, MADE)
