"""Toxic passages by maximum-scoring segment search.

Words get log-odds of toxic against clean labelled documents with a Dirichlet prior. A linear-time
scan finds every maximal segment of a document's score sequence; extreme-value statistics turn each
segment's score into the number of such segments that chance would give, and a document's
significant segments together into one evidence value, which a logistic curve maps to a probability.

The only bounded sample is that of labelled rows (``sample``), from which the word weights and the
curve are fitted. All documents are scored over their whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import WordSplitter, id_hash, map_texts, mix, text_groups, texts_of, windows
from seriesloom.sources.panels import stage

# Words and word beginnings share this many counters; the table that goes to tasks has this size at any scale.
BUCKETS = 1 << 18
# Letters of a word's beginning, which stands for its inflected forms.
PREFIX = 4
SAMPLE = 50_000
FOLDS, HELD = 5, 0


def near_keys(texts: list[str], words: WordSplitter) -> np.ndarray:
    """Four minima of hashes over a text's runs of three words: near copies mostly share one."""
    out = np.zeros((len(texts), 4), np.int64)
    for lo, hi in text_groups(texts):
        hashes, counts, _ = words.split([t.lower() for t in texts[lo:hi]])
        runs, at = windows(hashes, counts, 3)
        owner = np.repeat(np.arange(counts.size), counts)[at]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if owner.size else owner
        # fewer than three words: the words together
        whole = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)])
        ends = np.cumsum(counts)
        for k in range(4):
            out[lo:hi, k] = mix(whole[ends] - whole[ends - counts] + np.uint64(k + 1)).view(np.int64)
            if owner.size:
                least = np.minimum.reduceat(mix(runs + np.uint64(k + 1)), first)
                out[lo + owner[first], k] = least.view(np.int64)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts and labels of labelled documents outside the held-out fold, near copies once.

    About ``sample`` of them are drawn by hash. The drawn labels are a bounded table, so they and
    not the texts are sent around.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (id_hash() % FOLDS != HELD))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def make():
        words = WordSplitter("alnum")

        def run(texts: list[str]) -> dict:
            keys = near_keys(texts, words)
            return {f"k{i}": keys[:, i] for i in range(4)}

        return run

    # one document of each group of near copies, so that no text teaches its own words many times over
    one = map_texts(drawn, ["doc_id", "y"], make, "k0 long, k1 long, k2 long, k3 long")
    for i in range(4):
        rest = [c for c in one.columns if c != f"k{i}"]
        one = one.groupBy(f"k{i}").agg(F.min(F.struct(*rest)).alias("r")).select("r.*")
    one = stage(one, "labelled-sample")
    return docs.select("doc_id", "text").join(F.broadcast(one.distinct()), "doc_id").select("y", "text")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordSplitter("alnum")
    total = np.zeros((2, BUCKETS), np.int64)
    for frame in frames:
        texts, y = texts_of(frame["text"]), frame["y"].to_numpy()
        for lo, hi in text_groups(texts):
            hashes, counts, _, heads = words.split([t.lower() for t in texts[lo:hi]], PREFIX)
            # a document counts each of its words once, so that no long or repetitive one decides
            owner = np.repeat(np.arange(lo, hi), counts)
            pairs = np.unique(np.concatenate([owner * BUCKETS + _bucket(h) for h in (hashes, heads)]))
            toxic = y[pairs // BUCKETS] > 0
            total[1] += np.bincount(pairs[toxic] % BUCKETS, minlength=BUCKETS)
            total[0] += np.bincount(pairs[~toxic] % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(total.sum(0))
    yield pd.DataFrame({"bucket": at, "clean": total[0, at], "toxic": total[1, at]})


def word_weights(sample: DataFrame, prior: float = 10_000.0, least_z: float = 4.0, gap_cost: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bucket, and its share of clean words.

    The score is the log-odds where they are surely positive, ``-gap_cost`` elsewhere.

    ``prior`` is the weight in words of the Dirichlet prior, which has the pooled word shares;
    ``least_z`` standard errors make a word sure.
    """
    rows = sample.mapInPandas(_bucket_counts, "bucket long, clean long, toxic long").groupBy("bucket")
    rows = rows.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # at most BUCKETS rows
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    clean[rows["bucket"].to_numpy()] = rows["clean"]
    toxic[rows["bucket"].to_numpy()] = rows["toxic"]
    share = (clean + toxic + 0.01) / (clean + toxic + 0.01).sum()
    a, b = toxic + prior * share, clean + prior * share
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    return np.where((z >= least_z) & (odds > 0), odds, -gap_cost).astype(np.float32), b / b.sum()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a sequence, in linear time.

    Every candidate is linked to the nearest earlier one that begins at a lower prefix sum, so that a search passes
    over a candidate once; where there is no such one, all candidates before are final.
    """
    at = np.flatnonzero(scores > 0)
    if not at.size:
        return []
    prefix = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    final: list[tuple[float, float, int, int]] = []
    open_: list[tuple[float, float, int, int]] = []
    link: list[int] = []
    for i in at.tolist():
        left, right, first = float(prefix[i]), float(prefix[i + 1]), i
        j = len(open_) - 1
        while True:
            while j >= 0 and open_[j][0] >= left:
                j = link[j]
            if j < 0 or open_[j][1] >= right:
                break
            left, first, before = open_[j][0], open_[j][2], link[j]
            del open_[j:], link[j:]
            j = before
        if j < 0:
            final += open_
            open_, link = [], []
        open_.append((left, right, first, i))
        link.append(j)
    return [(first, last, right - left) for left, right, first, last in final + open_]


def _scored(texts: list[str], words: WordSplitter, weights: np.ndarray) -> Iterator[tuple[int, list]]:
    for lo, hi in text_groups(texts):
        hashes, counts, _, heads = words.split([t.lower() for t in texts[lo:hi]], PREFIX)
        # a word is as toxic as itself or its beginning, whichever says more
        scores = np.maximum(weights[_bucket(hashes)], weights[_bucket(heads)])
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist()):
            yield n, maximal_segments(scores[end - n : end])


def extreme_value_scale(weights: np.ndarray, share_positive: np.ndarray) -> float:
    """The positive root of the moment equation of the scores of clean words."""
    up = weights > 0
    p = share_positive[up]
    rest = 1.0 - p.sum()
    cost = -float(weights[~up].max()) if (~up).any() else 0.1
    s = weights[up].astype(np.float64)

    def gap(rate: float) -> float:
        return float((p * np.exp(np.minimum(rate * s, 500))).sum() + rest * math.exp(-rate * cost) - 1)

    lo, hi = 1e-6, 1.0
    while gap(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _evidence(n: int, segments: list, rate: float, per_word: float, sure: float) -> tuple[float, list]:
    """How unlikely chance is to give a text's segments, as minus the log of a probability, and the significant ones.

    ``x`` of a segment is minus the log of the number of segments as good that chance gives in
    ``n`` words. The ``r`` best together have the law of a sum of extremes; the least likely ``r``
    counts.
    """
    per_text = math.log(max(per_word * n, 1e-12))
    x = sorted((rate * score - per_text for _, _, score in segments), reverse=True)
    best, total = 0.0, 0.0
    for r, each in enumerate(x, 1):
        total += each
        if total > 0:
            best = max(best, total + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(max(total, 1.0)))
    kept = [(a, b, float(rate * score - per_text)) for a, b, score in segments if rate * score - per_text >= sure]
    return best, kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


SPANS = "array<struct<first_word:int,last_word:int,evidence:double>>"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Word weights, extreme-value constants and curve from the labelled sample."""
    drawn = labelled_sample(docs, labels, sample)
    weights, share = word_weights(drawn)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordSplitter("alnum")
        for frame in frames:
            rows = list(_scored(texts_of(frame["text"]), words, sent.value))
            yield pd.DataFrame(
                {"y": frame["y"], "n": [n for n, _ in rows], "s": [[x[2] for x in found] for _, found in rows]}
            )

    rows = drawn.mapInPandas(segments, "y int, n long, s array<double>").toPandas()  # bounded by the sample
    y, n = rows["y"].to_numpy(float), rows["n"].to_numpy(float)
    if len(rows) == 0 or y.min() == y.max():
        return {"weights": weights, "rate": 1.0, "per_word": 1e-6, "curve": (_base_rate(y), 0.0)}
    clean = y == 0
    found = sum(len(s) for s in rows.loc[clean, "s"])
    per_word = (found + 0.5) / (n[clean].sum() + 1)
    rate = extreme_value_scale(weights, share) if (weights > 0).any() else 1.0
    spans = [[(0, 0, v) for v in s] for s in rows["s"]]
    x = np.array([_evidence(int(k), s, rate, per_word, SURE)[0] for k, s in zip(n, spans)])
    return {"weights": weights, "rate": rate, "per_word": per_word, "curve": _logistic(np.minimum(x, TOP), y)}


# Evidence from which a segment is significant (one in a hundred clean documents), and the most that counts.
SURE, TOP = math.log(100), 60.0


def _base_rate(y: np.ndarray) -> float:
    p = float(y.mean()) if y.size else 0.0
    return math.log((p + 0.01) / (1 - p + 0.01))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of ``docs (doc_id, text)`` with its score and its significant passages.

    A null or empty text has no words, no passage and the score of no evidence. Spans count words
    from 0, both ends included. Repeated rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model["weights"])
    rate, per_word, (a, b) = model["rate"], model["per_word"], model["curve"]

    def make():
        words = WordSplitter("alnum")

        def run(texts: list[str]) -> dict:
            rows = [(n, *_evidence(n, found, rate, per_word, SURE)) for n, found in _scored(texts, words, sent.value)]
            x = np.minimum(np.array([r[1] for r in rows]), TOP)
            return {
                "score": 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))),
                "n_words": [r[0] for r in rows],
                "spans": [[{"first_word": f, "last_word": last, "evidence": e} for f, last, e in r[2]] for r in rows],
            }

        return run

    return map_texts(docs, ["doc_id"], make, f"score double, n_words long, spans {SPANS}")
