"""Similarity join of word n-gram sets by chosen paths.

A document is the set of its five-word shingles; two are linked when the Jaccard similarity of
their sets is 0.8 or more. Equal word sequences are folded into one representative first. A set is
embedded as the minima of independent hash functions, tokens that two sets share with a probability
equal to their similarity. Starting from all representatives, a run splits every bucket on a few
sampled tokens into smaller buckets of sets that share them, down a path of choices that depends
on the bucket alone. Buckets of bounded size are compared by brute force on the complete sets; as
many independent runs are made as the target recall needs.

A bucket that splits hardly shrink, or that is still large at the greatest depth, is compared whole:
its sets are dealt into blocks once, whatever number of such buckets they are in, by rising size, and every two
blocks that meet in one of them are compared; a task takes a block and up to PARTNERS others in turn. Sets whose
sizes differ by more than the threshold allows cannot be similar, so they are not sent to each other. A task gives
each set a number of links and the least set linked, so every pair that can be linked is compared and counted
once and no pair list is ever made of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import WordSplitter, map_texts, mix, text_groups, texts_of, windows
from seriesloom.sources.panels import stage

WIDTH, LEAST = 5, 0.8
TOKENS = 64
BUCKET, DEPTH = 96, 12
# Sets of a block, and blocks that a task compares with its own, one after the other.
BLOCK, PARTNERS = 128, 16
# Steps of set size that blocks tell apart, for each factor of e.
SIZE_STEPS = 32
# What rounding may take of a product of sizes and the threshold.
SLACK = 1e-3
RECALL = 0.985
# Tokens that the first split of a run samples.
ROOTS = 2
# Sampled tokens per bucket that two sets at the threshold share, on average.
BRANCHES = 1.25


def survival(depth: int, branches: float = BRANCHES) -> float:
    """Chance that a pair at the threshold is together in some bucket ``depth`` splits down."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-branches * q)
    return q


def runs_for(recall: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))))


def shingles(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words."""
    keys, at = windows(words, counts, width)
    ends = np.cumsum(counts)
    bounds = np.searchsorted(at, np.concatenate([[0], ends]))
    out = []
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
        if 0 < n < width:
            out.append(windows(words[end - n : end], np.array([n]), n)[0] + np.uint64(n))
        else:
            out.append(np.unique(keys[bounds[i] : bounds[i + 1]]))
    return out


def _constants(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2018)
    return rng.integers(0, 1 << 32, tokens, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, tokens, dtype=np.uint32)


def minima(keys: np.ndarray, multiplier: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The embedding of one set: the least value of each hash function over its shingles."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.full(multiplier.size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, keys.size, 4096):
        x = (low[at : at + 4096, None] * multiplier) ^ (high[at : at + 4096, None] + shift)
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        np.minimum(out, x.min(0), out=out)
    return out


def _embedding(tokens: int):
    def make():
        words = WordSplitter("alnum")
        multiplier, shift = _constants(tokens)

        def run(texts: list[str]) -> dict:
            keys: list[tuple[int | None, int | None]] = []
            signs: list[bytes | None] = []
            sizes: list[int | None] = []
            for lo, hi in text_groups(texts):
                hashes, counts, _ = words.split([t.lower() for t in texts[lo:hi]])
                ends = np.cumsum(counts)
                for n, end, found in zip(counts.tolist(), ends.tolist(), shingles(hashes, counts)):
                    if not n:
                        keys.append((None, None))
                        signs.append(None)
                        sizes.append(None)
                        continue
                    own = hashes[end - n : end]
                    place = mix(np.arange(1, n + 1, dtype=np.uint64))
                    with np.errstate(over="ignore"):
                        keys.append((int((own * place).sum().view(np.int64)), int(mix(own ^ place).sum().view(np.int64))))
                    signs.append(minima(found, multiplier, shift).tobytes())
                    sizes.append(found.size)
            return {"k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "sign": signs, "size": sizes}

        return run

    return make


def representatives(docs: DataFrame, tokens: int = TOKENS) -> tuple[DataFrame, DataFrame]:
    """``members (doc_id, rep)`` and ``signs (rep, sign, size)``; ``size`` is the number of distinct shingles.

    ``rep`` is the smallest doc_id with the same words in the same order. Documents without a word
    are in ``members`` with a null ``rep``: they have no shingle and are linked with nothing.
    """
    rows = map_texts(docs, ["doc_id"], _embedding(tokens), "k1 long, k2 long, sign binary, size long")
    rows = stage(rows, "shingle-signs")
    known = rows.filter(F.col("k1").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    reps = stage(reps, "shingle-copies")
    members = rows.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"], "left").select("doc_id", "rep", "n_copies")
    signs = known.select(F.col("doc_id").alias("id"), "k1", "k2", "sign", "size").join(
        reps.select("k1", "k2", "rep"), ["k1", "k2"]
    ).filter("id = rep").groupBy("rep").agg(F.min("sign").alias("sign"), F.min("size").alias("size"))
    return members, signs


def _bit(token: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << (token % 64).astype(np.uint64)).view(np.int64)


def _children(tokens: int, branches: float, least: float, at: int):
    """Buckets below a bucket for one of its sets: a hash of the path, the sampled token and its value.

    Tokens of the path, ``at`` of them, are not sampled again.
    """
    share = min(1.0, branches / (least * max(1, tokens - at)))
    bar = np.uint64(min(int(share * 2**64), 2**64 - 1))
    numbers = mix(np.arange(1, tokens + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                node = batch.column("node").to_numpy().view(np.uint64)
                signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, tokens)
                used = batch.column("used").to_numpy()
                fresh = (used[:, None] & _bit(np.arange(tokens))[None, :]) == 0
                row, token = np.nonzero((mix(node[:, None] ^ numbers) < bar) & fresh)
                below = mix(mix(node[row] + numbers[token]) ^ signs[row, token])
                columns = [pa.array(below.view(np.int64)), batch.column("rep").take(pa.array(row)), pa.array(used[row] | _bit(token))]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("n").take(pa.array(row))], names=["node", "rep", "used", "above"])

    return run


def _roots(tokens: int, runs: int):
    """First split of every set in every run, on tokens that no other run starts with while there are enough."""
    numbers = mix(np.arange(1, tokens + 1, dtype=np.uint64))
    roots = mix(np.arange(101, 101 + runs, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, tokens)
            for r in range(runs):
                for token in ((ROOTS * r + k) % tokens for k in range(ROOTS)):
                    below = mix(mix(roots[r : r + 1] + numbers[token]) ^ signs[:, token])
                    used = pa.array(np.repeat(_bit(np.array([token])), below.size))
                    # there is no bucket above to shrink
                    above = pa.nulls(below.size, pa.int64())
                    columns = [pa.array(below.view(np.int64)), batch.column("rep"), used, above]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "rep", "used", "above"])

    return run


# What a row is to a task between blocks: of its own block, compared with itself too or not, or of a partner block.
OWN, OWN_ONCE, PARTNER = 0, 1, 2


def _compare(width: int, least: float):
    """Brute force inside each bucket and between blocks over the complete sets; rows come sorted by bucket, side and block.

    Gives every set the least set it is connected with there and, in a bucket, its partners except
    those whose block is compared with its own; between blocks, the number of its partners. There a task holds
    its own block and one partner block at a time.
    """

    def bucket_links(reps: np.ndarray, sets: list[np.ndarray], sides: list, blocks: list, peers: list) -> list[tuple]:
        size = np.array([s.size for s in sets])
        _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = often[number] > 1
        if not shared.any():
            return []
        _, column = np.unique(number[shared], return_inverse=True)
        row = owner[shared]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1, 8192):  # blocks of shingles bound the matrix
            lo, hi = np.searchsorted(column, [at, at + 8192])
            block = np.zeros((len(sets), min(8192, int(column[-1]) + 1 - at)), np.float32)
            block[row[lo:hi], column[lo:hi] - at] = 1
            common += block @ block.T
        linked = common >= least * (size[:, None] + size[None, :] - common) - SLACK
        np.fill_diagonal(linked, False)
        if sides[0] is not None:
            side = np.array(sides)
            if side.any():
                linked &= side[:, None] != side[None, :]
        low = np.arange(len(sets))
        while True:  # least member of each connected part
            new = np.minimum(low, np.where(linked, low[None, :], len(sets)).min(1))
            new = new[new]
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero(linked.any(1)).tolist()
        if sides[0] is not None:
            return [(int(reps[i]), int(reps[low[i]]), [], int(linked[i].sum())) for i in some]
        for i in some:
            if peers[i]:
                apart = set(peers[i])
                linked[i] &= np.array([b not in apart for b in blocks])
        return [(int(reps[i]), int(reps[low[i]]), reps[linked[i]].tolist(), 0) for i in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordSplitter("alnum")
        current = part = None
        # a task's own block, whose sets are kept, and the rows being read
        base: list[tuple] = []
        held: list[tuple] = []

        def sets_of(texts: list[str]) -> list[np.ndarray]:
            sets: list[np.ndarray] = []
            for lo, hi in text_groups(texts):
                hashes, counts, _ = words.split([t.lower() for t in texts[lo:hi]])
                sets += shingles(hashes, counts, width)
            return sets

        def finish() -> list[tuple]:
            nonlocal base, held
            found = [(rep, keys, side, block, others) for (rep, side, block, others, _), keys in zip(held, sets_of([h[4] for h in held]))]
            held = []
            if found and found[0][2] in (OWN, OWN_ONCE):
                base, alone = [(rep, keys, 0, block, others) for rep, keys, _, block, others in found], found[0][2] == OWN
                found = base if alone else []
            elif found and found[0][2] == PARTNER:
                found = base + found
            if len(found) < 2:
                return []
            found.sort(key=lambda f: f[0])
            reps, *kinds = (list(column) for column in zip(*found))
            return bucket_links(np.array(reps), *kinds)

        def give(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=["rep", "least", "partners", "n"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch, out = whole.slice(lo, 512), []
                columns = [batch.column(c).to_pylist() for c in ("bucket", "rep", "side", "block", "peers")]
                for bucket, rep, side, block, others, text in zip(*columns, texts_of(batch.column("text").to_pylist())):
                    at = None if side is None else (side, block)
                    if bucket != current or at != part:
                        out += finish()
                        base = base if bucket == current else []
                        current, part = bucket, at
                    held.append((rep, side, block, others, text))
                if out:
                    yield give(out)
        if out := finish():
            yield give(out)

    return run


def leaf_buckets(
    signs: DataFrame, tokens: int, bucket: int, depth: int, branches: float, least: float, runs: int
) -> tuple[DataFrame, DataFrame]:
    """``bucket, rep, n`` of every bucket to be compared by itself, and of every one too large for that.

    Each distinct set of members comes once a level.
    """
    schema = "node long, rep long, used long, above long"
    level = stage(signs.mapInArrow(_roots(tokens, runs), schema), "path-level-1")
    leaves: list[DataFrame] = []
    heavy: list[DataFrame] = []
    for at in range(1, depth + 1):
        # two exclusive ors of hashes name a bucket's members, so that equal buckets of different paths meet
        counts = level.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("rep")).alias("sum1"),
            F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("sum2"),
            F.min("above").alias("above"),
        ).filter("n > 1")
        counts = stage(counts, f"path-counts-{at}")
        # a bucket that keeps more of the one above than a split makes copies only multiplies: it is compared whole
        whole = F.lit(at == depth) | F.coalesce(F.col("n") * (branches / least) > F.col("above"), F.lit(False))
        oversize = F.col("n") > bucket

        def members(chosen: DataFrame) -> DataFrame:
            named = chosen.groupBy("n", "sum1", "sum2").agg(F.min("node").alias("node")).select("node", "n")
            return level.join(named, "node").select(F.xxhash64("node", F.lit(at)).alias("bucket"), "rep", "n")

        leaves.append(members(counts.filter(~oversize)))
        heavy.append(members(counts.filter(oversize & whole)))
        large = counts.filter(oversize & ~whole).select("node", "n")
        if large.isEmpty():
            break
        below = level.select("node", "rep", "used").join(large, "node").join(signs, "rep").select("node", "rep", "used", "n", "sign")
        level = stage(below.mapInArrow(_children(tokens, branches, least, at), schema), f"path-level-{at + 1}")
    out = []
    for name, parts in (("path-leaves", leaves), ("path-heavy", heavy)):
        union = parts[0]
        for more in parts[1:]:
            union = union.unionByName(more)
        out.append(stage(union, name))
    return out[0], out[1]


def block_pairs(heavy: DataFrame, sizes: DataFrame, least: float = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``rep, size, block``, each set of a large bucket in one block, and ``a, b, near`` of blocks that meet in a bucket, a <= b.

    ``sizes (rep, size)`` orders the sets of a bucket before they are cut into blocks. Without ``near`` no set of one
    block can be as similar as ``least`` to one of the other.
    """
    home = heavy.groupBy("rep").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"))
    step = F.floor(F.log("size") * SIZE_STEPS)
    home = stage(home.join(sizes, "rep").withColumn("step", step), "path-homes")
    # places by rising size from sums over the steps; within a step a hash deals them
    steps = home.groupBy("home", "step").agg(F.count(F.lit(1)).alias("held"))
    along = Window.partitionBy("home").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("held").over(along), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("rep", F.lit(2)), F.col("held"))
    dealt = home.join(steps, ["home", "step"]).select("rep", "size", F.xxhash64("home", F.floor(place / block)).alias("block"))
    blocks = stage(dealt, "path-blocks")
    # buckets that meet the same blocks count once
    met = heavy.join(blocks, "rep").groupBy("bucket").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    bounds = blocks.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    pairs = _pairs(met.select("blocks").distinct()).distinct()
    for side in "ab":
        pairs = pairs.join(bounds.toDF(side, f"low_{side}", f"high_{side}"), side)
    near = (F.col("low_b") * least - SLACK <= F.col("high_a")) & (F.col("low_a") * least - SLACK <= F.col("high_b"))
    return blocks, stage(pairs.select("a", "b", "low_a", "high_a", near.alias("near")), "path-block-pairs")


def _pairs(met: DataFrame) -> DataFrame:
    """``a, b`` of every two of ``blocks``, a <= b, beside the other columns."""
    others = [c for c in met.columns if c != "blocks"]
    first = met.select(*others, "blocks", F.explode("blocks").alias("a"))
    return first.select(*others, "a", F.explode("blocks").alias("b")).filter("a <= b")


def comparisons(leaves: DataFrame, heavy: DataFrame, sizes: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """``bucket, rep, side, block, peers``: the sets of each task of brute force.

    ``side`` is null in a bucket (else what a set is to its task); there ``block`` is a set's block, if it has one, and ``peers`` are the
    blocks compared with that. Buckets whose pairs all meet between blocks are left out, and so are sets of a
    partner block that are too small or too large for every set of the task's own block.
    """
    alone = leaves.select("bucket", "rep", F.lit(None).cast("int").alias("side"))
    if heavy.isEmpty():
        return alone.withColumns({"block": F.lit(None).cast("long"), "peers": F.lit(None).cast("array<long>")})
    blocks, pairs = block_pairs(heavy, sizes, least, block)
    inside = leaves.join(blocks, "rep").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("held"), F.first("n").alias("n"), F.sort_array(F.collect_set("block")).alias("blocks")
    ).filter("held = n").select("bucket", "blocks")
    inside = stage(inside, "path-inside")
    covered = inside.select("bucket").join(_pairs(inside).join(pairs, ["a", "b"], "left_anti").select("bucket"), "bucket", "left_anti")
    near = pairs.filter("near").drop("near")
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    peers = blocks.join(both.groupBy(F.col("a").alias("block")).agg(F.collect_set("b").alias("peers")), "block")
    alone = alone.join(covered, "bucket", "left_anti").join(peers, "rep", "left").select("bucket", "rep", "side", "block", "peers")
    # a block with itself comes first, since a <= b
    turn = Window.partitionBy("a").orderBy("b")
    near = near.withColumn("task", F.floor((F.row_number().over(turn) - 1) / PARTNERS))
    name = F.xxhash64("a", "task", F.lit(-1)).alias("bucket")
    side = F.when(F.col("task") == 0, OWN).otherwise(OWN_ONCE)
    bounds = [F.col("low_a").alias("low"), F.col("high_a").alias("high")]
    own = near.select("a", "task", "low_a", "high_a").distinct().select(name, side.alias("side"), F.col("a").alias("block"), *bounds)
    sides = own.unionByName(near.filter("a < b").select(name, F.lit(PARTNER).alias("side"), F.col("b").alias("block"), *bounds))
    fits = (blocks["size"] * least - SLACK <= sides["high"]) & (sides["low"] * least - SLACK <= blocks["size"])
    tasks = sides.join(blocks, (sides["block"] == blocks["block"]) & fits).select(
        "bucket", "rep", "side", blocks["block"], F.lit(None).cast("array<long>").alias("peers")
    )
    return alone.unionByName(tasks)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``rep, root``: the least member of each connected component, by alternating stars.

    Each round links every node's larger neighbours, then its smaller ones, to its least neighbour,
    until nothing changes. Only minima per node are aggregated, so a node with very many neighbours
    combines inside the tasks.
    """
    edges = stage(edges.filter("a <> b").distinct(), "links")
    for turn in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, f"links-large-{turn}")
        # every edge now points down: a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stage(small.filter("a <> b").distinct(), f"links-small-{turn}")
        # a forest of stars: nobody has two parents, and no parent has a parent
        if new.groupBy("a").count().filter("count > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return new.select(F.col("a").alias("rep"), F.col("b").alias("root"))
        edges = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def join(
    docs: DataFrame,
    least: float = LEAST,
    recall: float = RECALL,
    width: int = WIDTH,
    tokens: int = TOKENS,
    bucket: int = BUCKET,
    depth: int = DEPTH,
    branches: float = BRANCHES,
) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest doc_id reachable over links and copies. ``n_links`` counts the
    different texts found similar to this one, each once. ``n_copies`` counts the rows with
    the same words. Words are runs of letters, digits and underscores in lower case; a text of
    fewer than ``width`` words is one shingle. A null text and one without a word stand alone
    (``n_copies`` 1), a row with null doc_id has a null class. Rows that share a doc_id share its class.
    """
    docs = docs.select("doc_id", "text")
    members, signs = representatives(docs, tokens)
    signs = stage(signs, "path-signs")
    leaves, heavy = leaf_buckets(signs, tokens, bucket, depth, branches, least, runs_for(recall, depth))
    tasks = comparisons(leaves, heavy, signs.select("rep", "size"), least)
    # one text per representative, wherever copies of it are
    needed = leaves.select("rep").unionByName(heavy.select("rep")).distinct()
    texts = docs.join(needed, F.col("doc_id") == F.col("rep"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    full = tasks.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("bucket", "rep", "side", "block", "peers", "text")
    compared = full.repartition("bucket").sortWithinPartitions("bucket", "side", "block").mapInArrow(
        _compare(width, least), "rep long, least long, partners array<long>, n long"
    )
    compared = stage(compared, "path-links")
    roots = components(compared.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    # as many partners as a set met in its buckets, whose number the runs and the depth bound, and those counted between blocks
    listed = F.size(F.array_distinct(F.flatten(F.collect_list("partners")))).cast("long")
    degree = compared.groupBy("rep").agg((listed + F.sum("n")).alias("n_links"))
    marks = stage(degree.join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "n_links"), "join-classes")
    return members.join(marks, "rep", "left").select(
        "doc_id",
        F.coalesce("root", "rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )
