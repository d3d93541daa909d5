"""Mixing sources to target weights by fixed-length blocks.

Each source is one stream of words, packed into blocks of fixed length; block borders come from
prefix sums, so no word is moved. Every source gets as many slots as its target needs. The slots are
dealt to output shards by a multinomial draw, a pseudorandom permutation of the source's block
numbers maps each slot to a block, and blocks meet documents by index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesloom.llm.common import shielded, text_slices
from seriesloom.sources.panels import stage

BLOCK = 64
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SHARD_SLOTS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, total: float | None = None, weights=WEIGHTS, most: int = MOST_REPEATS) -> dict:
    """Words wanted of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the total; a share above
    ``most`` times its source stops there and the excess is shared again by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = float(sum(sizes.values()) if total is None else total)
    out: dict = {}
    free = list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def permute(index: Column, blocks: Column, multiplier: Column, shift: Column) -> Column:
    """Pseudorandom permutation of the numbers below ``blocks``; ``multiplier`` has no factor in common with it."""
    product = index.cast("decimal(38,0)") * multiplier.cast("decimal(38,0)") + shift.cast("decimal(38,0)")
    return F.pmod(product, blocks.cast("decimal(38,0)")).cast("long")


def _plan(sizes: dict, seed: int, block: int) -> list[tuple]:
    """One row per source: its size, target, blocks, full rounds, remaining slots and permutation."""
    rows = []
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets(sizes)
    for k, s in enumerate(names):
        size, target = sizes[s], wanted[s]
        if not size:
            rows.append((k, s, size, target, 0, 0, 1, 0, 0, 0))
            continue
        blocks = -(-size // block)
        words = min(round(target), MOST_REPEATS * size)
        rounds, rest = divmod(words, size)
        rng = np.random.default_rng([seed, k])
        multiplier = int(rng.integers(1, blocks + 1)) | 1
        while math.gcd(multiplier, blocks) != 1:
            multiplier += 2
        shift = int(rng.integers(0, blocks))
        # where the short last block falls in the permuted order: solve multiplier * i + shift = blocks - 1
        place = (blocks - 1 - shift) * pow(multiplier, -1, blocks) % blocks if blocks > 1 else 0
        short = size - (blocks - 1) * block
        slots = -(-rest // block)
        if rest and place < slots and (slots - 1) * block + short < rest:
            slots += 1
        before = (slots - 1) * block - (block - short if place < slots - 1 else 0) if slots else 0
        rows.append((k, s, size, target, rounds * blocks + slots, blocks, multiplier, shift, rounds, rest - before))
    return rows


PLAN = (
    "src int, source string, source_size long, target double, slots long, blocks long, multiplier long, shift long, "
    "rounds long, last_words long"
)


def _draws(seed: int, shards: int):
    """Slots of each source in each shard: a multinomial draw, so a shard's mix follows the targets by chance alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for src, slots in zip(frame["src"], frame["slots"]):
                drawn = np.random.default_rng([seed, int(src), 1]).multinomial(int(slots), np.full(shards, 1 / shards))
                first = np.cumsum(drawn) - drawn
                at = np.flatnonzero(drawn)
                yield pd.DataFrame({"src": src, "shard": at, "first": first[at], "n": drawn[at]})

    return run


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs (doc_id, source, text)``: documents and pieces.

    First table, one row per row of ``docs``: ``doc_id, size, source_size, target, taken``. Second
    table, the mix itself: ``doc_id, row, shard, slot, round, first_word, n_words``, words ``first_word``
    onward of the document. A null text has size 0 and is never taken; a source without words has
    target 0. Equal rows share their takings evenly as parts of one row (``row`` is a hash of the
    whole row); no row gives more than three times its words.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("row"),
    )
    rows = stage(rows, "mix-sizes")
    # a mix has a weight per source: this table is as long as the recipe, whatever the rows
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    plan_rows = _plan(sizes, seed, block)
    recipe = spark.createDataFrame(plan_rows, PLAN)
    plan = F.broadcast(recipe)  # one row per source
    slots = sum(r[4] for r in plan_rows)
    shards = max(1, -(-slots // shard_slots))

    # place of every document in its source's stream: prefix sums in chunks, then over the chunks
    chunks = math.isqrt(rows.count()) + 1  # as many chunks as rows in one: both sums stay short
    named = plan.select("src", F.col("source").alias("name"), "source_size", "target")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("name")))
    placed = placed.select("src", "doc_id", "row", "size", "source_size", "target", F.pmod("row", F.lit(chunks)).alias("chunk"))
    inside = Window.partitionBy("src", "chunk").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = placed.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("src", "chunk", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("start"))
    placed = stage(placed, "mix-places").join(totals, ["src", "chunk"])
    placed = stage(placed.withColumn("begin", F.col("start") + F.col("before")).drop("start", "before", "chunk"), "mix-stream")

    blocks = placed.filter("size > 0").select(
        "src", "doc_id", "row", "begin", "size",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"),
    )
    # from the recipe without the hint, which would pass on to the slots made of it
    cells = recipe.filter("slots > 0").select("src", "slots").repartition("src").mapInPandas(
        _draws(seed, shards), "src int, shard long, first long, n long"
    )
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))))
    # few rows that become many: the number of tasks follows the slots, not the bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // SHARD_SLOTS))
    cells = cells.repartition(tasks, "src", "shard", "part")
    drawn = cells.select(
        "src", "shard",
        F.explode(F.sequence(F.col("first") + F.col("part"), F.col("first") + F.least(F.col("part") + 4096, "n") - 1)).alias("slot"),
    ).join(plan.select("src", "slots", "blocks", "multiplier", "shift", "rounds", "last_words"), "src")
    drawn = drawn.select(
        "src", "shard", "slot",
        F.expr("slot div blocks").alias("round"),
        permute(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("multiplier"), F.col("shift")).alias("block"),
        # the last slot of a source gives only the words that its target still lacks
        F.when((F.col("slot") == F.col("slots") - 1) & (F.col("slots") > F.col("rounds") * F.col("blocks")), F.col("last_words"))
        .otherwise(F.lit(block)).alias("words"),
    )
    begin = F.greatest(F.col("begin"), F.col("block") * block)
    end = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("words"))
    pieces = drawn.join(blocks, ["src", "block"]).select(
        "doc_id", "row", "shard", "slot", "round", (begin - F.col("begin")).alias("first_word"), (end - begin).alias("n_words")
    ).filter("n_words > 0")
    return placed, pieces


def mixed_documents(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document with the words the mix takes of it, repeats counted."""
    taken = pieces.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("r")).agg(F.sum("n_words").alias("taken"))
    copies = Window.partitionBy("row", "doc_id")
    whole = placed.withColumn("copies", F.count(F.lit(1)).over(copies)).withColumn("copy", F.row_number().over(copies.orderBy("begin")))
    share = F.floor(F.col("taken") / F.col("copies")) + (F.col("copy") <= F.col("taken") % F.col("copies")).cast("long")
    return whole.join(taken, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``.

    A document comes once for each round of its source that takes of it; its text is cut to the
    words taken in that round, each run of neighbouring words as it stands, runs joined by a line
    break. ``n_chars`` becomes the length of that text. Documents of which nothing is taken go.
    """
    return shielded(docs, lambda inner: _cut_texts(inner, pieces))


def _cut_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    columns = docs.columns
    named = docs.withColumn("row", F.xxhash64("doc_id", "source", "text")).dropDuplicates(["row", "doc_id"])
    spans = F.array_sort(F.collect_list(F.struct("first_word", "n_words")))
    rounds = pieces.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("r"), "round").agg(spans.alias("spans"))
    joined = named.join(rounds, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("id")))
    passed = [c for c in columns if c not in ("text", "n_chars")]
    schema = StructType([docs.schema[c] for c in columns])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in text_slices(batches):
            texts = [cut(t, s, word) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            made = {"text": texts, "n_chars": [len(t) for t in texts]}
            arrays = [batch.column(c) if c in passed else pa.array(made[c], arrow.field(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return joined.select(*passed, "text", "spans").mapInArrow(run, schema)


def cut(text: str, spans: list[dict], word: re.Pattern) -> str:
    """The words of the spans; neighbouring spans are one run."""
    runs: list[list[int]] = []
    for span in spans:
        first, end = span["first_word"], span["first_word"] + span["n_words"]
        if runs and runs[-1][1] == first:
            runs[-1][1] = end
        else:
            runs.append([first, end])
    places = [m.span() for m in word.finditer(text)]
    if runs == [[0, len(places)]]:
        return text
    return "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in runs)
