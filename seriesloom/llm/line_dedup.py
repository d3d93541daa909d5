"""Line deduplication by sharded minimal perfect hashes.

Distinct keys of lines found in enough documents are dealt by hash to shards. Each shard gets a
minimal perfect hash whose value indexes three arrays: fingerprint, document count and the largest
doc_id. Documents probe the arrays; lines are never joined with lines. A shard has a bounded number
of keys, so a task holds one shard at a time however many shards there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, LongType

from seriesloom.llm.common import BLANK, mix, text_slices, texts_of
from seriesloom.sources.panels import stage

LEAST_LENGTH, LEAST_DOCS = 20, 3
SHARD_KEYS = 500_000
# Repeated lines below which a shard is not worth a second probing task.
LEAST_PROBES = 2_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return line.strip(BLANK).translate(_LOWER)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, ranked.

    A key sits in the first level where its bit is its own; the number of set bits before it is its
    index. A foreign key gets -1 or any index, so a caller compares fingerprints.
    """

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # size, words of 64 bits, bits set before each word
        self.size = int(keys.size)
        left, seen = keys.astype(np.uint64), 0
        while left.size:
            size = max(64, int(spread * left.size) // 64 * 64 + 64)
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.cumsum(np.concatenate([[0], np.bitwise_count(bits[:-1]).astype(np.int64)])) + seen
            self.levels.append((size, bits, before))
            seen += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(keys.size, -1, np.int64)
        open_ = np.arange(keys.size)
        for level, (size, bits, before) in enumerate(self.levels):
            at = self._place(keys[open_], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_[here]] = before[at[here] >> 6] + np.bitwise_count(below)
            open_ = open_[~here]
        return out

    def dump(self) -> bytes:
        head = np.array([self.size, len(self.levels), *[s for s, _, _ in self.levels]], np.int64).tobytes()
        return head + b"".join(b.tobytes() + r.astype(np.int64).tobytes() for _, b, r in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        self = cls.__new__(cls)
        self.size, n = np.frombuffer(raw, np.int64, 2).tolist()
        sizes, at = np.frombuffer(raw, np.int64, n, 16).tolist(), 16 + 8 * n
        self.levels = []
        for size in sizes:
            bits = np.frombuffer(raw, np.uint64, size // 64, at)
            ranks = np.frombuffer(raw, np.int64, size // 64, at + size // 8)
            self.levels.append((size, bits, ranks))
            at += size // 4
        return self


def _lines(docs: DataFrame, least_length: int) -> DataFrame:
    """Long enough lines of every row as two hashes; ``row`` and doc_id name the row, equal rows alike."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("row long, line long, h1 long, h2 long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, line, hashes = [], [], []
            for i, text in enumerate(texts_of(batch.column("text").to_pylist())):
                for j, each in enumerate(text.split("\n")):
                    if len(each) >= least_length and len(key := line_key(each)) >= least_length:
                        owner.append(i)
                        line.append(j)
                        hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
            both = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int64())
            arrays = [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(line, pa.int64())]
            arrays += [pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)).cast("int")


def _index(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its three arrays."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        h1 = frame["h1"].to_numpy(np.int64).view(np.uint64)
        # two keys may share their first hash; the second one of the pair is kept apart by adding its fingerprint
        order = np.lexsort((frame["h2"].to_numpy(), h1))
        h1, frame = h1[order], frame.iloc[order]
        twin = np.concatenate([[False], h1[1:] == h1[:-1]])
        table = PerfectHash(h1[~twin])
        at = table.index(h1[~twin])
        prints, counts, last = (np.zeros(table.size, np.int64) for _ in range(3))
        prints[at] = frame["h2"].to_numpy()[~twin]
        counts[at] = np.minimum(frame["n"].to_numpy()[~twin], np.iinfo(np.int32).max)
        last[at] = frame["last"].to_numpy()[~twin]
        rest = frame[twin][["h1", "h2", "n", "last"]].to_numpy(np.int64)
        blobs = [table.dump(), prints.tobytes(), counts.astype(np.int32).tobytes(), last.tobytes(), rest.tobytes()]
        lengths = np.array([len(b) for b in blobs], np.int64).tobytes()
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "blob": [lengths + b"".join(blobs)]})

    return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, blob binary")


class ShardIndex:
    """A shard's perfect hash with its fingerprint, count and last-document arrays."""

    def __init__(self, raw: bytes):
        at, parts = 40, []
        for n in np.frombuffer(raw, np.int64, 5).tolist():
            parts.append(raw[at : at + n])
            at += n
        self.table = PerfectHash.load(parts[0])
        self.prints, self.last = np.frombuffer(parts[1], np.int64), np.frombuffer(parts[3], np.int64)
        self.counts = np.frombuffer(parts[2], np.int32)
        self.rest = {(a, b): (n, last) for a, b, n, last in np.frombuffer(parts[4], np.int64).reshape(-1, 4).tolist()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0 if unknown) and largest doc_id of each key."""
        n, last = np.zeros(h1.size, np.int64), np.zeros(h1.size, np.int64)
        if self.table.size:
            at = self.table.index(h1.view(np.uint64))
            known = (at >= 0) & (self.prints[at] == h2)
            n[known], last[known] = self.counts[at[known]], self.last[at[known]]
        if self.rest:
            for i in np.flatnonzero(n == 0).tolist():
                n[i], last[i] = self.rest.get((int(h1[i]), int(h2[i])), (0, 0))
        return n, last


def _probe(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for batch in batches:  # sorted by shard, the arrays ahead of the lines
            blobs = batch.column("blob")
            shards = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("salt").to_numpy()
            borders = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
            for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                if shards[lo] != shard:
                    shard, index = shards[lo], None
                if part.column("blob").null_count < hi - lo:
                    index = ShardIndex(blobs[lo].as_py())
                    part = part.slice(1)
                if index is None or not part.num_rows:
                    continue  # no repeated line has this shard
                n, last = index.probe(part.column("h1").to_numpy(), part.column("h2").to_numpy())
                missing = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                drop = np.flatnonzero((n >= least_docs) & (missing | (ids != last)))
                yield part.take(pa.array(drop)).select(["doc_id", "row", "line"])

    return run


def line_drops(docs: DataFrame, least_length: int, least_docs: int) -> DataFrame:
    """``doc_id, row, line`` of every line to be dropped from ``docs (doc_id, row, text)``."""
    spark = docs.sparkSession
    lines = stage(_lines(docs, least_length), "lines")
    per_row = lines.groupBy("h1", "h2", "doc_id", "row").agg(F.lit(1).alias("one"))
    keys = per_row.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    # where every document that holds a line lacks an id, none is the largest: the line stays everywhere
    keys = stage(keys.filter((F.col("n") >= least_docs) & F.col("last").isNotNull()), "line-keys")
    n_keys, n_lines = keys.count(), lines.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * partitions, -(-n_keys // SHARD_KEYS))
    fair = max(LEAST_PROBES, n_lines // partitions)
    # one row per shard; a shard whose repeated lines exceed a task's fair share is probed by several tasks
    spans = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = keys.groupBy(_shard(shards).alias("shard")).agg(F.ceil(F.sum("n") / fair).cast("int").alias("load"))
    spans = F.broadcast(spans.join(loads, "shard", "left").select("shard", F.coalesce("load", F.lit(1)).alias("salts")))
    arrays = _index(keys, shards).join(spans, "shard").select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        *[F.lit(None).cast("long").alias(c) for c in ("row", "line", "h1", "h2")],
        "blob",
    )
    probes = lines.withColumn("shard", _shard(shards)).join(spans, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "row", "line"), "salts").cast("int").alias("salt"),
        "doc_id", "row", "line", "h1", "h2", F.lit(None).cast("binary").alias("blob"),
    )
    dealt = arrays.unionByName(probes).repartition("shard", "salt")
    ordered = dealt.sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    schema = StructType([docs.schema["doc_id"], StructField("row", LongType()), StructField("line", LongType())])
    return ordered.mapInArrow(_probe(least_docs), schema)


MADE = "n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def deduplicate(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, keep: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs (doc_id, text)`` with its remaining text.

    Keys of at least ``least_length`` code points held by at least ``least_docs`` rows lose all
    their lines except in the row of the largest doc_id holding it. A null or empty text is one
    empty line. Equal rows count as one document; rows that share a doc_id but not the text count
    each. A null doc_id is smaller than any other. ``keep`` names columns to pass through.
    """
    keep = keep or ["doc_id"]
    docs = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    named = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    drops = line_drops(named.select("doc_id", "row", "text"), least_length, least_docs)
    drops = drops.groupBy(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row")).agg(F.collect_set("line").alias("drops"))
    joined = named.join(drops, (F.col("row") == F.col("drop_row")) & F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    passed = [k for k in keep if k != "text"]
    schema = StructType([docs.schema[k] for k in passed] + list(StructType.fromDDL(MADE).fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            columns: list[list] = [[], [], [], []]
            for text, gone in zip(texts_of(batch.column("text").to_pylist()), batch.column("drops").to_pylist()):
                lines = text.split("\n")
                gone = set(gone or ())
                kept = "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text
                sha = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(columns, (len(lines), len(gone), sha, kept)):
                    column.append(value)
            arrays = [batch.column(k) for k in passed] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(passed) :])]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return joined.select(*dict.fromkeys([*passed, "text", "drops"])).mapInArrow(run, schema)


def oracle() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH l AS (
          SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        k AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{lower}') AS key FROM l),
        f AS (
          SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_LENGTH}
          GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
        m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON f.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id"""
