"""Grace hash deduplication of complete texts.

Records are dealt by hash to spill files in the shared folder; a bucket that is too large is dealt
again by the next bits of the hash until every bucket fits one open-addressing table, which compares
complete content. Before anything is shuffled, each task keeps one record for the copies it has
seen itself, so a text that fills a third of the table travels once per task, not once per row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, LongType, BinaryType

from seriesloom.llm.common import BLANK, texts_of
from seriesloom.sources.panels import stage

# Bytes of content that one table may hold, and that a task remembers of its own rows.
BUCKET_BYTES = 32 << 20
# Buckets that a level deals an oversize bucket into.
FANOUT = 64
MOST_LEVELS = 6
_BLANK = BLANK.encode()


def normalise(text: str) -> bytes:
    """UTF-8 of the text without ASCII white space (whose bytes occur in no other character)."""
    return text.encode("utf-8", "surrogatepass").translate(None, _BLANK)


class OpenTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0

    def _place(self, content: bytes, code: int) -> int:
        mask = len(self.slots) - 1
        at = code & mask
        while (held := int(self.slots[at])) >= 0:
            if self.hashes[held] == code and self.contents[held] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, content: bytes, code: int) -> tuple[int, bool]:
        """Number of the content, and whether it is new."""
        at = self._place(content, code)
        if self.slots[at] >= 0:
            return int(self.slots[at]), False
        number = len(self.contents)
        self.slots[at] = number
        self.contents.append(content)
        self.hashes.append(code)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(slots) - 1
            for i, c in enumerate(self.hashes):
                k = c & mask
                while slots[k] >= 0:
                    k = (k + 1) & mask
                slots[k] = i
            self.slots = slots
        return number, True


def _local(docs: DataFrame, limit: int) -> DataFrame:
    """Every row with the number of its local group; the first row of a group carries the content."""
    schema = StructType(
        [docs.schema["doc_id"], StructField("local", LongType()), StructField("n_points", LongType())]
        + [StructField("sha", StringType()), StructField("code", LongType()), StructField("content", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        table, first = OpenTable(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = texts_of(batch.column("text").to_pylist())
                local, shas, codes, contents = [], [], [], []
                for text in texts:
                    if table.bytes > limit:  # a new group of the same content is joined with the old one later
                        first += len(table.contents)
                        table = OpenTable()
                    content = normalise(text)
                    sha = hashlib.sha256(content)
                    code = int.from_bytes(sha.digest()[:8], "big") >> 1
                    number, new = table.add(content, code)
                    local.append(base + first + number)
                    shas.append(sha.hexdigest())
                    codes.append(code)
                    contents.append(content if new else None)
                arrays = [batch.column("doc_id"), pa.array(local, pa.int64()), pa.array([len(t) for t in texts], pa.int64())]
                arrays += [pa.array(shas, pa.string()), pa.array(codes, pa.int64()), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number equal contents alike, one bucket at a time; rows come sorted by bucket."""
    current, table = None, OpenTable()
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            local, rank = [], []
            buckets, codes = batch.column("bucket").to_pylist(), batch.column("code").to_pylist()
            contents = batch.column("content").to_pylist()
            for bucket, code, content in zip(buckets, codes, contents):
                if bucket != current:
                    current, table = bucket, OpenTable()
                rank.append(table.add(content, code)[0])
            local = batch.column("local")
            # bucket and number in it name the content
            yield pa.RecordBatch.from_arrays(
                [local, pa.array(buckets, pa.string()), pa.array(rank, pa.int64())], names=["local", "bucket", "number"]
            )


def _level(first_bits: int, level: int):
    """The hash bits that deal records at one level, written out: ``first_bits`` of them, then six a level."""
    used = first_bits + 6 * level
    bits = F.shiftright("code", 63 - used).bitwiseAND((1 << first_bits if level == 0 else FANOUT) - 1)
    return F.concat("bucket", F.lit("/"), F.hex(bits))


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space; null counts as empty. The
    row with the most code points in its original text stays, then the one with the smallest
    doc_id (a null doc_id comes last). Rows that share this doc_id and length are all marked kept.
    """
    rows = stage(_local(docs, bucket_bytes), "exact-records")
    groups = rows.groupBy("local").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    )
    records = rows.filter(F.col("content").isNotNull()).select(
        "local", "code", "content", F.lit("").alias("bucket"), F.octet_length("content").cast("long").alias("size")
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    # a first level fine enough for buckets of a quarter of the limit on average
    first_bits = min(24, max(8, math.ceil(math.log2(4 * total / bucket_bytes + 1))))
    spill = records
    fitting: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        dealt = spill.withColumn("bucket", _level(first_bits, level))
        sizes = dealt.groupBy("bucket").agg(
            F.sum("size").alias("total"), F.min("code").alias("low"), F.max("code").alias("high")
        )
        # a bucket of one hash value cannot be dealt further; its table holds each content once
        over = sizes.filter((F.col("total") > bucket_bytes) & (F.col("low") < F.col("high"))).select("bucket")
        large = stage(over, f"exact-oversize-{level}")
        if large.isEmpty() or level == MOST_LEVELS - 1:
            fitting.append(dealt)
            break
        fitting.append(dealt.join(large, "bucket", "left_anti"))
        spill = stage(dealt.join(large, "bucket", "left_semi"), f"exact-spill-{level}")
    every = fitting[0]
    for more in fitting[1:]:
        every = every.unionByName(more)
    sorted_rows = every.select("local", "code", "bucket", "content").repartition("bucket").sortWithinPartitions("bucket", "code")
    named = sorted_rows.mapInArrow(_classes, "local long, bucket string, number long")
    named = stage(named.join(groups, "local"), "exact-groups")
    whole = named.groupBy("bucket", "number").agg(F.sum("n").alias("group_size"), F.min("best").alias("keep"))
    keeps = named.select("local", "bucket", "number").join(whole, ["bucket", "number"]).select("local", "group_size", "keep")
    return (
        rows.select("doc_id", "local", "n_points", F.col("sha").alias("text_sha256"))
        .join(keeps, "local")
        .select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("n_points") == -F.col("keep.less"))).alias("kept"),
            "text_sha256",
        )
    )


def oracle() -> str:
    return r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        r AS (
          SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
          FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""
