"""Shared by the operators: input columns, words as arrays of hashes, small numeric helpers.

Every operator selects the columns it needs first, so extra columns of its input, whatever their
names, never meet the columns it makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# ASCII white space as the contracts name it.
BLANK = " \t\n\x0b\x0c\r"
# Characters that one pass of the word splitter holds.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def id_hash(column: str = "doc_id"):
    """crc32 of an id written as text, the hash that the folds are dealt by."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of a 64-bit hash: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _inside(kind: str) -> np.ndarray:
    """Whether each code point belongs to a word of this kind."""
    inside = np.zeros(0x110000, dtype=bool)
    if kind == "alnum":
        inside[:] = [chr(c).isalnum() for c in range(0x110000)]
        inside[ord("_")] = True
    else:
        inside[:] = True
        inside[[ord(c) for c in BLANK]] = False
    return inside


class WordSplitter:
    """Words of many texts at once, as 64-bit hashes.

    ``kind`` says what a word is: ``"alnum"`` for runs of letters, digits and underscores,
    ``"run"`` for runs of anything but ASCII white space. A prefix sum of a polynomial over the
    code points gives the hash of every word without a step per word. A word of any length is one
    word: where a long text has to be cut inside one, its hash goes on in the next piece.
    """

    def __init__(self, kind: str):
        self.inside = _inside(kind)
        size = PIECE + 2
        self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
        self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE, np.uint64)]))

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], bool]]:
        """Groups of texts of at most PIECE characters, and whether the first word began in the piece before.

        A longer text is cut between words if it can be.
        """
        owners: list[int] = []
        parts: list[str] = []
        held = 0

        def within(text: str, at: int) -> bool:
            return 0 < at < len(text) and bool(self.inside[ord(text[at - 1])] and self.inside[ord(text[at])])

        for i, text in enumerate(texts):
            if len(text) + 1 > PIECE:
                if parts:
                    yield owners, parts, False
                    owners, parts, held = [], [], 0
                at = 0
                while at < len(text):
                    end = cut = min(at + PIECE - 1, len(text))
                    while cut > at and within(text, cut):
                        cut -= 1
                    cut = cut if cut > at else end
                    yield [i], [text[at:cut]], within(text, at)
                    at = cut
                continue
            if held + len(text) + 1 > PIECE:
                yield owners, parts, False
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(text)
            held += len(text) + 1
        if parts:
            yield owners, parts, False

    def split(self, texts: list[str], prefix: int = 0) -> tuple[np.ndarray, ...]:
        """Word hashes of all texts in order, words per text, and characters in words per text.

        With ``prefix`` also hashes of each word's first ``prefix`` characters (of a shorter word: of all).
        """
        sums: list[np.ndarray] = []
        heads: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        chars = np.zeros(len(texts), np.int64)
        last = 0  # length so far of the last word
        for owners, parts, goes_on in self._pieces(texts):
            codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = self.inside[codes]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            if not starts.size:
                continue
            total = np.zeros(codes.size + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: codes.size], out=total[1:])
            found = (total[ends] - total[starts]) * self.down[starts]
            begun = (total[np.minimum(starts + prefix, ends)] - total[starts]) * self.down[starts]
            first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
            owner = np.asarray(owners)[np.searchsorted(first, starts, side="right") - 1]
            chars += np.bincount(owner, weights=ends - starts, minlength=len(texts)).astype(np.int64)
            if goes_on:
                size = int(ends[0])
                shift = np.uint64(pow(_BASE, last, 1 << 64))
                sums[-1][-1:] += found[:1] * shift
                if last < prefix:
                    short = min(prefix - last, size)
                    heads[-1][-1:] += (total[short : short + 1] - total[:1]) * shift
                last = last + size if starts.size == 1 else int(ends[-1] - starts[-1])
                found, begun, owner = found[1:], begun[1:], owner[1:]
            else:
                last = int(ends[-1] - starts[-1])
            counts += np.bincount(owner, minlength=len(texts))
            if found.size:
                sums.append(found)
                heads.append(begun)
        hashes = mix(np.concatenate(sums)) if sums else np.zeros(0, np.uint64)
        if not prefix:
            return hashes, counts, chars
        return hashes, counts, chars, mix(~np.concatenate(heads)) if heads else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay inside one text, and the place of each run's first word."""
    n = hashes.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(_BASE) + hashes[k : k + n])
    owner = np.repeat(np.arange(counts.size), counts)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return total[at], at


def text_groups(texts: list[str], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``size`` characters together."""
    lo = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield lo, i
            lo, held = i, 0
        held += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


# Bytes of text that a task takes at a time, unless one text is longer.
SLICE = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at SLICE bytes, unless the caller has set a limit.

    Their number of rows alone does not bound texts: the buffers of 10,000 take a task tens of MB in the JVM and again in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(SLICE))


def text_slices(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in order, ``size`` bytes of ``text`` at a time."""
    size = size or SLICE
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(lengths + 1)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


USED = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work``, which keeps its input's columns, under names that no operator makes.

    Columns other than those of ``documents`` are called ``extra_i`` inside and get their own names back.
    """
    inside = [c if c in USED else f"extra_{i}" for i, c in enumerate(docs.columns)]
    out = work(docs.toDF(*inside))
    return out.select(*[F.col(a).alias(b) for a, b in zip(inside, docs.columns)])


def texts_of(column) -> list[str]:
    """A pandas text column as a list, null as the empty text."""
    return [t if isinstance(t, str) else "" for t in column]


def map_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list[str]], dict]], made: str) -> DataFrame:
    """Add columns computed from whole texts, a slice of an Arrow batch at a time.

    ``make`` runs once a task and returns a function from the slice's texts (null as empty) to the
    columns named in the DDL string ``made``. The columns in ``keep`` pass through untouched, nulls
    included.
    """
    new = StructType.fromDDL(made)
    schema = StructType([df.schema[k] for k in keep] + list(new.fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in text_slices(batches):
            columns = work(texts_of(batch.column("text").to_pylist()))
            arrays = [batch.column(k) for k in keep] + [pa.array(columns[f.name], type=arrow.field(f.name).type) for f in new]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
