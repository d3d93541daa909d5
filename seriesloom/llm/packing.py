"""Concatenate and cut: all documents as one token stream in windows of fixed length.

First pass: tokens are staged with the running total inside their partition. Prefix sums over the
partitions' totals give every document its place in the stream without moving a token. Second pass:
windows of fixed length are cut; a document on a window's border becomes two pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, LongType, BinaryType, IntegerType

from seriesloom.llm.common import text_slices, texts_of
from seriesloom.sources.panels import stage

LENGTH = 2048
END_ID = 1
# Words whose ids a task remembers; a full memory is emptied, not frozen.
REMEMBERED = 600_000
# Bytes of texts that are encoded together.
TOGETHER = 1 << 23
# Words of a line, and lines that the tokenizer takes in one call.
LINE, LINES = 50, 200
# Signs that always form a token run of their own beside letters.
_SIGNS = ".,!?;:|\"()[]{}*#$%&<>-+=/"
# Lower-case words that the vocabulary's normaliser and pattern leave as they are.
_PLAIN = "^[a-zß-öø-ÿ]+$"
# Letters whose normal form or lower case holds a mark, which the pattern joins with signs.
_MARKED = (
    r"[\x{130}\x{958}-\x{95F}\x{9DC}-\x{9DD}\x{9DF}\x{A33}\x{A36}\x{A59}-\x{A5B}\x{A5E}\x{B5C}-\x{B5D}\x{F43}\x{F4D}\x{F52}\x{F57}"
    r"\x{F5C}\x{F69}\x{FB1D}\x{FB1F}\x{FB2A}-\x{FB36}\x{FB38}-\x{FB3C}\x{FB3E}\x{FB40}-\x{FB41}\x{FB43}-\x{FB44}\x{FB46}-\x{FB4E}]"
)


def _flat(array: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer]:
    """Bounds of the values, and the values in a row."""
    _, bounds, data = array.buffers()
    return np.frombuffer(bounds, np.int64)[array.offset : array.offset + len(array) + 1], data or pa.py_buffer(b"")


def _tails(words: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """The last ``sizes`` bytes of each word."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) + np.repeat(ends - bounds[1:], sizes)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def _letters(words: pa.StringArray) -> pa.BooleanArray:
    """Whether a word is of letters alone, also once it is composed and in lower case."""
    return pc.and_not(pc.utf8_is_alpha(words), pc.match_substring_regex(words, _MARKED))


class WordTokenizer:
    """Ids of whole texts by way of the ids of their words.

    The vocabulary's normaliser and pattern never join characters across white space, so a text's
    ids are those of its words in a row, and words repeat far more than texts do. Splitting, telling
    words apart and putting their ids in a row are Arrow's; the tokenizer sees each distinct word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        # the same model, without the steps that change nothing in plain words
        self.plain = Tokenizer(self.encoder.model)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        self.dtype = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _singly(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        encoded = self.encoder.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
        return pa.array([np.array(e.ids, self.dtype).tobytes() for e in encoded], pa.large_binary())

    def _lines(self, encoder, words: pa.StringArray) -> Iterator[pa.LargeBinaryArray]:
        """Words of letters, many to a line; a word's last id tells where it ends."""
        for at in range(0, len(words), LINE * LINES):
            part = words.slice(at, LINE * LINES)
            cuts = pa.array([*range(0, len(part), LINE), len(part)], pa.int32())
            lines = pc.binary_join(pa.ListArray.from_arrays(cuts, part), " ").to_pylist()
            encoded = encoder.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in encoded])
            ends = np.flatnonzero(self.last[ids]) + 1
            if ends.size == len(part) and ends[-1] == ids.size:
                bounds = np.concatenate([[0], ends]) * ids.itemsize
                yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            else:  # some word is not one token run
                yield self._singly(part)

    def _learn(self, words: pa.StringArray) -> None:
        """Add words to the memory."""
        letters = _letters(words)
        plain = pc.match_substring_regex(words, _PLAIN)
        kinds = [plain, pc.and_not(letters, plain), pc.invert(pc.or_(letters, plain))]
        kinds = [words.filter(k) for k in kinds]
        ids = [*self._lines(self.plain, kinds[0]), *self._lines(self.encoder, kinds[1]), self._singly(kinds[2])]
        self.words, self.ids = pa.concat_arrays([self.words, *kinds]), pa.concat_arrays([self.ids, *ids])

    def _known(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words."""
        new = words.filter(pc.is_null(pc.index_in(words, self.words)))
        if len(self.words) + len(new) > REMEMBERED:
            self._forget()
            new = words
        if len(new):
            self._learn(new)
        return self.ids.take(pc.index_in(words, self.words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed integers of ``dtype``."""
        # names of special tokens keep their case
        whole = {i: t for i, t in enumerate(texts) if "<|" in t}
        lower = [t.lower() if "Σ" not in t and "İ" not in t else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(["" if i in whole else t for i, t in enumerate(lower)], pa.string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # signs at the end of a word of letters are a word of their own
        base = pc.ascii_rtrim(words, characters=_SIGNS)
        letters = _letters(base)
        size = (pc.binary_length(words).to_numpy() - pc.binary_length(base).to_numpy()) * letters.to_numpy(zero_copy_only=False)
        signed = np.flatnonzero(size)
        parts = pa.concat_arrays([pc.if_else(letters, base, words), _tails(words.take(pa.array(signed)), size[signed])]).dictionary_encode()
        place = parts.indices.to_numpy()
        known = pa.concat_arrays([self._known(parts.dictionary), pa.array([b""], pa.large_binary())])
        pairs = np.full((len(words), 2), len(known) - 1)
        pairs[:, 0] = place[: len(words)]
        pairs[signed, 1] = place[len(words) :]
        bounds, data = _flat(known.take(pa.array(pairs.ravel())))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds[::2].copy()), data])
        bounds, data = _flat(ids.take(coded.indices))
        ends = bounds[split.offsets.to_numpy()].tolist()
        out = [data[lo:hi].to_pybytes() for lo, hi in zip(ends, ends[1:])]
        for i, text in whole.items():
            out[i] = np.array(self.encoder.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return out


def tokenize(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = END_ID) -> DataFrame:
    """First pass, staged: ``doc_id, part, before, n, ids``.

    ``before`` counts the ids of earlier rows of the partition ``part``. ``tokenizer`` is the path
    of a vocabulary file on the executors, or a function that finds it there.
    """
    schema = StructType(
        [docs.schema["doc_id"], StructField("part", IntegerType()), StructField("before", LongType())]
        + [StructField("n", LongType()), StructField("ids", BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer() if callable(tokenizer) else tokenizer)
        end, width = np.array([end_id], dtype=words.dtype).tobytes(), np.dtype(words.dtype).itemsize
        part, total = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, TOGETHER):
            ids = [x + end for x in words.encode(texts_of(batch.column("text").to_pylist()))]
            n = [len(x) // width for x in ids]
            before = list(accumulate(n, initial=total))
            total = before.pop()
            arrays = [batch.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64())]
            arrays += [pa.array(n, pa.int64()), pa.array(ids, arrow.field("ids").type)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "token-stream")


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs (doc_id, text)``.

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Sequences
    hold ``length`` ids, the last one what is left. ``ids`` are a piece's ids as little-endian
    unsigned 32-bit integers. Repeated rows are packed as often as they come.
    """
    staged = tokenize(docs, tokenizer, end_id)
    # one row per partition of the first pass, no more than the driver has scheduled as tasks
    totals = sorted(tuple(r) for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = dict(zip([p for p, _ in totals], accumulate((n for _, n in totals), initial=0)))
    sent = docs.sparkSession.sparkContext.broadcast(starts)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PIECES).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows: list[list] = [[] for _ in range(8)]
                columns = zip(*(batch.column(c).to_pylist() for c in ("part", "before", "n", "ids")))
                for row, (part, before, n, raw) in enumerate(columns):
                    ids = np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}")).astype("<u4")
                    place, start = sent.value[part] + before, 0
                    while start < n:
                        offset = (place + start) % length
                        size = min(length - offset, n - start)
                        piece = ids[start : start + size].tobytes()
                        for column, value in zip(
                            rows, (row, start, size, zlib.crc32(piece), n, (place + start) // length, offset, piece)
                        ):
                            column.append(value)
                        start += size
                arrays = [batch.column("doc_id").take(pa.array(rows[0], pa.int64()))]
                arrays += [pa.array(v, arrow.field(k).type) for k, v in zip(arrow.names[1:], rows[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return staged.mapInArrow(run, schema)
