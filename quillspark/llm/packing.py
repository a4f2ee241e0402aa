"""Harmonic packing of token sequences.

A document's length (what is left of it after whole sequences) has the reciprocal-capacity class j where it is above
capacity / (j + 1) and at most capacity / j; a bin of class j takes exactly j documents.  Documents are cut only where a
sequence is full: a bin that has its j documents has room for less than one more of its class, and the next document of the
class closes it with its head; what is left of that document is classed anew.  Lengths of capacity / ``classes`` or less
share the last class, whose bins take documents until one closes them.  Bins are filled by each task on its own, without a
shuffle; a task has one open bin a class at most.  When it ends, what is open is joined to whole sequences and a rest that
is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END_ID = 2
#: Entries that a worker's word cache may hold before it starts anew; it bounds memory and changes no id.
CACHE_WORDS = 300_000

_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
#: White space to the tokenizer; Python's own class has U+001C to U+001F besides.
_SPACE = "\\t-\\r \\x85\\xa0"
#: The tokenizer's own word pattern, spelt out for characters below U+0100.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


class WordCachedTokenizer:
    """Token ids of whole texts, by a tokenizer file whose merges never cross its words.

    The ids of a word are asked from the tokenizer once and then kept, as Zipf's law makes most words repeats.
    Texts with characters from U+0100 on, or with an added token's string, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._words = Tokenizer(self._whole.model)
        self._words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        vocabulary = self._whole.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self._ends[i] = token.endswith("</w>")
        self._cache: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self._words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self._ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer's words do not end with </w>")
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (cuts * 4).tolist(), strict=True):
            self._cache[word] = raw[start:end]
            start = end

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[str] | None] = []
        for text in texts:
            simple = not text or (max(text) < "Ā" and not any(a in text for a in self._added))
            split.append(_WORDS.findall(text.lower()) if simple else None)
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if new := {w for words in split if words for w in words if w not in cache}:
            self._learn(list(new))
        return [
            b"".join([cache[w] for w in words])
            if words is not None
            else np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for text, words in zip(texts, split, strict=True)
        ]


class HarmonicBins:
    """The open bins of one task. ``add`` gives back closed sequences as (id, pieces).

    A piece is (key, ids as bytes, start in its document, tokens of its document).
    """

    def __init__(self, capacity: int, classes: int, first_id: int):
        self.capacity, self.classes, self.next_id = capacity, classes, first_id
        self.open: dict[int, tuple[list, int]] = {}

    def _close(self, pieces: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def add(self, key, raw: bytes) -> Iterator[tuple[int, list]]:
        total, start = len(raw) // 4, 0

        def cut(length: int) -> tuple:
            nonlocal start
            start += length
            return key, raw[(start - length) * 4 : start * 4], start - length, total

        while total - start >= self.capacity:
            yield self._close([cut(self.capacity)])
        while rest := total - start:
            class_ = min(self.capacity // rest, self.classes)
            pieces, used = self.open.pop(class_, ([], 0))
            full = len(pieces) == class_ < self.classes
            taken = min(rest, self.capacity - used) if full or class_ == self.classes else rest
            pieces.append(cut(taken))
            used += taken
            if used == self.capacity:
                yield self._close(pieces)
            else:
                self.open[class_] = (pieces, used)

    def finish(self) -> Iterator[tuple[int, list]]:
        """Close what is open: whole sequences, then sequences whose sums are powers of two."""
        left = [p for _, (pieces, _) in sorted(self.open.items()) for p in pieces][::-1]
        total, self.open = sum(len(p[1]) // 4 for p in left), {}
        while total:
            room = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= room
            taken = []
            while room:
                key, raw, start, tokens = left.pop()
                n = len(raw) // 4
                if n > room:
                    left.append((key, raw[room * 4 :], start + room, tokens))
                    raw, n = raw[: room * 4], room
                taken.append((key, raw, start, tokens))
                room -= n
            yield self._close(taken)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    classes: int = 64,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``capacity`` tokens (a power of two).

    Returns a row per piece: ``id_col`` (as given), ``start`` (the document's ids before it), ``length``, ``ids_crc32``
    (of its ids as little-endian unsigned 32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0) and, with ``with_ids``, ``ids``.  Defined cases: a null or empty text is the end id alone;
    a null id stays null; repeated rows are packed as so many documents; very long texts become many whole sequences;
    an empty table gives no rows; other columns of ``docs`` are not read, so their names cannot clash.
    """
    if capacity < 1 or capacity & (capacity - 1) or not 1 < classes <= capacity:
        raise ValueError("capacity must be a power of two, and classes from 2 to it")
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    key_type = source.schema["k"].dataType
    fields = [
        T.StructField(id_col, key_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        bins = HarmonicBins(capacity, classes, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], dtype="<u4").tobytes()
        key_arrow = None

        def rows(sequences) -> pa.RecordBatch:
            key, start, length, crc, total, seq, offset, ids = [], [], [], [], [], [], [], []
            for sequence, pieces in sequences:
                at = 0
                for k, part, s, tokens in pieces:
                    n = len(part) // 4
                    for column, value in ((key, k), (start, s), (length, n), (crc, zlib.crc32(part)), (total, tokens), (seq, sequence), (offset, at)):
                        column.append(value)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
                    at += n
            columns = [pa.array(key, key_arrow), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, offset))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        def added(keys, texts):
            for lo in range(0, len(texts), 256):
                for key, raw in zip(keys[lo : lo + 256], tokenizer.encode_batch([t or "" for t in texts[lo : lo + 256]]), strict=True):
                    yield from bins.add(key, raw + end)

        for batch in batches:
            tokenizer = tokenizer or WordCachedTokenizer(tokenizer_path)
            key_arrow = batch.column(0).type
            closed = []
            for sequence in added(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                closed.append(sequence)
                if len(closed) >= 2000:
                    yield rows(closed)
                    closed = []
            yield rows(closed)
        if key_arrow is not None:
            yield rows(bins.finish())

    return source.mapInArrow(run, T.StructType(fields))


def padding(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: tokens, sequences, padding tokens (none for sequences whose sum is a power of two) and their share."""
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.bit_count(F.col("n")) == 1
    pad = F.when(exact, 0).otherwise(F.lit(capacity) - F.col("n"))
    out = sums.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(pad).alias("padding"))
    return out.withColumn("share", F.col("padding") / (F.col("tokens") + F.col("padding")))
