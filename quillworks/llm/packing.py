"""Packing documents into token windows by the sum-of-squares rule.

N(h) counts the open windows of fill level h, 0 < h < capacity. Each document goes, in order of arrival, to the level
that leaves the sum of N(h)^2 least (ties: the fullest window); a numpy array over the levels holds N. A document
longer than a window first fills whole windows of its own, and its rest is placed. Every task packs its own documents:
nothing is shuffled. When a task's documents end, the windows still open stay as they are, and their gaps are filled,
fullest window first, with cut pieces of the least filled windows; the last one is cut at powers of two, which need no
padding. So a task leaves no padding, wherever its rows came from, and `route` says how a piece came to its place:
whole (a full window of one document), level (by the sum-of-squares choice), gap (moved at the end).

Defined results: a null text is empty, and its document is the end id alone; repeated rows are packed each for itself;
ids may be null or repeated; extra columns are ignored; an empty table gives no piece.
Given the same input partitions, a task run again (a lost executor) yields the same pieces and sequence ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common
from quillworks.llm.common import give_back, worker_cache
from quillworks.llm.tokens import CLOSING, LONGEST, ModelIds, tokenizer_path

common.ship(__name__)

#: Marks at the end of a word that part from its letters as a token of their own kind.
TAIL = CLOSING + "#%*&$"
#: Characters of text whose words are looked up together.
SLICE = 1_000_000
PIECES = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, route string"


class WordIds(dict):
    """word -> its token ids as little-endian bytes, by a tokenizer that drops white space. Misses are encoded by their stems.

    Two generations of at most `most` words each: words that were not met since the last change of generation go.
    Words of over LONGEST characters are encoded whenever they are met and not kept.
    """

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        self.most, self.model, self.old, self.tails = most, ModelIds(path, lower=True), {}, {"": b""}

    def encoded(self, piece: str) -> bytes:
        return as_bytes(self.model.encode(piece))

    def letters(self, stem: str) -> bytes:
        """Ids of lower-case letters up to U+00FF, which form one pre-token, straight by the merges."""
        if not stem.isascii():
            stem = "".join(map(self.model.letters.__getitem__, stem.encode()))
        return as_bytes([t.id for t in self.model.model.tokenize(stem)])

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self.encoded(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(TAIL)
            if stem.isalpha() and max(stem) <= "\xff":
                tail, stem = word[len(stem) :], stem.lower()
                if tail not in self.tails:
                    if len(self.tails) > 1_000:
                        self.tails = {"": b""}
                    self.tails[tail] = self.encoded(tail)
                ids = self.get(stem) or self.letters(stem)
                if tail:
                    self[stem] = ids
                    ids += self.tails[tail]
            else:
                ids = self.encoded(word) if word else b""
        self[word] = ids
        return ids

    def ids(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """The ids of each whole text and the end id. White space always parts tokens, so words are encoded one by one."""
        at = 0
        while at < len(texts):
            last, chars = at, 0
            while last < len(texts) and (last == at or chars + len(texts[last]) <= SLICE):
                chars, last = chars + len(texts[last]), last + 1
            split = pc.ascii_split_whitespace(pa.array(texts[at:last], pa.large_string()))
            found, offsets = split.values.dictionary_encode(), np.asarray(split.offsets)
            known = [self[w] for w in found.dictionary.to_pylist()]
            size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
            word = np.asarray(found.indices)
            n, body = size[word], np.frombuffer(b"".join(known), dtype="<u4")
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = body[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[offsets]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield np.append(flat[a:b], np.array([end], dtype="<u4"))
            at = last


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Levels:
    """Open windows by fill level, and the sum-of-squares choice between them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The fill level to place `size` ids in; 0 opens a window. Full windows do not count in the sum."""
        n, cap = self.counts, self.capacity
        lower, upper = n[: cap - size + 1], n[size : cap + 1]
        change = 2 * (upper - lower) + 2  # N(h) falls by one, N(h + size) grows by one
        change[-1] = 1 - 2 * lower[-1]  # the window becomes full and leaves the sum
        change[0] = 2 * upper[0] + 1 if size < cap else 0
        change[1:][lower[1:] == 0] = np.iinfo(np.int64).max
        least = len(change) - 1 - int(np.argmin(change[::-1]))
        return least

    def place(self, piece: list, size: int) -> list | None:
        """Put a piece in a window; the window is returned once it is full."""
        at = self.choose(size)
        window = self.windows[at].pop() if at else []
        window.append(piece)
        if at:
            self.counts[at] -= 1
        if at + size == self.capacity:
            return window
        self.counts[at + size] += 1
        self.windows[at + size].append(window)
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for level in reversed(self.windows) for w in level]


def power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def cut(piece: list, size: int) -> tuple[list, list]:
    """The first `size` ids of a piece, moved, and what is left of it."""
    doc, start, ids, n, route = piece
    return [doc, start, ids[:size], n, "gap"], [doc, start + size, ids[size:], n, route]


def fill_gaps(windows: list[list], capacity: int) -> Iterator[list]:
    """Full windows, and some of a power of two, from the windows still open (fullest first)."""
    sized = [(w, sum(len(p[2]) for p in w)) for w in windows]
    yield from (w for w, size in sized if power_of_two(size))
    sized = [x for x in sized if not power_of_two(x[1])]
    at, last = 0, len(sized) - 1
    while at < last:
        window, size = sized[at]
        donor, left = sized[last]
        while size < capacity and left:
            piece = donor.pop()
            take = min(capacity - size, len(piece[2]))
            moved, kept = cut(piece, take)
            window.append(moved)
            if len(kept[2]):
                donor.append(kept)
            size, left = size + take, left - take
        sized[at], sized[last] = (window, size), (donor, left)
        at, last = at + (size == capacity), last - (not left)
        if size == capacity:
            yield window
    if at == last:
        window, size = sized[at]
        for part in (1 << b for b in range(capacity.bit_length(), -1, -1) if size >> b & 1):
            made = []
            while part:
                piece = window.pop(0)
                take = min(part, len(piece[2]))
                first, kept = cut(piece, take)
                made.append(first)
                if len(kept[2]):
                    window.insert(0, kept)
                part -= take
            yield made


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack tokenized documents into sequences of at most `capacity` ids.

    A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, route, and the
    ids themselves with with_ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = worker_cache(("word ids", path), lambda: WordIds(path))
        levels, serial, out = Levels(capacity), TaskContext.get().partitionId() << 40, []

        def close(window: list) -> None:
            nonlocal serial
            offset, length = 0, sum(len(p[2]) for p in window)
            for doc, start, ids, n, route in window:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), n, serial, offset, length, route)
                out.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            serial += 1

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            out.clear()
            return made

        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for doc, ids in zip(batch["id"], words.ids(texts, end_id), strict=True):
                n = len(ids)
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    close([[doc, start, ids[start : start + capacity], n, "whole"]])
                if whole < n and (full := levels.place([doc, whole, ids[whole:].copy(), n, "level"], n - whole)):
                    close(full)
                if len(out) >= 5_000:
                    yield frame()
            del batch, texts
            give_back()
        for window in fill_gaps(levels.rest(), capacity):
            close(window)
        yield frame()
        del levels
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInPandas(pack, schema)
    return packed.select(F.col("id").cast(kind).alias(id_col), *[c for c in packed.columns if c != "id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
