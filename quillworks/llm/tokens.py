"""Token counts by a two-tier map-side lookup.

First tier: a compact table (chunk -> number of tokens) of the most frequent text chunks, broadcast to every worker.
Second tier: each worker's own cache; a chunk missing from both is encoded by the tokenizer once and remembered.
A chunk is what lies before a space that a visible character follows; the tokenizer never joins across such a place,
so the counts of the chunks add up to the count of the text. No pre-token is ever shuffled: every task summarises its
own chunks in a bounded table, and only those summaries are merged. Chunks of over LONGEST characters (texts without
spaces) are encoded whenever they are met and never kept, so tables and caches are bounded in bytes too.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; the id may be null or
repeated; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common
from quillworks.llm.common import worker_cache

common.ship(__name__)

#: A space inside a run of white space: here cutting at spaces could cut the run.
_INNER_SPACE = re.compile(r"\s (?!\S)")
_CUT = re.compile(r"(?= \S)")
#: Characters of the longest piece of text that a cache, a summary or the broadcast table keeps.
LONGEST = 64
#: Closing marks of a word. They hold no apostrophe: contractions are left to the tokenizer.
CLOSING = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable bytes as themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class ModelIds:
    """Ids of one short piece of text: its letters straight by the vocabulary's merges, anything else by the whole tokenizer."""

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.lower, self.letters = Tokenizer.from_file(path), lower, byte_letters()
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.tails = self.tokenizer.model, {"": []}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, piece: str) -> list[int]:
        """Same as encode(). Letters up to U+00FF form one pre-token and have one lower case; marks after them another."""
        stem = piece.rstrip(CLOSING)
        core = stem[1:] if stem[:1] == " " else stem
        if not core.isalpha() or max(core) > "\xff":
            return self.encode(piece)
        tail = piece[len(stem) :]
        if len(tail) > LONGEST:
            return self.encode(piece)
        if tail not in self.tails:
            if len(self.tails) > 1_000:
                self.tails = {"": []}
            self.tails[tail] = self.encode(tail)
        stem = stem.lower() if self.lower else stem
        if not stem.isascii() or stem[0] == " ":
            stem = "".join(map(self.letters.__getitem__, stem.encode()))
        return [t.id for t in self.model.tokenize(stem)] + self.tails[tail]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """Cut a text before every space that a visible character follows."""
    if _INNER_SPACE.search(text):
        return [c for c in _CUT.split(text) if c]
    first, *rest = text.split(" ")
    out = [" " + c for c in rest]
    if first:
        out.append(first)
    return out


class LengthCache(dict):
    """chunk -> token count; a miss is encoded and, up to LONGEST characters, kept. Emptied when `most` chunks are held."""

    def __init__(self, tier: dict[str, int], path: str, most: int = 400_000):
        super().__init__(tier)
        self.tier, self.most, self.model = tier, len(tier) + most, ModelIds(path, lower=False)
        self.special = [t.content for t in self.model.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > LONGEST:
            return len(self.model.ids(chunk))
        if len(self) > self.most:
            self.clear()
            self.update(self.tier)
        n = self[chunk] = len(self.model.ids(chunk))
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text. One that holds a special string goes to the tokenizer uncut: its rule decides."""
        if any(s in text for s in self.special):
            return len(self.model.encode(text))
        return sum(map(self.__getitem__, chunks(text)))


def frequent_chunks(docs: DataFrame, text_col: str = "text", size: int = 20_000, per_task: int = 5_000, held: int = 100_000) -> dict[str, int]:
    """The chunks met most often over all documents, with their counts: at most `size`, from bounded task summaries.

    Chunks of over LONGEST characters do not enter: they are hardly frequent, and one may be a whole text.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(c for c in chunks(text) if len(c) <= LONGEST)
                if len(seen) > held:
                    seen = Counter(dict(seen.most_common(held // 2)))
        if top := seen.most_common(per_task):
            yield pd.DataFrame({"chunk": [c for c, _ in top], "n": [n for _, n in top]})

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(summarise, "chunk string, n long")
    top = found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)
    return {r.chunk: r.n for r in top.collect()}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, tier_size: int = 20_000) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    top = frequent_chunks(docs, text_col, tier_size)
    encoder = LengthCache({}, path)
    label = uuid.uuid4().hex
    tier = spark.sparkContext.broadcast({c: encoder[c] for c in top})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache(("token lengths", path, label), lambda: LengthCache(tier.value, path))
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts], "n_tokens": [cache.count(t) for t in texts]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(count, "id string, n_bytes long, n_tokens long")
    return counted.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
