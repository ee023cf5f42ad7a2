"""Language-model scores by a weighted backoff automaton of any order.

The model is learnt from the whole training part of the corpus. States are histories of up to order - 1 tokens that
occur in it (also the start of a text; the empty history is state 0). An arc (state, word) carries log10 of the smoothed
probability and leads to the longest history that is a state; a state without the arc takes its failure arc, whose weight
is the state's backoff, to the history without its first token. The empty history has an arc for every word:

    p(w)     = (c(w) - d) / N for known words, d / N for a word never seen in training (as if as many words were unseen
               as are known)
    p(w | h) = (1 - b(h)) * c(h w) / c(h) + b(h) * p(w | h without its first token),  b(h) = 1 - top * c(h) / (c(h) + half)

A state's probabilities sum to 1; with `least_count` above 1, n-grams seen less often get no arc, and it is less.
One left-to-right walk over a text carries the state and adds up the weights. A block walks its texts side by side, in
lanes of STRIDE tokens; a lane inside a text starts order - 1 tokens early, which is all that a state can remember.

The corpus' n-grams are too many to broadcast. Documents are gathered in blocks of some MB (packed and compressed). Each
block asks for its distinct n-grams, with its own training counts, at the n-gram's part, where the counts of all blocks
are summed, and gets back the totals in the order of its question: the part of the automaton that its documents can
touch. Single tokens, whose counts are exact, are sent by all 64 bits of their hash; keys of longer n-grams have so many
bits that under one in a million shares its key (from the characters of the corpus). They go as sorted, compressed arrays: a row for each block and part that has any. A frequent n-gram is one entry
per block, so no key grows with its frequency; parts and their tasks follow the corpus.

Defined results: a null text is empty and has its end token alone; without training documents every count is 0, base
and model scores are those of unknown words; rows that share an id are scored each for itself; a null id counts as
empty text for the held-out rule; extra columns are ignored; an empty table gives an empty result. Documents are read
twice: should the second reading give other blocks (an input that is not deterministic), the job fails.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common

common.ship(__name__)

ORDER = 3
BLOCK_CHARS = 2_000_000
#: Characters of text to a part of the n-grams, and blocks to a task: both follow the corpus.
PART_CHARS, TASK_BLOCKS = 3_000_000, 4
DISCOUNT, TOP, HALF, LEAST_COUNT = 0.5, 0.5, 5.0, 1
STRIDE = 64
#: Bits of a single token's key: all of its hash.
TOKEN_BITS = 64
END, START = 0, 1
#: Ids of the end and start marks beside word hashes; no word hash is changed for them.
END_HASH, START_HASH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SCORES = "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ second
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) ^ second


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words: of each byte, by its place, summed and mixed."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    edges = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    lengths, starts = np.diff(edges), edges[:-1] - edges[0]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(np.append(mixed(place.astype(np.uint64), raw.astype(np.uint64) + np.uint64(1)), np.uint64(0)), starts)
    return mixed(sums, lengths.astype(np.uint64))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words by number; the texts as numbers, each between a start and an end; where each starts, and all end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    offsets, flat = np.asarray(split.offsets), split.values
    found = flat.dictionary_encode()
    full = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate([[0], np.cumsum(full)])
    starts = np.concatenate([[0], np.cumsum(np.diff(before[offsets]) + 2)])
    ids = np.full(int(starts[-1]), END, dtype=np.int32)
    ids[starts[:-1]] = START
    inner = np.ones(len(ids), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    ids[inner] = np.asarray(found.indices)[full] + 2
    return np.concatenate([np.array([END_HASH, START_HASH], dtype=np.uint64), word_hashes(found.dictionary)]), ids, starts


def pack_blocks(batches: Iterator[pd.DataFrame], most_chars: int) -> Iterator[pd.DataFrame]:
    """Documents of a partition as compressed blocks of at most most_chars characters (one document at least)."""
    own, size, serial = [], 0, TaskContext.get().partitionId() << 32
    squeeze = zstandard.ZstdCompressor(level=1)

    def block() -> pd.DataFrame:
        return pd.DataFrame({"block": [serial], "body": [squeeze.compress(pickle.dumps(own))]})

    for batch in batches:
        for doc, held, text in zip(batch["doc"], batch["held"], batch["text"], strict=True):
            text = text or ""
            if own and size + len(text) > most_chars:
                yield block()
                own, size, serial = [], 0, serial + 1
            own.append((doc, bool(held), text))
            size += len(text)
    if own:
        yield block()


def unpack(body: bytes) -> tuple[list, list, list]:
    """Ids, held-out flags and texts of a block."""
    docs, held, texts = zip(*pickle.loads(zstandard.ZstdDecompressor().decompress(body)), strict=True)
    return list(docs), list(held), list(texts)


class Level:
    """The distinct n-grams of one length in a block: keys, training counts, and the shorter n-grams that they are made of.

    `of`: the n-gram that ends at each place of the block's tokens, or -1.
    """

    def __init__(self, keys: np.ndarray, own: np.ndarray, of: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, word: np.ndarray):
        self.keys, self.own, self.of, self.prefix, self.suffix, self.word = keys, own, of, prefix, suffix, word


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and the number of the distinct value at every place."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.concatenate([np.ones(min(1, len(values)), dtype=bool), ranked[1:] != ranked[:-1]])
    number = np.empty(len(values), dtype=np.int32)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


class Grams:
    """The n-grams of one block of documents up to length `order`, and how often its training documents hold each."""

    def __init__(self, held: list[bool], texts: list[str], order: int):
        hashes, self.ids, self.starts = tokens(texts)
        train = np.repeat(~np.array(held, dtype=bool), np.diff(self.starts))
        ids, none = self.ids, np.zeros(0, dtype=np.int32)
        own = np.bincount(ids[train], minlength=len(hashes))
        self.levels = [Level(hashes, own, ids, none, none, np.arange(len(hashes), dtype=np.int32))]
        inside = ids != START
        for _ in range(1, order):
            last = self.levels[-1]
            where = np.flatnonzero((last.of[:-1] >= 0) & inside[1:]) + 1
            pair, first, number = numbered(last.of[where - 1].astype(np.int64) << 32 | ids[where])
            prefix, word = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
            of = np.full(len(ids), -1, dtype=np.int32)
            of[where] = number
            own = np.bincount(number[train[where]], minlength=len(pair))
            self.levels.append(Level(mixed(last.keys[prefix], hashes[word]), own, of, prefix, last.of[where[first]], word))

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and own counts: of the single tokens (those that occur), and of all longer n-grams."""
        self.seen = np.flatnonzero(np.bincount(self.ids, minlength=len(self.levels[0].keys)))
        single = self.levels[0]
        longer = [(level.keys, level.own) for level in self.levels[1:]]
        keys, own = ([np.concatenate(x) for x in zip(*longer, strict=True)] if longer else [single.keys[:0], single.own[:0]])
        return [(single.keys[self.seen], single.own[self.seen]), (keys, own)]

    def totals(self, single: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
        """Counts by level, from those of asked()."""
        first = np.zeros(len(self.levels[0].keys), dtype=np.int64)
        first[self.seen] = single
        return [first, *np.split(longer, np.cumsum([len(level.keys) for level in self.levels[1:-1]]))][: len(self.levels)]


def squeezed(tool: zstandard.ZstdCompressor, *arrays: np.ndarray) -> bytes:
    """Whole numbers of arrays of one length, compressed byte by byte, lowest bytes first and together."""
    body = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        body += [bytes([width]), a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return tool.compress(b"".join(body))


def unsqueezed(tool: zstandard.ZstdDecompressor, body: bytes) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(tool.decompress(body), dtype=np.uint8), [], 8
    n = int(raw[:8].view("<u8")[0])
    while at < len(raw):
        width = int(raw[at])
        whole = np.zeros((n, 8), dtype=np.uint8)
        whole[:, :width] = raw[at + 1 : at + 1 + width * n].reshape(width, n).T
        out.append(whole.view("<u8").ravel())
        at += 1 + width * n
    return out


class Deal:
    """Keys in ascending order, dealt to parts of equal width; a key goes out as what it is above its part's least."""

    def __init__(self, keys: np.ndarray, parts: int, bits: int):
        keys = keys & np.uint64((1 << bits) - 1)
        least = np.array([p * part_width(parts, bits) for p in range(parts)], dtype=np.uint64)
        self.order = np.argsort(keys)
        keys = keys[self.order]
        self.edges = np.append(np.searchsorted(keys, least), len(keys))
        self.rest = keys - np.repeat(least, np.diff(self.edges))

    def keys(self, part: int) -> np.ndarray:
        return self.rest[self.edges[part] : self.edges[part + 1]]

    def size(self, part: int) -> int:
        return int(self.edges[part + 1] - self.edges[part])

    def question(self, tool: zstandard.ZstdCompressor, own: np.ndarray, part: int) -> bytes:
        a, b = self.edges[part], self.edges[part + 1]
        return squeezed(tool, np.diff(self.rest[a:b], prepend=np.uint64(0)), own[self.order[a:b]])

    def restored(self, answers: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = answers
        return out


def part_width(parts: int, bits: int) -> int:
    return -(-(1 << bits) // parts)


def mark_of(*keys: np.ndarray) -> int:
    """A sum over keys, to see that a question and its answer belong together."""
    with np.errstate(over="ignore"):
        return int(sum((np.bitwise_xor.reduce(k) ^ np.uint64(len(k)) for k in keys), np.uint64(0)).astype(np.int64))


def ask(order: int, parts: int, bits: int):
    """Distinct n-grams of each block with their counts in training documents: a row for each block and part.

    Single tokens and longer n-grams apart. An n-gram of held-out documents alone has count 0: its total is asked for.
    """

    def questions(tool: zstandard.ZstdCompressor, block: int, body: bytes) -> pd.DataFrame:
        _, held, texts = unpack(body)
        (k1, own1), (k2, own2) = Grams(held, texts, order).asked()
        del texts
        single, longer = Deal(k1, parts, TOKEN_BITS), Deal(k2, parts, bits)
        some = [p for p in range(parts) if single.size(p) or longer.size(p)]
        return pd.DataFrame({
            "part": some,
            "block": block,
            "mark": [mark_of(single.keys(p), longer.keys(p)) for p in some],
            "single": [single.question(tool, own1, p) for p in some],
            "longer": [longer.question(tool, own2, p) for p in some],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, body in zip(batch["block"], batch["body"], strict=True):
                yield questions(tool, block, body)

    return run


def summed(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several blocks' n-grams: distinct keys, their totals, the totals by question, and where each question ends."""
    tool = zstandard.ZstdDecompressor()
    opened = [unsqueezed(tool, b) for b in bodies]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in opened])
    own = np.concatenate([v for _, v in opened])
    ends = np.cumsum([len(k) for k, _ in opened])
    del opened
    distinct, _, back = numbered(keys)
    totals = np.bincount(back, weights=own, minlength=len(distinct)).astype(np.int64)
    return distinct, totals, totals[back], ends


def add_up(parts: int):
    """Totals of a part's n-grams for the blocks that asked. The first row has the part's tokens, types and texts too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part, made, n = int(rows["part"].iloc[0]), {}, len(rows)
        tool = zstandard.ZstdCompressor(level=1)
        keys, totals, answer, ends = summed(rows["single"].tolist())
        home, rest = divmod(START_HASH & ((1 << TOKEN_BITS) - 1), part_width(parts, TOKEN_BITS))
        start = (keys == np.uint64(rest)) & (home == part)
        made["single"] = [squeezed(tool, a) for a in np.split(answer, ends[:-1])]
        _, _, answer, ends = summed(rows["longer"].tolist())
        made["longer"] = [squeezed(tool, a) for a in np.split(answer, ends[:-1])]
        once = lambda x: [int(x)] + [0] * (n - 1)
        return pd.DataFrame({
            "to_block": rows["block"].to_numpy(), "part": part, "mark": rows["mark"].to_numpy(), **made,
            "tokens": once(totals[~start].sum()), "types": once((totals[~start] > 0).sum()), "texts": once(totals[start].sum()),
        })

    return run


def answered(grams: Grams, rows: pd.DataFrame, parts: int, bits: int) -> list[np.ndarray]:
    """Totals by level for one block, from the answers of all parts."""
    deals = [Deal(keys, parts, width) for (keys, _), width in zip(grams.asked(), (TOKEN_BITS, bits), strict=True)]
    rows = rows.sort_values("part")
    want = [p for p in range(parts) if deals[0].size(p) or deals[1].size(p)]
    if rows["part"].tolist() != want or rows["mark"].tolist() != [mark_of(deals[0].keys(p), deals[1].keys(p)) for p in want]:
        raise RuntimeError("the documents gave other blocks when read again; write them to a table first")
    got, tool = [], zstandard.ZstdDecompressor()
    for deal, name in zip(deals, ("single", "longer"), strict=True):
        opened = [unsqueezed(tool, b)[0] for b in rows[name]]
        got.append(deal.restored(np.concatenate(opened).astype(np.int64)))
    return grams.totals(*got)


class Automaton:
    """The part of the automaton that one block of documents can touch.

    States: 0 is the empty history, then the tokens, the pairs, ... in the block's own numbers. Arcs are sorted by state
    and word. failure_to and failure_weight hold each state's failure arc.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n_train: int, least_count: int = LEAST_COUNT):
        levels, order = grams.levels, len(grams.levels)
        first_state = np.cumsum([1, *[len(level.keys) for level in levels[:-1]]])
        self.order, self.counts = order, totals[0]
        least = [1, *[least_count] * (order - 1)]
        p = np.where(totals[0] > 0, totals[0] - DISCOUNT, DISCOUNT) / max(1, n_train)
        self.root_weight = np.log10(p)
        states = int(first_state[-1]) if order > 1 else 1
        self.failure_to, self.failure_weight = np.zeros(states, dtype=np.int64), np.zeros(states)
        exists = np.zeros(states, dtype=bool)
        exists[0] = True
        self.root_to = np.zeros(len(p), dtype=np.int64)
        codes, weights, to = [], [], []
        for k, level in enumerate(levels):  # n-grams of k + 1 tokens: as arcs, then as states
            n = totals[k]
            state = first_state[k] + np.arange(len(n)) if k + 1 < order else None
            shorter = first_state[k - 1] + level.suffix if k else np.zeros(len(n), dtype=np.int64)
            if k:
                back = 10 ** self.failure_weight[first_state[k - 1] + level.prefix]
                p = (1 - back) * n / np.maximum(1, totals[k - 1][level.prefix]) + back * p[level.suffix]
                arc = np.flatnonzero(n >= least[k])
                codes.append((first_state[k - 1] + level.prefix[arc]).astype(np.int64) << 32 | level.word[arc])
                weights.append(np.log10(p[arc]))
                to.append(state[arc] if state is not None else shorter[arc])
            if state is not None:
                known = n >= least[k]
                exists[state] = known
                self.failure_to[state] = shorter
                self.failure_weight[state] = np.where(known, np.log10(1 - TOP * n / (n + HALF)), 0.0)
                if k == 0:
                    self.root_to = np.where(known, state, 0)
        self.codes, self.weights, self.to = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (codes, weights, to))
        self.start = int(first_state[0] + START) if order > 1 and exists[1 + START] else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and the weights of the arcs taken: failure arcs until one for the word is there."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        at, left = state.copy(), np.arange(len(state))
        while len(left):
            here, w = at[left], word[left]
            root = here == 0
            weight[left[root]] += self.root_weight[w[root]]
            to[left[root]] = self.root_to[w[root]]
            left, here, w = left[~root], here[~root], w[~root]
            code = here << 32 | w
            arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[arc] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
            weight[left[found]] += self.weights[arc[found]]
            to[left[found]] = self.to[arc[found]]
            left, here = left[~found], here[~found]
            weight[left] += self.failure_weight[here]
            at[left] = self.failure_to[here]
        return to, weight

    def walk(self, ids: np.ndarray, starts: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """log10 probability of each text, left to right."""
        stride = max(stride, self.order)
        size = np.diff(starts) - 1
        lanes = -(-size // stride)
        text = np.repeat(np.arange(len(size)), lanes)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(piece > 0, self.order - 1, 0)
        begin = starts[text] + 1 + piece * stride - warm
        length = np.minimum(stride, size[text] - piece * stride) + warm
        state = np.where(piece > 0, 0, self.start)
        by_length = np.argsort(-length, kind="stable")
        text, begin, length, warm, state = (x[by_length] for x in (text, begin, length, warm, state))
        total = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t
            state[:n], weight = self.step(state[:n], ids[begin[:n] + t].astype(np.int64))
            total[:n] += np.where(t >= warm[:n], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(size))


def score_block(body: bytes, rows: pd.DataFrame, order: int, parts: int, bits: int, n_train: int, n_types: int, least_count: int) -> pd.DataFrame:
    """Scores of one block's documents."""
    docs, held, texts = unpack(body)
    grams = Grams(held, texts, order)
    del texts
    automaton = Automaton(grams, answered(grams, rows, parts, bits), n_train, least_count)
    token, first = grams.ids != START, grams.starts[:-1]
    counts = automaton.counts[grams.ids]
    base = np.where(token, np.log10((counts + 1) / (n_train + n_types + 1)), 0.0)
    return pd.DataFrame({
        "doc": pd.Series(docs, dtype=object),
        "held_out": held,
        "n_tokens": np.diff(grams.starts) - 1,
        "n_known": np.add.reduceat(((counts > 0) & token).astype(np.int64), first),
        "train_tokens": n_train,
        "base_score": np.add.reduceat(base, first),
        "score": automaton.walk(grams.ids, grams.starts),
    })


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_chars: int = BLOCK_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` is a boolean column of docs; the model of `order` learns from the other documents, all of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), held_out.alias("held"), F.col(text_col).alias("text"))
    blocks = rows.mapInPandas(lambda batches: pack_blocks(batches, block_chars), "block long, body binary")
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, chars // PART_CHARS)
    bits = min(64, chars.bit_length() + 18)
    grams = blocks.mapInPandas(ask(order, parts, bits), "part int, block long, mark long, single binary, longer binary")
    answers = grams.repartition(parts, "part").groupBy("part").applyInPandas(
        add_up(parts), "to_block long, part int, mark long, single binary, longer binary, tokens long, types long, texts long"
    )
    answers = common.materialize(answers, "answers")
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n_train, n_types = sums.tokens or 0, sums.types or 0

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = [score_block(body, right, order, parts, bits, n_train, n_types, least_count) for body in left["body"]]
        return pd.concat(made) if made else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    tasks = max(shuffle, chars // (block_chars * TASK_BLOCKS))
    own = blocks.repartition(tasks, "block").groupBy("block")
    asked = answers.select(F.col("to_block").alias("block"), "part", "mark", "single", "longer").repartition(tasks, "block").groupBy("block")
    out = own.cogroup(asked).applyInPandas(score, SCORES)
    return out.select(F.col("doc").cast(kind).alias(id_col), *[c.split()[0] for c in SCORES.split(", ")[1:]])


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_documents(docs, common.crc_remainder(F.col("doc_id"), 7) == 2)
