"""Texts of megabytes: whole results, against plain loops and the tokenizers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quillworks.llm import common, language_model, mixing, packing, quality_classifier, quality_rules, simhash, tokens, toxicity
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghikmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(5_000)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(11_000)]
    lines += lines[:40]
    return ["\n".join(lines), "x" * 200_000, "short text of six words only", " ".join(rng.choice(words) for _ in range(150_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return common.materialize(spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string"), "long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


def test_rules(texts, docs, labels):
    assert len(texts[0]) > 2_000_000
    for r in quality_rules.score_documents(docs, labels).collect():
        words = texts[r.doc_id].split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        again = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if again[w] > 1 for j in range(8)}
        lines = texts[r.doc_id].split("\n")
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))


def test_tokens_and_pieces(texts, docs):
    for name, count in (("byte_bpe_50k.json", lambda path: {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}), ("word_bpe_49k.json", None)):
        path = tokens.tokenizer_path(name)
        sizes = {k: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
        if count:
            assert count(path) == sizes
            continue
        pieces = packing.pack_documents(docs, path).collect()
        for k, n in sizes.items():
            own = sorted((p.start, p.length) for p in pieces if p.doc_id == k)
            assert [s for s, _ in own] == [sum(m for _, m in own[:j]) for j in range(len(own))] and sum(m for _, m in own) == n + 1


def test_fingerprints(texts, docs):
    for r in simhash.link_documents(docs).collect():
        words = texts[r.doc_id].split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fingerprint == f"{want:016x}"


def test_language_model_and_mix(texts, docs):
    got = {r.doc_id: r for r in language_model.score_documents(docs, F.col("doc_id") == 3).collect()}
    sizes = {r.doc_id: r.size for r in mixing.mix_documents(docs).collect()}
    for k, t in enumerate(texts):
        n = len(t.split())
        assert got[k].n_tokens == n + 1 and math.isfinite(got[k].score) and got[k].score < 0
        assert sizes[k] == n


def test_classifiers(docs, labels):
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    assert scored.where("score between 0 and 1").count() == 4
    graded = quality_classifier.score_documents(docs, quality_classifier.fit(docs, quality_classifier.graded(labels)))
    assert graded.where("tail between 0 and 1").count() == 4


def test_caches_keep_no_long_pieces():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    long = ["".join(rng.choice(letters) for _ in range(100_000)), "文" * 100_000, "word" + "." * 100_000, "a" * 65]
    texts = [f"{t} short words, twice over: {t}" for t in long] + ["b" * 64]

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    lengths, tokenizer = tokens.LengthCache({}, path), Tokenizer.from_file(path)
    assert [lengths.count(t) for t in texts] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    path = tokens.tokenizer_path("word_bpe_49k.json")
    ids, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    got = [a.tolist() for a in ids.ids(texts, 1)]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    weights = quality_classifier.WordWeights(np.arange(quality_classifier.BUCKETS, dtype=np.float32))
    want = [sum(weights.weights[b] for b in quality_classifier.document_buckets(t, t.split())) + np.mean([sum(map(int, quality_classifier.word_buckets(w))) for w in t.split()]) for t in texts]
    assert [weights.eta(t) for t in texts] == pytest.approx(want)
    for cache in (lengths, ids, ids.old, weights, lengths.model.tails, ids.tails, ids.model.tails):
        assert max(map(len, cache), default=0) <= 64
    assert "b" * 64 in lengths and "b" * 64 in ids and "b" * 64 in weights

    rows = toxicity.WordRows(np.zeros((toxicity.BUCKETS, 2), dtype=np.float32), most_chars=150_000)
    for t in texts:
        rows.trim()
        assert rows.chars == sum(map(len, rows)) <= 150_000
        for w in t.split():
            assert rows[w] > 0
        rows.fill()


def test_frequent_chunks_hold_no_whole_text(spark):
    rows = [("x" * 100_000,), ("x" * 100_000,), ("x" * 100_000,), ("a b a b",)]
    assert tokens.frequent_chunks(spark.createDataFrame(rows, "text string")) == {" a": 1, " b": 2, "a": 1}
