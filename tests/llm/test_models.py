"""Trained models against plain loops: convolution, LSTM and its gradients, cumulative link."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillworks.llm import common, html_extraction, quality_classifier, toxicity

TEXTS = ["one", "", None, "Ünder the (bridge), the river!", "a b a b a", " \t\n", "word " * 40 + "stop.", "mixed CASE Words with\nlines\nand lines", "x" * 300]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def sigma(x):
    return 1 / (1 + math.exp(-x))


def toxic_score(model, text):
    """Every filter at every word, one product at a time."""
    words = (text or "").lower().split()
    vectors = []
    for w in words:
        own = [model.embeddings[b].astype(float) for b in toxicity.word_buckets(w)]
        vectors.append(sum(own) / len(own))
    vectors = vectors or [np.zeros(toxicity.DIMS)]
    n, total, column, place = len(vectors), float(model.out_bias), 0, 0
    vectors += [np.zeros(toxicity.DIMS)] * max(toxicity.WIDTHS)
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = -math.inf
            for t in range(n):
                value = 0.0
                for k in range(width):
                    value += float(vectors[t + k] @ model.filters[:, column + k * toxicity.FILTERS + f])
                best = max(best, value)
            total += max(0.0, best + float(model.bias[place])) * float(model.out[place])
            place += 1
        column += width * toxicity.FILTERS
    return sigma(model.scale * total + model.shift)


def test_toxicity_is_a_convolution(spark):
    rng = np.random.default_rng(4)
    model = toxicity.new_model(5)
    model.embeddings = rng.normal(size=model.embeddings.shape).astype(np.float32)
    model.bias = rng.normal(size=model.bias.shape).astype(np.float32)
    model.out = rng.normal(size=model.out.shape).astype(np.float32)
    model.scale, model.shift, model.out_bias = 0.3, 0.1, 0.2
    got = {r.doc_id: r.score for r in toxicity.score_documents(rows(spark), model, lang_col=None).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == pytest.approx(toxic_score(model, text), abs=1e-5)


def plain_lstm(x, wx, wh, b):
    """Hidden states of one sequence, one unit at a time."""
    n = wh.shape[0]
    h, c, out = [0.0] * n, [0.0] * n, []
    for row in x:
        z = [float(b[j]) + sum(float(row[i]) * float(wx[i, j]) for i in range(len(row))) + sum(h[i] * float(wh[i, j]) for i in range(n)) for j in range(4 * n)]
        c = [sigma(z[n + j]) * c[j] + sigma(z[j]) * math.tanh(z[3 * n + j]) for j in range(n)]
        h = [sigma(z[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
        out.append(h)
    return np.array(out)


def test_labels_are_a_two_way_lstm():
    rng = np.random.default_rng(8)
    model = html_extraction.new_labeller(3)
    pages = [rng.normal(size=(n, html_extraction.INPUT)).astype(np.float32) for n in (1, 7, 3, 12, 2)] + [np.zeros((0, html_extraction.INPUT), dtype=np.float32)]
    got = html_extraction.probabilities(model, pages)
    assert len(got[-1]) == 0
    for page, own in zip(pages[:-1], got, strict=False):
        p = model.p
        ahead = plain_lstm(page, p["wx0"], p["wh0"], p["b0"])
        back = plain_lstm(page[::-1], p["wx1"], p["wh1"], p["b1"])[::-1]
        want = [sigma(float(np.concatenate([a, z]) @ p["out"] + p["out_b"][0])) for a, z in zip(ahead, back, strict=True)]
        assert np.allclose(own, want, atol=1e-4)


def test_lstm_gradients():
    rng = np.random.default_rng(9)
    n, width = html_extraction.HIDDEN, html_extraction.INPUT
    x = rng.normal(size=(6, 3, width))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 1], [1, 0, 0], [1, 0, 0]], dtype=float)
    w = {"wx": rng.normal(0, 0.2, (width, 4 * n)), "wh": rng.normal(0, 0.2, (n, 4 * n)), "b": rng.normal(0, 0.2, 4 * n), "x": x}
    pull = rng.normal(size=(6, 3, n))

    def loss():
        return float((html_extraction.lstm(w["x"], mask, w["wx"], w["wh"], w["b"]) * pull).sum())

    _, steps = html_extraction.lstm(x, mask, w["wx"], w["wh"], w["b"], keep=True)
    made = dict(zip(("wx", "wh", "b", "x"), html_extraction.lstm_back(pull, x, steps, w["wx"], w["wh"]), strict=True))
    for name, values in w.items():
        for _ in range(12):
            at = tuple(int(rng.integers(k)) for k in values.shape)
            held, step = values[at], 1e-2
            values[at] = held + step
            up = loss()
            values[at] = held - step
            down = loss()
            values[at] = held
            assert made[name][at] == pytest.approx((up - down) / (2 * step), abs=5e-3)


def test_quality_is_a_cumulative_link(spark):
    rng = np.random.default_rng(10)
    model = quality_classifier.OrdinalModel(rng.normal(size=quality_classifier.BUCKETS).astype(np.float32), np.array([-0.7, 0.4]), [0, 1, 2])
    got = {r.doc_id: r for r in quality_classifier.score_documents(rows(spark), model, least_grade=2, least_tail=0.4).collect()}
    for k, text in enumerate(TEXTS):
        words, eta = (text or "").split(), 0.0
        for w in words:
            for name in ("w " + w, "s " + quality_classifier.shape(w), "e " + w[-3:]):
                eta += float(model.weights[zlib.crc32(name.encode()) % quality_classifier.BUCKETS]) / len(words)
        for b in quality_classifier.document_buckets(text or "", words):
            eta += float(model.weights[b])
        above = [1.0, sigma(eta + 0.7), sigma(eta - 0.4), 0.0]
        chance = [above[g] - above[g + 1] for g in range(3)]
        assert got[k].expected_grade == pytest.approx(sum(g * c for g, c in enumerate(chance)), abs=1e-5)
        assert got[k].tail == pytest.approx(chance[2], abs=1e-5)
        assert got[k].selected == (got[k].tail >= 0.4)


def test_sample_bounded_by_characters(spark):
    sizes = [10, 3_000, 0, 90, 64, 100, 100, 7, 101, 55]
    rows = [(k, "x" * n) for k, n in enumerate(sizes)] + [(5, "x" * 100), (10, None), (11, "y" * 99), (11, "z" * 98)]
    df = spark.createDataFrame(rows, "id long, text string").select("id", "text", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("text_key"))
    ordered = sorted((r.key, r.text_key, len(r.text or ""), r.id) for r in df.collect())
    for size, chars in ((20, 6_400), (20, 640 * 10), (20, 400_000), (4, 400_000), (20, 64), (20, 1)):
        want, total = [], 0
        for key, text_key, n, i in (r for r in ordered if r[2] <= chars // 64):
            total += n
            if total > chars or len(want) == size:
                break
            want.append((key, text_key, n, i))
        got, n = common.within_chars(df, ["key", "text_key"], size, chars)
        got = got.orderBy("key", "text_key").limit(n).collect()
        assert sorted((r.key, r.text_key, len(r.text or ""), r.id) for r in got) == want and len(got) == n
    # cut by the sum: each text fits alone
    many = spark.range(200).select(F.xxhash64("id").alias("key"), F.repeat(F.lit("x"), 10).alias("text"))
    rows, n = common.within_chars(many, ["key"], 1_000, 640)
    assert n == 64 and rows.count() == 64
    assert common.within_chars(many.limit(0), ["key"], 10, 640)[1] == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """Toxic stems stand in a few rows each, and some texts are far longer than others: parts hold them all."""
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(7))
    stems = [word("uvwxyz") for _ in range(12)]
    plain = lambda n: [word("abcdefgh") for _ in range(n)]
    made = [(k, " ".join(plain(25) + ([stems[k // 3 % 12]] if k % 3 == 0 else [])), "en") for k in range(1_500)]
    made += [(2_000 + k, " ".join(plain(4_000) + ["longonly"] * (k % 2)), "en") for k in range(40)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1_500) if k % 5] + [(2_000 + k, k % 2) for k in range(30)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels)
    seen = [p for (p,) in toxicity.of_parts(toxicity.parts(rows, 5), lambda _, part: (len(part.docs),))]
    assert sum(seen) == labels.count() and len(seen) == 5
    model = toxicity.fit(docs, labels, part_size=300, part_chars=200_000)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    right = [(got[k] >= 0.5) == (k % 3 == 0) for k in range(0, 1_500, 5)]
    assert sum(right) >= 0.95 * len(right)
