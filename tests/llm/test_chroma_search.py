"""Chroma search by loops: matches, best recording and ties over many blocks and buckets; filters by plain sums."""

import math
from functools import reduce

import numpy as np
from pyspark.sql import functions as F
from quillworks.llm import audio, common


def plain_alignment(x, y):
    """(offset, error) at the offset with most equal integers (the smallest of equals), or None."""
    votes = {}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            if a == b:
                votes[j - i] = votes.get(j - i, 0) + 1
    if not votes or max(votes.values()) < audio.MIN_VOTES:
        return None
    s = min(k for k, n in votes.items() if n == max(votes.values()))
    pairs = [(x[i], y[i + s]) for i in range(len(x)) if 0 <= i + s < len(y)]
    error = sum(bin(a ^ b).count("1") for a, b in pairs) / (32 * len(pairs))
    return (s, error) if len(pairs) >= audio.MIN_OVERLAP and error <= audio.MAX_ERROR else None


def test_search_by_loops(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**32, (4, 70), dtype=np.uint32)
    prints = []
    for k, cut in enumerate(rng.integers(0, 25, 24).tolist()):
        x = base[k % 4][cut:].copy()
        x[rng.random(len(x)) < 0.3] ^= np.uint32(1 << (k % 32))
        prints.append(x)
    # exact copies tie at error 0, one under a longer id, one without an id; short, empty and null ones match nothing
    prints += [base[0], base[0], base[0], base[1], base[1], np.repeat(base[3][:1], 50), base[2][:39], base[2][:0], None]
    ids = [*range(1, 25), 40, 9, 100, 60, None, 80, 120, 140, 160]
    rows = [(k, i, None if x is None else x.astype("<u4").tobytes(), "clash") for k, (i, x) in enumerate(zip(ids, prints, strict=True))]
    table = common.materialize(spark.createDataFrame(rows, "serial long, media_id long, fingerprint binary, block string"), "prints")
    want = []
    for k, i in enumerate(ids):
        if i is None or i % 20:
            continue
        x = [] if prints[k] is None else prints[k].tolist()
        found = []
        for j, other in enumerate(ids):
            y = [] if prints[j] is None else prints[j].tolist()
            if j != k and (hit := plain_alignment(x, y)):
                found.append((round(hit[1], 9), len(str(other or "")), str(other or ""), hit[0], other))
        best = min(found) if found else (None, None, None, None, None)
        want.append((i, len(x), len(found), best[4], best[3], best[0]))
    assert sum(n > 0 for _, _, n, *_ in want) >= 3 and any(n and best is None for _, _, n, best, *_ in want)
    for block, bucket in ((4_096, 2_000), (3, 5)):
        monkeypatch.setattr(audio, "BLOCK", block)
        monkeypatch.setattr(audio, "BUCKET", bucket)
        got = audio.search(table, F.col("media_id") % 20 == 0).collect()
        got = [(r.media_id, r.n_integers, r.n_matches, r.best_id, r.best_offset, None if r.best_error is None else round(r.best_error, 9)) for r in got]
        assert sorted(got) == sorted(want)


def test_filters_by_plain_sums():
    rng = np.random.default_rng(12)
    image = rng.random((40, 12)).astype(np.float32)
    got = audio.integers(image)
    assert len(got) == 40 - audio.SPAN + 1 and len(audio.integers(image[: audio.SPAN - 1])) == 0
    exact = image.astype(np.float64)
    for at, value in enumerate(got.tolist()):
        codes = []
        for kind, p, h, w in audio.FILTERS:
            part = whole = 0.0
            for t in range(w):
                for c in range(h):
                    x = exact[at + t, p + c]
                    late, high = t >= w // 2, c >= h // 2
                    inside = (late, high, late == high, w // 4 <= t < w - w // 4, h // 4 <= c < h - h // 4)[kind]
                    whole += x
                    part += x * inside
            level = sum(math.log((1 + part) / (1 + whole - part)) > edge for edge in (-audio.LEVEL, 0, audio.LEVEL))
            codes.append((0, 1, 3, 2)[level])
        assert value == reduce(lambda n, code: n << 2 | code, codes, 0)
