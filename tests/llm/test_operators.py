"""The ten operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quillworks.llm import audio, common, html_extraction, language_model, mixing, packing, quality_classifier, quality_rules, queries, simhash, tokens, toxicity
from quillworks.llm.html_blocks import blocks_of
from tokenizers import Tokenizer

from tests.compare import same_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().lower().split()


def texts():
    rng = random.Random(7)
    syllables = ["ba", "de", "ki", "lo", "mu", "ra", "ste", "ño", "é"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = [" ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 90))) for _ in range(70)]
    out += [out[0], out[0], out[1] + " extra", out[2].upper(), "", None, " \t\n", "one", "<|endoftext|> a", "x\x1cy  \n z", "the same line\nthe same line\n\nother", "w " * 6_000, "ab cd ef gh ij kl mn op " * 6]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 9 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1", 0)]
    extra = spark.createDataFrame(rows, DOCS)
    for name in ("score", "size", "fp", "n_words", "id", "block", "position", "kept", "rule_text", "taken", "label"):
        extra = extra.withColumn(name, F.lit("clash"))
    return common.materialize(extra, "small")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(5, 1, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_rules(docs, labels, empty):
    got = sorted((r for r in quality_rules.score_documents(docs, labels).collect()), key=str)
    want = {}
    for i, t in rows_of(docs):
        words = [w for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        again = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if again[w] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[i] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed)
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality_rules.score_documents(empty, labels).count() == 0


def test_rules_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = {r.bucket: r for r in quality_rules.log_ratios(docs, labels, buckets=1 << 16).collect()}
    r = found[zlib.crc32(b"words") % (1 << 16)]
    assert (r.target_n, r.raw_n) == (1, 2)
    p = quality_rules.PRIOR
    assert r.ratio == round(1e6 * np.log((1 + p) / (2 * 5 / 10 + p)))
    pair = found[(zlib.crc32(b"bad") * quality_rules.PRIME + zlib.crc32(b"words")) % (1 << 16)]
    assert (pair.target_n, pair.raw_n) == (0, 1)
    assert sum(r.raw_n for r in found.values()) == 10


def test_packing(docs, empty):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for parts in (1, 3):
        pieces = packing.pack_documents(common.materialize(docs.repartition(parts), "x"), path, with_ids=True).collect()
        by_doc, by_seq = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_seq.setdefault(p.sequence_id, []).append(p)
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) and p.length == len(p.ids)
        for i, t in rows_of(docs):
            want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            own = sorted(by_doc[i], key=lambda p: p.start)
            copies = sum(j == i for j, _ in rows_of(docs))
            assert sorted(x for p in own for x in p.ids) == sorted(want * copies)
            assert all(p.ids == want[p.start : p.start + p.length] and p.doc_tokens == len(want) for p in own)
        for own in by_seq.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == own[0].sequence_length and (at == 2048 or packing.power_of_two(at))
            assert own[0].route != "whole" or len(own) == 1
        # the sum-of-squares choice places nearly all that does not fill a window by itself
        placed = Counter()
        for p in pieces:
            placed[p.route] += p.length
        assert placed["level"] > 0.6 * (placed["level"] + placed["gap"])
    assert packing.pack_documents(empty, path).count() == 0


def test_gaps_of_open_windows():
    rng = random.Random(5)
    for _ in range(200):
        levels, total, serial = packing.Levels(64), Counter(), 0
        for doc in range(rng.randint(0, 40)):
            n = rng.randint(1, 63)
            full = levels.place([doc, 0, np.arange(serial, serial + n), n, "level"], n)
            if full:
                total.update(x for p in full for x in p[2].tolist())
            serial += n
        for window in packing.fill_gaps(levels.rest(), 64):
            size = sum(len(p[2]) for p in window)
            assert size == 64 or packing.power_of_two(size)
            total.update(x for p in window for x in p[2].tolist())
        assert total == Counter(range(serial))


def test_sum_of_squares_choice():
    rng = random.Random(1)
    levels, counts = packing.Levels(16), Counter()
    for _ in range(3_000):
        size = rng.randint(1, 15)
        cost = {}
        for h in [0, *[h for h, n in counts.items() if n and h + size <= 16]]:
            after = counts.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            cost[h] = sum(n * n for k, n in after.items() if 0 < k < 16)
        at = levels.choose(size)
        assert cost[at] == min(cost.values()) and at == max(h for h in cost if cost[h] == min(cost.values()))
        levels.place([0, 0, np.zeros(size), size, "level"], size)
        counts[at] -= at > 0
        counts[at + size] += at + size < 16
        assert [levels.counts[k] for k in range(1, 16)] == [counts[k] for k in range(1, 16)]


def grams_of(train, order):
    """Counts of the n-grams of texts that begin with a start mark (0) and end with None."""
    counts = Counter()
    for words in train:
        stream = [0, *words]
        counts.update(tuple(stream[i : i + k]) for k in range(1, order + 1) for i in range(len(stream) - k + 1))
    return counts


def probability(history, word, counts, n, order, least=1):
    """p(word | history) by its definition."""
    if not history:
        c = counts[(word,)]
        return (c - 0.5 if c else 0.5) / n
    state = counts[history] if len(history) == 1 or counts[history] >= least else 0
    shorter = probability(history[1:], word, counts, n, order, least)
    if not state:
        return shorter
    back = 1 - language_model.TOP * state / (state + language_model.HALF)
    arc = counts[(*history, word)]
    return ((1 - back) * arc / state if arc >= least else 0) + back * shorter


@pytest.mark.parametrize("order,least", [(1, 1), (2, 1), (3, 1), (4, 1), (3, 2)])
def test_language_model(docs, empty, order, least):
    held = common.crc_remainder(F.col("doc_id"), 7) == 2
    rows = [(i, words_of(t) + [None]) for i, t in rows_of(docs)]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    train = [w for i, w in rows if not out(i)]
    c, n = Counter(x for w in train for x in w), sum(map(len, train))
    counts = grams_of(train, order)
    for chars in (200, 10**9) if order == 3 else (1_000,):
        got = language_model.score_documents(docs, held, order=order, block_chars=chars, least_count=least).collect()
        assert len(got) == len(rows)
        for r in got:
            words = next(w for i, w in rows if i == r.doc_id)
            base = sum(log10((c[w] + 1) / (n + len(c) + 1)) for w in words)
            stream = [0, *words]
            score = sum(log10(probability(tuple(stream[max(0, i - order + 1) : i]), stream[i], counts, n, order, least)) for i in range(1, len(stream)))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(words), sum(c[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert language_model.score_documents(empty, held, order=order).count() == 0


def test_automaton_follows_failure_arcs():
    texts = ["a b c a b d", "b c d", "a b c", "e a"]
    grams = language_model.Grams([False, False, False, True], texts, 3)
    totals = [level.own for level in grams.levels]
    n = int(totals[0].sum() - totals[0][language_model.START])
    automaton = language_model.Automaton(grams, totals, n)
    counts = grams_of([t.split() + [None] for t in texts[:3]], 3)
    vocabulary = [w for w in range(len(totals[0])) if totals[0][w] and w != language_model.START]
    for state in range(len(automaton.failure_to)):
        _, weight = automaton.step(np.full(len(vocabulary), state), np.array(vocabulary))
        assert 0.0 < (10**weight).sum() <= 1 + 1e-9
        assert state == 0 or automaton.failure_to[state] < state
    # c after "e a": no state for "e a", so the walk is at "a", which has no arc for c: two failures, then the root
    number = {w: 2 + k for k, w in enumerate("abcde")}
    at = np.array([automaton.start])
    for w in "ea":
        at, _ = automaton.step(at, np.array([number[w]]))
    to, weight = automaton.step(at, np.array([number["c"]]))
    back = 1 - language_model.TOP * 3 / (3 + language_model.HALF)
    assert 10 ** weight[0] == pytest.approx(back * probability((), "c", counts, n, 3))
    long = ["x y z " * 400, "x y", "y z x y " * 301]
    grams = language_model.Grams([False] * 3, long, 3)
    automaton = language_model.Automaton(grams, [level.own for level in grams.levels], 10)
    assert np.allclose(automaton.walk(grams.ids, grams.starts, stride=7), automaton.walk(grams.ids, grams.starts, stride=10**6))


def test_toxicity(spark, docs, labels, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    made = [(" ".join([word() for _ in range(30)] + (["vilestem" + word()[:2]] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    model = toxicity.train([t for t, _ in made[:480]], [y for _, y in made[:480]], ["en"] * 480)
    test = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(made)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(test, model).collect()}
    right = [(got[i] >= 0.5) == bool(made[i][1]) for i in range(480, 600)]
    assert sum(right) >= 114
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(empty, model).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train([], [], [])).collect()} == {0.0}


def test_long_documents_pool_in_chunks():
    rng = np.random.default_rng(1)
    model = toxicity.new_model()
    vectors = rng.normal(size=(50, toxicity.DIMS)).astype(np.float32)
    vectors[0] = 0
    rows = [rng.integers(1, 50, n) for n in (0, 1, 5, 2_500, 7)]
    whole, size = model.pooled(rows, vectors), toxicity.CHUNK
    toxicity.CHUNK = 64
    try:
        assert np.allclose(whole, model.pooled(rows, vectors), atol=1e-5)
    finally:
        toxicity.CHUNK = size


def test_fingerprints_and_components(docs, empty):
    got = simhash.link_documents(docs).collect()
    rows = rows_of(docs)

    def brute(t):
        w = words_of(t)
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))

    prints = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((str(i), f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(rows))})
    assert simhash.link_documents(empty).count() == 0 and simhash.keep_documents(empty).count() == 0


@pytest.mark.parametrize("blocks", [2, 3])
def test_every_close_pair_meets_at_an_anchor(blocks):
    rng = np.random.default_rng(blocks)
    cover = simhash.Covering(blocks, 2)
    x = rng.integers(-(2**63), 2**63 - 1, 1_500)
    y = x.copy()
    for _ in range(2):
        y ^= np.int64(1) << rng.integers(0, 63, len(x))
    row, key = cover.replicas(y)
    met = set(zip(row.tolist(), key.tolist(), strict=True))
    assert len(met) == len(row) and all((k, int(h)) in met for k, h in enumerate(cover.homes(x)))


def test_token_counts(docs, empty):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    marks = ["a", "Bc", " ", "  ", "\n", "\t", "'s", ".", ",", "<|endoftext|>", "é", "ſ", "　", "1", "\x85"]
    more = docs.sparkSession.createDataFrame([(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))) for i in range(1_500)], "doc_id long, text string")
    for df in (docs, more):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, path).collect())
        want = sorted((str(i), len((t or "").encode()), (n := len(tokenizer.encode(t or "", add_special_tokens=False).ids)), n > 1024) for i, t in rows_of(df))
        assert got == want
    assert tokens.count_tokens(empty, path).count() == 0


def test_word_ids_are_the_tokenizers():
    path = tokens.tokenizer_path("word_bpe_49k.json")
    tokenizer, words, rng = Tokenizer.from_file(path), packing.WordIds(path, most=50), random.Random(4)
    marks = ["a", "Bc", " ", "\n", "'s", "'", ".", ",!", "<|endoftext|>", "É", "é", "İ", "ß", "　", "1", "\x1c", "\x85", "x"]
    marks += ["###", "%%", "&", "$", "word", "größe ", "ñandú, "]
    for _ in range(400):
        made = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
        for text, ids in zip(made, words.ids(made, 1), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_mixing(docs, empty):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == docs.count()
    taken, target, size = Counter(), {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    weights, open_, goal = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}, set(size), {}
    while open_:
        share = (sum(size.values()) - sum(goal.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 3 * size[s]}
        if not full:
            goal |= {s: share * weights[s] for s in open_}
            break
        goal |= {s: 3 * size[s] for s in full}
        open_ -= full
    for s in size:
        assert target[s] == pytest.approx(goal[s]) and abs(taken[s] - target[s]) <= 1
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0
    # every copy of every row, and no more
    want, have = Counter(), Counter(str(r.doc_id) for r in mixing.mixed_documents(docs).collect())
    for r in got:
        want[str(r.doc_id)] += int(r.taken / r.size + 0.5) if r.size else 0
    assert {i: n for i, n in want.items() if n} == dict(have)


def test_copies_follow_the_schedule(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 30), "abcd"[k]) for k, n in enumerate((60, 15, 12, 40)) for i in range(100 * k, 100 * k + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.planned(mixing.sized(docs, "doc_id", "text", "source")).collect()
    copies = [(r.mix_source, x.position, x.lap_taken) for r in plan for x in r.mix_laps]
    assert {r.mix_source for r in plan if len(r.mix_laps) > 1} >= {"b", "c"}
    for k, s in enumerate("abcd"):
        target, slope = next((r.target, mixing.SLOPES[r.weight_no]) for r in plan if r.mix_source == s)
        for t in [x / 10 for x in range(1, 11)]:
            taken = sum(n for x, at, n in copies if x == s and at <= t)
            assert abs(taken - target * (t + slope * (t * t - t))) <= 31
    order = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    assert all(a != b for a, b in zip(order, order[1:], strict=False)) and max(Counter(order).values()) == 3


def test_wholly_equal_rows_keep_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1), (1, "a b", "s", 1), (1, "a b", "s", 2), (None, "c d", "s", 3), (None, "e f", "s", 3)], "doc_id long, text string, source string, x int")
    out = Counter((r.doc_id, r.text, r.x) for r in mixing.mixed_documents(docs).collect())
    assert out == {(1, "a b", 1): 2, (1, "a b", 2): 1, (None, "c d", 3): 1, (None, "e f", 3): 1}


def test_html(spark):
    model = html_extraction.labeller()
    page = '<html><head><title>T</title><script>if(a<b){x="</p>"}</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now</div><article><h1>A &lt;head&gt;</h1><p>One  two<br>three &amp;amp; <b>four<p>Second\n paragraph of the article.</article><footer>&copy; all</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<script>never closed"), (None, "u", page), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extraction.extract_text(df, model).collect()
    assert len(got) == 7
    text = "A <head>\nOne two three &amp; four\nSecond paragraph of the article."
    assert [r.text for r in got if r.url and r.n_blocks > 2] == [text] * 3
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3, 5))
    assert html_extraction.extract_text(df.limit(0), model).count() == 0
    maker, right, n = html_extraction.PageMaker(77), 0, 0
    for _ in range(60):
        made, want = maker.page()
        found = blocks_of(made)
        if found and len(found) == len(want):
            y = html_extraction.probabilities(model, [html_extraction.inputs(model, html_extraction.Indexer().of(found))])[0] >= 0.5
            right, n = right + (y == np.array(want)).sum(), n + len(want)
    assert right / n > 0.97


def test_audio(spark):
    rng = np.random.default_rng(3)
    t = np.arange(800) / audio.RATE
    tones = np.stack([12_000 * np.sin(2 * np.pi * f * t) for f in 220 * 2 ** (np.arange(12) / 12)])
    tunes = [rng.integers(0, 12, 64) for _ in range(60)]
    sound = lambda k: tones[k].ravel()
    pcm = [sound(k).astype("<i2").tobytes() for k in tunes]
    rows = [(i, p, audio.RATE) for i, p in enumerate(pcm)]
    rows += [(100 + i, (sound(k) + rng.normal(0, 500, 51_200)).astype("<i2").tobytes(), audio.RATE) for i, k in enumerate(tunes[:20])]
    rows += [(200 + i, sound(k)[8_000:].astype("<i2").tobytes() + b"x", audio.RATE) for i, k in enumerate(tunes[:20])]
    rows += [(300, None, audio.RATE), (301, b"", audio.RATE), (302, b"abc", None), (None, pcm[0], audio.RATE)]
    df = spark.createDataFrame(rows, "media_id long, pcm binary, sample_rate int")
    prints = common.materialize(audio.fingerprint_audio(df), "prints")
    got = {r.media_id: r for r in audio.search(prints, F.col("media_id") >= 100).collect()}
    assert len(got) == 43
    assert all(got[i].n_matches == 0 and got[i].n_integers == 0 for i in (300, 301, 302))
    assert sum(got[100 + i].best_id in (i, 200 + i) for i in range(20)) == 20
    assert sum(got[200 + i].best_id in (i, 100 + i) and abs(got[200 + i].best_offset - 20) <= 1 for i in range(20)) >= 19
    assert audio.search(prints.limit(0), F.col("media_id") >= 0).count() == 0


def test_audio_search_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (6, 80), dtype=np.uint32)
    some = [base[k % 6][a:].copy() for k, a in enumerate(rng.integers(0, 30, 40))]
    for x in some:
        x[rng.random(len(x)) < 0.2] ^= np.uint32(1 << 7)
    prints = [x.tobytes() for x in some]
    found = {(int(a), int(b)) for q, o, _, _ in audio.alignments(prints, prints, 4, 40, 0.25, part=7) for a, b in zip(q, o, strict=True)}
    for a, x in enumerate(some):
        for b, y in enumerate(some):
            best, votes = None, 3
            for s in range(-80, 81):
                u, v = x[max(0, -s) :], y[max(0, s) :]
                n = min(len(u), len(v))
                if n > 0 and (e := int((u[:n] == v[:n]).sum())) > votes:
                    best, votes = (n, np.bitwise_count(u[:n] ^ v[:n]).sum() / (32 * n)), e
            assert ((a, b) in found) == (best is not None and best[0] >= 40 and best[1] <= 0.25)


def test_quality_classifier(spark, docs, labels, empty):
    rng = random.Random(6)
    kinds = [lambda: "".join(rng.choice("abcdef") for _ in range(5)), lambda: "".join(rng.choice("abcdef") for _ in range(5)) + "###", lambda: "".join(rng.choice("ABCDEF") for _ in range(5)) + "!!"]
    made = [(i, " ".join(kinds[2 - i % 3]() for _ in range(40)), i % 3) for i in range(450)]
    df = spark.createDataFrame(made, "doc_id long, text string, grade int")
    model = quality_classifier.fit(df, df.where("doc_id < 300").select("doc_id", "grade"))
    assert model.grades == [0, 1, 2] and list(model.thresholds) == sorted(model.thresholds)
    got = [r for r in quality_classifier.score_documents(df, model).collect() if r.doc_id >= 300]
    assert sum(round(r.expected_grade) == r.doc_id % 3 for r in got) >= 140
    assert sum(r.selected == (r.doc_id % 3 > 0) for r in got) >= 140
    own = quality_classifier.fit(docs, quality_classifier.graded(labels))
    scored = quality_classifier.score_documents(docs, own)
    assert scored.count() == docs.count() and scored.where("tail is null or expected_grade is null").count() == 0
    assert quality_classifier.keep_documents(docs, own).columns == docs.columns
    bare = quality_classifier.fit(docs, labels.select("doc_id", F.lit(None).cast("int").alias("grade")))
    assert {r.expected_grade for r in quality_classifier.score_documents(docs, bare).collect()} == {0.0}
    assert quality_classifier.score_documents(empty, own).count() == 0


def test_quality_gradient_finds_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3_000)
    grade = (x + rng.logistic(size=3_000) > -1).astype(int) + (x + rng.logistic(size=3_000) > 1)
    order = np.argsort(grade, kind="stable")
    rows = [(int(grade[k]), np.array([5]), np.array([x[k]], dtype=np.float32)) for k in order]
    model = quality_classifier.fit_ordinal(rows, steps=400, rate=0.1, decay=0.0)
    eta = model.weights[5] * x
    tail = np.hstack([np.ones((3_000, 1)), model.tails(eta), np.zeros((3_000, 1))])
    each = np.arange(3_000)
    like = np.log(tail[each, grade] - tail[each, grade + 1]).sum()
    for step in (0.97, 1.03):
        other = quality_classifier.OrdinalModel(model.weights * step, model.thresholds, model.grades)
        t = np.hstack([np.ones((3_000, 1)), other.tails(other.weights[5] * x), np.zeros((3_000, 1))])
        assert np.log(t[each, grade] - t[each, grade + 1]).sum() <= like + 1e-3


def test_no_query_set_is_cut(spark):
    con = duckdb.connect()
    n = con.execute(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    for name in ("op3_lm_scores", "op5_simhash_dedup", "op6_token_counts", "op10_quality_classifier"):
        assert queries.QUERIES[name](spark, SF).count() == n


def test_three_blocks_link_the_same(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [x for b in base for x in (b, b ^ 1 << rng.randrange(64), b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))] + [0]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    table = common.materialize(spark.createDataFrame(signed, "fp long"), "fps")
    two, three = (sorted(map(tuple, simhash.classes(table, 2, most).collect())) for most in (10**6, 0))
    assert two == three


def test_one_of_equal_rows_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1), (1, "a b c d e", 1), (1, "a b c d e", 2), (None, None, 3), (None, "", 4), (7, "other words in this text", 5)], "doc_id long, text string, x int")
    got = simhash.keep_documents(docs).collect()
    assert len(got) == 3 and {r.doc_id for r in got} == {1, None, 7}
    assert sorted(map(str, got)) == sorted(map(str, simhash.keep_documents(docs.repartition(3)).collect()))
