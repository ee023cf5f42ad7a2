"""Line, section, allotment and bank rules against plain loops on random input."""

import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F
from quillworks.functions import textops
from quillworks.functions.textops import round_half_even
from quillworks.operators import bank, blueprint, documents, lines, measures, pairs, sections, simjoin


def frame(spark, docs):
    return spark.createDataFrame([(i, k, x) for i, d in enumerate(docs) for k, x in enumerate(d)], "doc_id long, line_no int, line string")


def by_doc(df, *cols):
    out = {}
    for r in df.orderBy("doc_id", cols[0]).collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols[1:]) if len(cols) > 2 else r[cols[1]])
    return out


def table_loop(doc):
    """Runs of table rows, a single blank allowed between two of them."""
    is_row = lambda x: len([c for c in x.split("  ") if c.strip()]) >= 2
    out, k = [], 0
    while k < len(doc):
        rows, end = [], k
        while end < len(doc) and (is_row(doc[end]) or (rows and not doc[end] and doc[end - 1])):
            rows += [doc[end]] if is_row(doc[end]) else []
            end += 1
        if len(rows) < 3:
            out.append(doc[k])
            k += 1
            continue
        cells = [[c.strip() for c in r.split("  ") if c.strip()] for r in rows]
        head = cells[0]
        if all(c.isalpha() for c in head):
            out.append("Table columns: " + " | ".join(head))
            out += ["- " + "; ".join(f"{head[i] if i < len(head) else f'col_{i + 1}'}: {c}" for i, c in enumerate(r)) for r in cells[1:]]
        else:
            out += ["Table rows:"] + ["- " + " | ".join(r) for r in cells]
        out.append("")
        k = end
    return out


def test_tables(spark):
    rng = random.Random(1)
    docs = [[rng.choice(["", "", "text here", "a  b", "x  y", "speed  two", "1  2", "c  d  e"]) for _ in range(rng.randint(1, 14))] for _ in range(150)]
    got = by_doc(lines.rewrite_tables(frame(spark, docs)), "line_no", "line")
    for i, d in enumerate(docs):
        assert got.get(i, []) == table_loop(d), d


def test_uneven_table_keeps_rows(spark):
    docs = [["a  b", "a  b  c  d  e", "a  b  c  d  e  f  g  h", "tail"]]
    assert by_doc(lines.rewrite_tables(frame(spark, docs)), "line_no", "line")[0] == [*docs[0][:3], "", "tail"]


def test_join_wrapped():
    assert lines.join_wrapped(["over-", "lap of", "words.", "Next", "", "- item", "goes on"]) == ["overlap of words.", "Next", "", "- item", "goes on"]
    long = "A line that has become longer than sixty characters, as it seems"
    assert lines.join_wrapped([long, "Then"]) == [f"{long} Then"]
    assert lines.join_wrapped(["one,", "Two", "Chapter 3", "low"]) == ["one, Two", "Chapter 3", "low"]
    assert lines.join_wrapped(["ends.-", "x"]) == ["ends.x"]
    assert lines.join_wrapped([]) == []


def test_captions_and_page_numbers_take_blanks(spark):
    df = spark.createDataFrame([(1, "a\n\n\n3-4\nb\nFigure 1-2. cap\nImage 3: x\n(cid:7)c\nPage 12\n\nFigure no"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.strip_artifacts(df).collect()}
    # the blank lines before a caption or number go with it, the line end after it stays
    assert got == {1: "a\n\nb\n\nc\n\nFigure no", 2: None}


def test_repeated_and_image_lines(spark):
    docs = [["H", "x", " H", "H ", "y" * 119, "y" * 119, "y" * 119, "z" * 120, "z" * 120, "z" * 120, "photo", "----", "a|b|c|", ""]]
    kept = by_doc(lines.drop_repeated_lines(frame(spark, docs)), "line_no", "line")[0]
    assert kept == ["x", "z" * 120, "z" * 120, "z" * 120, "photo", "----", "a|b|c|", ""]
    assert by_doc(lines.drop_image_lines(frame(spark, [kept[4:]])), "line_no", "line")[0] == ["a|b|c|", ""]


def section_loop(doc):
    """Headings, merged, thinned, with their bodies, one line at a time."""
    heads = [k for k, x in enumerate(doc) if x.isupper() and len(x) >= 3 and (k == 0 or not doc[k - 1])]
    merged = []
    for k in heads:
        if merged and k - merged[-1][1] <= 4 and not any(doc[merged[-1][1] + 1 : k]):
            merged[-1][1], merged[-1][2] = k, f"{merged[-1][2]} {doc[k]}"
        else:
            merged.append([k, k, doc[k]])
    groups = []
    for m in merged:
        if groups and m[0] - groups[-1][-1][1] <= 8:
            groups[-1].append(m)
        else:
            groups.append([m])
    kept = [m for g in groups if len(g) < 6 for m in g]
    if not kept:
        return [("Content", "\n".join(doc).strip())]
    ends = [m[0] for m in kept[1:]] + [len(doc)]
    rows = [[m[2], "\n".join(doc[m[1] + 1 : e]).strip()] for m, e in zip(kept, ends, strict=True)]
    done = []
    while rows:
        title, text = rows.pop(0)
        if len(text) >= 200 or not (done or rows):
            done.append([title, text])
        elif done:
            done[-1][1] = "\n".join(x for x in (done[-1][1], title, text) if x).strip()
        else:
            rows[0][1] = "\n".join(x for x in (title, text, rows[0][1]) if x).strip()
    return [tuple(r) for r in done]


def test_sections(spark):
    rng = random.Random(2)
    choices = ["", "", "HEAD ONE", "TITLE", "a body line with some words in it. " * 3, "short body."]
    docs = [[rng.choice(choices) for _ in range(rng.randint(1, 60))] for _ in range(120)]
    docs = [[x.strip() for x in d] for d in docs]
    df = spark.createDataFrame([(i, "\n".join(d), "x.pdf", "auto") for i, d in enumerate(docs)], "doc_id long, text string, source_name string, doc_type string")
    got = by_doc(sections.detect_sections(df), "seq", "title", "content")
    for i, d in enumerate(docs):
        while d and not d[-1]:
            d = d[:-1]
        assert got[i] == section_loop(d), d


def test_glossary(spark):
    text = "A\n\nAileron\nA surface.\nG-1\nTable columns: x | y\n\n- a: b; c: d\nB\n\nBank\nA turn.\n- a: b; c: d"
    df = spark.createDataFrame([(1, text, "glossary.pdf", "auto")], "doc_id long, text string, source_name string, doc_type string")
    got = by_doc(sections.detect_sections(df), "seq", "title", "content")[1]
    assert got == [("A Aileron", "A surface."), ("B Bank", "A turn.\n- a: b; c: d")]


def test_title_and_numbers(spark):
    rows = [(1, 0, "Chapter 3: Slow Flight", "t", 1), (1, 1, "One", "a b", 2), (1, 2, "Two", "c", 1), (2, 0, "First", "x", 1), (2, 1, "Chapter 9", "y", 1), (3, 0, "Only", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, title string, content string, word_count long")
    titles = {r.doc_id: (r.doc_title, r.body_from) for r in documents.pick_title(df).collect()}
    assert titles == {1: ("Slow Flight", 1), 2: ("Chapter 9", 2), 3: ("Only", 1)}
    numbered = documents.number_and_weigh(df.withColumn("id_prefix", F.lit("AFH.3")))
    assert {(r.doc_id, r.id, r.section_weight) for r in numbered.collect() if r.doc_id == 1} == {(1, "AFH.3.1", 25.0), (1, "AFH.3.2", 50.0), (1, "AFH.3.3", 25.0)}
    names = spark.createDataFrame([("a/ch_07_x.pdf",), ("x",), (None,)], "n string").select(documents.chapter_number_col(F.col("n")).alias("c")).collect()
    assert [r.c for r in names] == [7, 0, 0]


def allot_loop(rows, target):
    """One question at a time, as the rule says it."""
    counts = [max(1, g or 0) for _, g in rows]
    safe = max(len(rows), target)
    heavy = max(range(len(rows)), key=lambda k: (rows[k][0], -k))
    light = sorted(range(len(rows)), key=lambda k: (rows[k][0], k))
    for _ in range(5_000):
        gap = safe - sum(counts)
        if gap > 0:
            counts[heavy] += 1
        elif gap < 0 and (take := next((k for k in light if counts[k] > 1), None)) is not None:
            counts[take] -= 1
        else:
            break
    return counts


def test_allotment(spark):
    rng = random.Random(3)
    docs = [([(float(rng.randint(0, 5)), rng.choice([None, 0, 1, 2, 7])) for _ in range(rng.randint(1, 9))], rng.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame([(i, k, w, g, t) for i, (rows, t) in enumerate(docs) for k, (w, g) in enumerate(rows)], "doc_id long, no long, weight double, given long, target long")
    got = by_doc(blueprint.allocate_questions(df), "no", "questions")
    for i, (rows, t) in enumerate(docs):
        assert got[i] == allot_loop(rows, t)
    n = blueprint.normalize_weights(df).groupBy("doc_id").agg(F.round(F.sum("weight"), 2).alias("s"), F.max("weight").alias("m")).collect()
    sums = {i: sum(w for w, _ in rows) for i, (rows, _) in enumerate(docs)}
    assert all(r.s == 100.0 for r in n if sums[r.doc_id] > 0)


def test_trim(spark):
    def loop(text, most):
        out, left = [], most
        for line in text.split("\n"):
            words = line.split()
            if words and len(words) > left:
                out += [" ".join(words[:left])] if left else []
                break
            out.append(line)
            left -= len(words)
        return "\n".join(out).strip() + "\n"

    rng = random.Random(4)
    texts = ["\n".join(" ".join(["w"] * rng.randint(0, 6)) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in measures.trim_to_words(df, 11).collect()}
    assert got == {i: loop(t, 11) for i, t in enumerate(texts)}


def test_reply_parsing_and_slots(spark):
    good = '{"questions":[{"question":"no section id, so it is dropped"},{"sectionId":"s","question":" Is this one of the right kind of stems?","correct_answers":["a",{"text":" b "},""],"wrong_answers":[]}]}'
    rows = [("d", "s", 1, 1, f"Sure: {good} done"), ("d", "s", 2, 1, "no json"), ("d", "s", 3, 1, '{"questions":[{"sectionId":"other","question":"x"}]}')]
    df = spark.createDataFrame(rows, "doc_id string, section_id string, slot int, attempt int, body string")
    got = bank.parse_candidates(df).collect()
    assert [(r.slot, r.question, r.correct) for r in got] == [(1, "Is this one of the right kind of stems?", ["a", "b"])]
    cand = [("d", "s", 1, 1, 0, "A"), ("d", "s", 1, 2, 0, "B"), ("d", "s", 2, 1, 0, "a"), ("d", "s", 2, 2, 0, "C"), ("d", "s", 3, 7, 0, "D")]
    c = spark.createDataFrame(cand, "doc_id string, section_id string, slot int, attempt int, pos int, question string").withColumn("subjects", F.array().cast("array<string>"))
    need = spark.createDataFrame([("d", "s", "T", 5)], "doc_id string, section_id string, section_title string, questions long")
    pick = lambda mode: [r.question for r in bank.accept_questions(c, need, mode).orderBy("number").collect()]
    assert pick("slots") == ["A", "C"]
    assert pick("batch") == ["A", "B", "C", "D"]


@pytest.mark.parametrize("threshold", [0.55, 0.56, 0.6, 0.72, 1.0])
def test_similarity_join(spark, threshold):
    rng = random.Random(5)
    vocabulary = [f"token{k}" for k in range(26)]
    texts = [" ".join(rng.choice(vocabulary[:7]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    # sets whose similarity is the threshold itself, and just below it
    texts += [" ".join(vocabulary[:n]) for n in (25, 14, 13, 20, 11, 18, 10)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {(r.left_id, r.right_id) for r in simjoin.similar_texts(df, df, threshold).collect()}
    sets = [set(t.split()) for t in texts]
    part = Fraction(str(threshold))
    want = {(str(i), str(j)) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and Fraction(len(a & b), len(a | b)) >= part}
    assert got == want


def test_similarity_of_a_line_that_many_hold(spark):
    many = spark.range(10_000).select(F.col("id").cast("string").alias("id"), F.lit("the same legal notice everywhere").alias("text"))
    one = spark.createDataFrame([("x", "same legal notice everywhere")], "id string, text string")
    sets, members = simjoin.classes(many)
    assert (sets.count(), members.count()) == (1, 10_000)
    assert simjoin.similar_texts(many, one).count() == 10_000


def test_known_totals(spark):
    df = spark.createDataFrame([(1, k, "x" * 900) for k in range(44)], "doc_id long, no long, content string")
    assert measures.document_metrics(df).first().questions == 44
    answers = [f"answer number {k} of it" for k in range(11)]
    rows = [(1, "afh_1", f"AFH.1.1.{k}", 1, k, "q?", answers[:3], answers[3:], "s", ["t"]) for k in range(1, 45)]
    questions = spark.createDataFrame(rows, "doc_id long, id_base string, question_id string, section_no long, number long, question string, correct array<string>, wrong array<string>, source string, subjects array<string>")
    assert pairs.pair_totals(pairs.training_pairs(questions)).first().total_pairs == 484
    assert pairs.record_request(questions).first().target == 145


def plain_fold(given):
    """The rule for wrapped lines, letter by letter."""
    spaces = " \t"

    def cells(line):
        parts, part, k = [], "", 0
        while k < len(line):
            end = k
            while end < len(line) and line[end] in spaces:
                end += 1
            if "\t" in line[k:end] or end - k >= 2:
                # a run of tabs, or of two blanks or more, ends a cell
                parts, part, k = [*parts, part], "", end
            else:
                part, k = part + line[k : max(end, k + 1)], max(end, k + 1)
        return [p for p in [*parts, part] if p.strip()]

    def bullet(line):
        head, _, rest = line.partition(" ")
        return bool(rest.strip()) and (head in ("-", "*", "•") or (head[-1:] in (".", ")") and (head[:-1].isdigit() or (len(head) == 2 and head[0].isascii() and head[0].isalpha()))))

    def chapter(line):
        words = line.split()
        return len(words) > 1 and words[0].lower() == "chapter" and words[1][0].isdigit()

    apart = lambda line: bullet(line) or chapter(line) or len(cells(line)) >= 2
    out, now = [], None
    for line in (x.strip() for x in given):
        if not line:
            out += [now, ""] if now is not None else [""]
            now = None
        elif now is None or apart(now) or apart(line):
            out += [now] if now is not None else []
            now = line
        elif now[-1] == "-" and line[0].isalnum():
            now = now[:-1] + line
        elif now[-1] not in ".!?:;" and (line[0].islower() or now[-1] in ",(/" or len(now) >= 60):
            now += " " + line
        else:
            out.append(now)
            now = line
    return [" ".join(x.split()) for x in out + ([now] if now is not None else [])]


def test_random_wrapped_lines():
    rng = random.Random(12)
    bits = ["", " ", "word", "Word", "and so on", "broken-", "ends.", "asks?", "open (", "list,", "a/", "- item here", "1. first", "b) second", "* star", "Chapter 3 Stalls", "chapter x", "one  two", "one\ttwo", "x" * 61, "Y" * 59, "4 more", "é", "-", "• dot", "A.", "ß go"]
    for _ in range(20_000):
        given = [rng.choice(bits) + rng.choice(["", "", " tail", "-"]) for _ in range(rng.randint(0, 9))]
        assert lines.join_wrapped(given) == plain_fold(given), given


def test_weights_round_as_sql(spark):
    """Shares that lie on or beside a half of a hundredth: 23 of 4,000 words are 0.575 per cent, which is below its half."""
    con = duckdb.connect()
    rows = con.execute("SELECT w, t, round_even(CAST(w AS DOUBLE) / t * 100, 2) FROM range(1, 8001) a(t), range(0, 8001) b(w) WHERE w <= t AND (w * 100000) % t = 0 AND (w * 100000 // t) % 10 = 5 AND (t % 4000 = 0 OR w < 9)").fetchall()
    given = spark.createDataFrame(rows, "w long, t long, want double")
    assert len(rows) > 500 and given.where(round_half_even(F.col("w") / F.col("t") * 100) != F.col("want")).count() == 0


def test_blueprint_weights_round_as_in_sql(spark):
    """Halves of a hundredth, and numbers beside them that are halves when scaled, of either sign."""
    con = duckdb.connect()
    rows = con.execute("SELECT w, t, round(w / t * 100, 2) FROM (SELECT CAST(a AS DOUBLE) / 4 AS t FROM range(1, 16001) x(a)), (SELECT CAST(b AS DOUBLE) / 4 AS w FROM range(-40, 41) y(b)) WHERE abs(w / t * 10000 - floor(w / t * 10000) - 0.5) < 1e-9").fetchall()
    given = spark.createDataFrame(rows, "w double, t double, want double")
    assert len(rows) > 500 and given.where(textops.round_half_up(F.col("w") / F.col("t") * 100) != F.col("want")).count() == 0


SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def test_white_space_of_any_kind(spark):
    """Stripping and words without patterns over whole lines: what (?U)\\s finds, and nothing else."""
    others = "\x1c\x1f​᠎⁠﻿"
    rows = [(f"{c}a{c}b{c}",) for c in SPACES + others] + [("",), (" ",), (None,), (" one  two\tthree　four five six ",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", textops.strip_col(F.col("t")).alias("s"), textops.words_col(F.col("t")).alias("w"), F.array_join(textops.first_words_col(F.col("t"), 4), " ").alias("f"), *[textops.has_words_col(F.col("t"), n).alias(f"h{n}") for n in (1, 2, 5)]).collect()
    for r in got:
        words = [] if r.t is None else [w for w in re.split(f"[{SPACES}]+", r.t) if w]
        assert r.s == (None if r.t is None else r.t.strip(SPACES))
        assert (r.w, r.f) == (words, " ".join(words[:4]))
        assert [r.h1, r.h2, r.h5] == [len(words) >= n for n in (1, 2, 5)]


def test_lines_are_split_once(spark):
    ends = ["\n", "\r\n", *"\r\x0b\x0c\x1c\x1d\x1e\x85  "]
    texts = ["", "a", *ends, *[f"a{e}b{e}{e}c{e}" for e in ends], "a\n\r\nb\r\n", "\n\r"]
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", textops.split_lines_col(F.col("t")).alias("l"))
    for r in df.collect():
        assert r.l == loop_lines(r.t or "")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # one split by the plain end, one by all of them: the rules about the last line do not split again
    assert plan.count("split(") == 2


def loop_lines(text):
    out, at = [""], 0
    while at < len(text):
        if text[at] in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
            at += text[at : at + 2] == "\r\n"
            out.append("")
        else:
            out[-1] += text[at]
        at += 1
    return out[:-1] if out[-1] == "" else out
