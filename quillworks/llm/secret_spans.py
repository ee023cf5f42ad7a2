"""Secrets in texts: three fixed patterns, and an assignment-aware lexer that judges literals by the names they get.

The lexer reads whole texts. At every sign that can bind a value (=, :, :=, =>, an opening bracket or comma before a
quote, the end of an XML tag, a command-line flag) it takes the name before it and the expression after it: quoted
strings, names and bare values, chained by + or standing side by side. That gives name-literal pairs. Constants are
propagated: a name in an expression stands for the literals bound to it before, or, where it is bound only later, for
those, so that a literal is judged under every name it reaches. A pair's score is the weight of its most sensitive name
times the weight of its literal (length, variety, entropy; placeholders, paths and plain words count little); literals
from the threshold on are spans of kind `literal`, unless a span of the fixed patterns covers them.

Positions are code points, ends exclusive, over the whole text. Defined results: a null text is empty; an empty text has
no spans; repeated rows each get a row; null ids stay; extra columns are ignored; an empty table gives an empty result.
Time is linear in the text: every character is read a bounded number of times.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common

common.ship(__name__)

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs are taken whole, so the least length in the pattern drops just the runs that are too short.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST_VALUE, THRESHOLD = 8, 0.5

#: How much a word of a name says that its value is secret; two words together where one alone says little.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "authorization": 0.8, "auth": 0.7, "bearer": 0.8, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 0.9, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "key": 0.6, "signature": 0.6, "salt": 0.6,
    "cookie": 0.6, "session": 0.5, "contrasena": 1.0, "passwort": 1.0, "kennwort": 1.0, "clave": 0.7, "geheim": 0.8,
}
#: Words after which the name tells about a secret without holding one, and keys that are open.
HARMLESS = frozenset("public length count size type name id hint policy min max age ttl expiry expires file path url uri field label prompt regex pattern index primary foreign sort".split())
PLACEHOLDER = re.compile(r"(?i)\$\{|\$\(|\{\{|%\(|<[a-z _-]+>|example|change_?me|placeholder|your[_-]|dummy|redacted|xxxx|\*\*\*\*|^(?:null|none|true|false|undefined)$")
PATH = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|[./~]*/|[A-Za-z]:\\")

SIGN = re.compile(r"(?<![=!<>:])(?:=>|:=|[=:])(?![=:])|(?<=[\"'])\x20*,(?=\x20*[\"'`])|\((?=\x20*[\"'`])|(?<=[\w\"'])>(?=[^\s<>=])|(?<=\s)--[A-Za-z][\w-]*(?=\x20+[^\s-])")
STRING = r"[rbfuRBFU]{0,2}(?:\"(?P<double>[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+)\"|'(?P<single>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`(?P<back>[^`\n]*+)`)"
OPERAND = re.compile(rf"[ \t]*(?:{STRING}|(?P<name>[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+)(?=[ \t]*(?:[;,)+}}\]\n<]|$))|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]++)(?![(\[]))")
CHAIN, BESIDE = re.compile(r"[ \t]*\+\s*"), re.compile(r"[ \t]*(?=[\"'])")
SCHEMES = frozenset(("bearer", "basic", "token"))
USERINFO = re.compile(r"://[^\s/:@\"'<>]*+:(?P<word>[^\s/:@\"'<>]++)@")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñ]+")


class Literal(NamedTuple):
    value: str
    start: int
    end: int


class Pair(NamedTuple):
    """A name and what is bound to it: literals and names, in order."""

    target: str
    parts: list[Literal]
    names: list[bool]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def target_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before a sign, quoted or plain, and where it starts; an empty name if there is none."""
    end = at
    while end and text[end - 1] in " \t]?":
        end -= 1
    if end and text[end - 1] in "\"'":
        start = text.rfind(text[end - 1], 0, end - 1) + 1
        return ("", end) if not start or "\n" in text[start : end - 1] else (text[start : end - 1], start - 1)
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-.$@"):
        start -= 1
    return text[start:end], start


def expression(text: str, at: int) -> tuple[list[Literal], list[bool], int]:
    """The operands from a place on, whether each is a name, and where the last bare one ends (the place, if none)."""
    parts, names, done = [], [], at
    while m := OPERAND.match(text, at):
        kind = m.lastgroup
        if kind != "bare" or m[kind].lower() not in SCHEMES:
            parts.append(Literal(m[kind], m.start(kind), m.end(kind)))
            names.append(kind == "name")
        at = m.end()
        if kind == "bare":
            done = at
            if m[kind].lower() in SCHEMES:
                continue
        more = CHAIN.match(text, at) or (BESIDE.match(text, at) if kind not in ("bare", "name") else None)
        if not more:
            break
        at = more.end()
    return parts, names, done


def pairs(text: str) -> Iterator[Pair]:
    """Name-literal pairs in order of their signs. A value's quoted strings are read for pairs of their own as well."""
    done = 0
    for m in SIGN.finditer(text):
        if m.start() < done:
            continue
        sign = m[0]
        target, start = (sign, m.start()) if sign.startswith("--") else target_before(text, m.start())
        if not target:
            continue
        if sign == "=" and text[max(0, start - 2) : start].rstrip(" ").endswith(":"):
            # a declaration with a type: the name stands before the colon
            named, _ = target_before(text, text.rindex(":", 0, start))
            target = named or target
        parts, names, end = expression(text, m.end())
        if parts:
            done = end
            yield Pair(target, parts, names)
    if "://" in text:
        for m in USERINFO.finditer(text):
            yield Pair("password", [Literal(m["word"], m.start("word"), m.end("word"))], [False])


def propagated(found: list[Pair]) -> Iterator[tuple[str, list[Literal]]]:
    """Names with the literals that reach them. A name bound to nothing counts as a bare literal itself."""
    bound: dict[str, list[Literal]] = {}
    later: dict[str, list[Literal]] = {}
    for pair in reversed(found):
        if not any(pair.names):
            later[pair.target] = pair.parts
    for pair in found:
        literals: list[Literal] = []
        for part, is_name in zip(pair.parts, pair.names, strict=True):
            short = part.value.rpartition(".")[2]
            known = next((d[n] for d in (bound, later) for n in (part.value, short) if n in d), None) if is_name else None
            literals += known or [part]
        # a chain that keeps growing by itself (x = x + "a") holds what it was first made of
        bound[pair.target] = literals if len(literals) <= len(pair.parts) + 8 else pair.parts
        yield pair.target, literals


def name_weight(name: str) -> float:
    """How sensitive a name is: 0 to 1."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[-1] in HARMLESS or "public" in words:
        return 0.0
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in words + joined), default=0.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: 0 to 1."""
    if len(value) < LEAST_VALUE or PLACEHOLDER.search(value) or PATH.match(value):
        return 0.0
    counts = Counter(value)
    if len(counts) < 5:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), any(not c.isalnum() for c in counts)))
    plain = value.replace(" ", "").replace("-", "").replace("_", "").isalpha() and not any(c.isupper() for c in value[1:])
    return 0.3 if plain else min(1.0, entropy / 3.5) * min(1.0, 0.5 + 0.2 * kinds)


def added_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """start, end, name, score of the literals that reach the threshold; of several names the best one (then by name)."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    weights: dict[str, float] = {}
    for target, literals in propagated(list(pairs(text))):
        weight = weights[target] if target in weights else weights.setdefault(target, name_weight(target))
        if weight >= threshold:
            score = weight * literal_weight("".join(part.value for part in literals))
            if score >= threshold:
                for part in literals:
                    if part.end > part.start:
                        place = part.start, part.end
                        best[place] = max(best.get(place, (0.0, "")), (round(score, 6), target))
    return sorted((start, end, name, score) for (start, end), (score, name) in best.items())


def spans(text: str, threshold: float = THRESHOLD) -> list[dict]:
    """All spans in order: kind, start, end, target (the literal's name), score (1 for the fixed patterns)."""
    base = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
    out = [{"kind": k, "start": s, "end": e, "target": None, "score": 1.0} for k, s, e in base]
    reach, at = 0, 0
    for start, end, name, score in added_spans(text, threshold):
        while at < len(base) and base[at][1] <= start:
            reach, at = max(reach, base[at][2]), at + 1
        if end > reach:
            out.append({"kind": "literal", "start": start, "end": end, "target": name, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string()), ("score", pa.float64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end, target, score>>."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([spans(t.as_py() or "", threshold) for t in batch.column(1)], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, target: string, score: double>>"
    return rows.mapInArrow(find, schema).withColumnRenamed("id", id_col)


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    rows = find_secrets(common.table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    counts = [of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of_kind("literal").alias("n_literal"))
