"""Secret scan by assignment-aware lexing.

Source and configuration syntax is lexed into (name, literal) pairs: strings with escapes, triple quotes and backticks, bare
values, block scalars, here-documents, XML elements, and joins of these and of names.  A name that is assigned another name
takes that name's literal, from the nearest definition before or, if there is none, after it.  A literal is scored by how
sensitive the names are that it reaches and by how random it looks.  Three base patterns always count; what the lexing finds
beyond them is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, text_of

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 1.0

# The base patterns.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SHORTEST = {"assign": 6, "access": 20}
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.ASCII)

# Weights of the parts of a name that tell what is assigned to it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.8, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "private": 0.6, "access": 0.3, "auth": 0.6, "key": 0.5, "signing": 0.4,
             "encryption": 0.4, "client": 0.2, "bearer": 0.8, "dsn": 0.5, "cookie": 0.3, "session": 0.3}
HARMLESS = {"public", "file", "path", "name", "length", "count", "max", "min", "type", "url", "id", "field", "hash", "policy"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|sample|dummy|test|none|null|true|false|your[_-].*|<.*>|\$\{.*\}|%.*%)$")
# A run of name characters is tried once, at its start, however long it is.
_PAIR = re.compile(r"""
    (?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)["'`]?   # name, quoted or not
    [\x20\t]*+(?::=|=>|==?|:)[\x20\t]*+                                       # := => = :
  | <(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]*+)(?:\s[^<>]*+)?>(?P<body>[^<>]++)</(?P=tag)\s*>""", re.X)
_STRING = re.compile(r"""(?s)[bBfFrRuU]{0,2}(?:\"\"\"(?P<d3>.*?)\"\"\"|'''(?P<s3>.*?)'''|"(?P<d>(?:[^"\\\n]|\\[^\n])*+)"
    |'(?P<s>(?:[^'\\\n]|\\[^\n])*+)'|`(?P<b>(?:[^`\\]|\\.)*+)`)""", re.X)
_JOINED = re.compile(r"[\x20\t]*\+[\x20\t]*(?:\\?\n[\x20\t]*)?")
_JOINED_NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_.]*+)(?=[\x20\t]*\+[\x20\t]*["'`]|[\x20\t]+\+[\x20\t]+[A-Za-z_])""")
_NEXT_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
_BARE = re.compile(r"[A-Za-z0-9_./+=@:$%^&*~\-]+")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*\n")
_HERE = re.compile(r"<<[-~]?[\"']?(?P<end>[A-Za-z_]\w*)[\"']?[\x20\t]*\n")
_LINE = re.compile(r"([\x20\t]*)([^\n]*)(?:\n|\Z)")
_ESCAPE = re.compile(r"(?s)\\(.)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*$")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping per kind; places count code points."""
    out = []
    if _KEYWORD.search(text):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _SHORTEST["assign"]]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _SHORTEST["access"]]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How much a name tells of a secret: its best part, and a little of the others; harmless parts take away."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = name.lower().replace("_", "").replace("-", "")
    found = sorted((SENSITIVE[p] for p in parts if p in SENSITIVE), reverse=True)
    if "apikey" in joined or "accesskey" in joined or "privatekey" in joined:
        found.insert(0, 1.0)
    if not found:
        return 0.0
    return found[0] + 0.3 * sum(found[1:]) - 0.6 * sum(p in HARMLESS for p in parts)


def literal_score(value: str) -> float:
    """0 to 1: length, mixed character classes and entropy; placeholders and plain words give 0."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes < 2:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, entropy / 4) * min(1.0, n / 12) * (0.6 + 0.2 * min(classes, 3) - 0.2)


def plain_name(value: str) -> bool:
    """Whether a bare value reads as a variable's name: no digits but at the end of a part, and parts as long as words."""
    pieces = _PIECES.findall(value)
    return not re.search("[0-9]", re.sub("_[0-9]+(?=[_.]|$)", "", value)) and sum(map(len, pieces)) >= 3 * len(pieces)


class Literal(NamedTuple):
    places: tuple[tuple[int, int], ...]
    value: str
    quoted: bool = True


def _block(text: str, name_at: int, at: int) -> tuple[Literal, int]:
    """The lines from ``at`` that are indented more than the line of the name, and the end of the last one."""
    line = text.rfind("\n", 0, name_at) + 1
    indent = len(_LINE.match(text, line)[1])
    places = []
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2].strip() and len(m[1]) <= indent:
            break
        if m[2].strip():
            places.append((m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return Literal(tuple(places), "".join(text[a:b] for a, b in places)), at


def _here(text: str, m: re.Match) -> tuple[Literal, int] | None:
    """The lines of a here-document up to its end mark; None without an end."""
    end = re.compile(rf"^[\x20\t]*{m['end']}\b", re.M).search(text, m.end())
    if end is None:
        return None
    lines = [(n.start(2), n.start(2) + len(n[2].rstrip())) for n in _LINE.finditer(text, m.end(), end.start()) if n[2].strip()]
    return Literal(tuple(lines), "".join(text[a:b] for a, b in lines)), end.end()


def _operands(text: str, at: int) -> tuple[list[Literal | str], int]:
    """Strings and names (as str) joined by a sign or, strings, side by side, from ``at``; their end."""
    out: list[Literal | str] = []
    while True:
        if m := _STRING.match(text, at):
            group = m.lastgroup
            out.append(Literal((m.span(group),) if m[group] else (), _ESCAPE.sub(r"\1", m[group])))
        elif m := (_NEXT_NAME if out else _JOINED_NAME).match(text, at):
            out.append(m[0])
        else:
            return out, at
        at = m.end()
        plus = _JOINED.match(text, at)
        if plus:
            at = plus.end()
        else:
            side = at + len(text[at:at + 40]) - len(text[at:at + 40].lstrip(" \t"))
            if isinstance(out[-1], str) or not _STRING.match(text, side):
                return out, at
            at = side


def pairs(text: str) -> Iterator[tuple[str, list[Literal | str]]]:
    """(name, operands) of every assignment in order; an operand is a literal or the name of another constant."""
    at = 0
    while m := _PAIR.search(text, at):
        if m["tag"] is not None:
            body, at = m["body"].strip(), m.end("body")
            start = m.start("body") + m["body"].find(body) if body else at
            # elements within text, such as the markup of a page, are no configuration: one word only
            if body and not re.search(r"\s", body):
                yield m["tag"], [Literal(((start, start + len(body)),), body, False)]
            continue
        name, at = m["name"], m.end()
        held, end = _operands(text, at)
        if held:
            inner = isinstance(held[0], Literal) and len(held) == 1 and name_score(name) <= 0 and re.search("[=:]", held[0].value)
            at = at + 1 if inner else end  # a string of a harmless name may hold pairs itself
        elif n := _BLOCK.match(text, at):
            block, end = _block(text, m.start("name"), n.end())
            held, at = [block], end if name_score(name) > 0 else n.end()
        elif (n := _HERE.match(text, at)) and (found := _here(text, n)):
            held, at = [found[0]], found[1]
        elif n := _BARE.match(text, at):
            at = n.end()
            called = text[at:at + 1] in ("(", "[")
            if _NAME.match(n[0]):
                held = [n[0]] if not called else []
                if not called and not plain_name(n[0]):
                    held = [Literal((n.span(),), n[0], False), n[0]]  # a literal, unless a constant has that name
            else:
                held = [Literal((n.span(),), n[0], False)]
        else:
            continue
        yield name, held


def _joined(parts: list[Literal | None]) -> Literal | None:
    known = [p for p in parts if p is not None]
    if not known:
        return None
    return Literal(tuple(x for p in known for x in p.places), "".join(p.value for p in known), all(p.quoted for p in known))


def _either(held: list[Literal | str]) -> bool:
    return len(held) == 2 and isinstance(held[0], Literal) and not held[0].quoted and held[0].value == held[1]


def constants(text: str) -> list[tuple[str, Literal]]:
    """The names of a text with the literals they stand for; a name without a known literal is left out."""
    found = list(pairs(text))
    defined = {name for name, _ in found}
    # A bare value that may be either is a name if the text defines it.
    found = [(name, [held[held[1] in defined]] if _either(held) else held) for name, held in found]
    parts: list[list[Literal | None]] = []
    known: dict[str, Literal | None] = {}
    for name, held in found:
        parts.append([h if isinstance(h, Literal) else known.get(h) for h in held])
        known[name] = _joined(parts[-1])
    # Names used before they are defined: backwards, so that a chain of later definitions is known when it is met.
    later: dict[str, Literal] = {}
    for k in range(len(found) - 1, -1, -1):
        name, held = found[k]
        parts[k] = [later.get(h) if p is None else p for p, h in zip(parts[k], held)]
        if (whole := _joined(parts[k])) is not None:
            later[name] = whole
    return [(name, whole) for (name, _), own in zip(found, parts) if (whole := _joined(own)) is not None]


def _random_score(literal: Literal, told: float) -> float:
    """The literal's score; a long quoted one of a single class counts a little where the name alone tells of a secret."""
    own = literal_score(literal.value)
    if own == 0 and told >= 1 and literal.quoted and len(literal.value) >= 12 and not _PLACEHOLDER.match(literal.value):
        return 0.1 if len(set(literal.value)) >= 6 else 0.0
    return own


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals whose names, their own or one they are passed on to, tell of a secret."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    best: dict[tuple[int, int], float] = {}
    for name, literal in constants(text):
        if (told := name_score(name)) > 0 and (own := _random_score(literal, told)) > 0:
            for place in literal.places:
                best[place] = max(best.get(place, 0.0), told + own)
    return [Span("literal", a, b) for (a, b), s in best.items() if s >= threshold]


def find(text: str, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: lexed ones are added unless a base span covers them entirely."""
    base = base_spans(text)
    added = [s for s in lexed_spans(text, threshold) if not any(b.start <= s.start and s.end <= b.end for b in base)]
    order = lambda s: (s.start, KINDS.index(s.kind), s.end)
    return sorted(base, key=order), sorted(base + added, key=order)


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) put as ``mark``."""
    out, at, end = [], 0, 0
    for s in sorted(spans, key=lambda s: s.start):
        if s.start >= end or not out:
            out += [text[max(at, end):s.start], mark]
        at = end = max(end, s.end)
    return "".join(out) + text[end:]


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    Null texts are empty; repeated rows give a row each; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t, threshold) for t in b.column(1).to_pylist()]
            counts = [[sum(s.kind == k for s in base) for base, _ in found] for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([told(every) for _, every in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` put as ``mark``; null texts stay null, all other columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t in b.column(at).to_pylist():
                spans = find(t, threshold)[1] if t else []
                new.append(redact(t, spans, mark) if spans else t)
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
