"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters, accents and digits put for letters to plain letters.  The lexicon is learnt from labelled
documents: whole words, and word beginnings that stand for several words, each weighed by the log-odds of its document counts
in toxic and other documents.  Phrases of two words around an entry that are common in documents that are not toxic are
exceptions.  A document's score is a logistic function of its matched weight, plain and over its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, stored, text_of

TRAIN_ROWS = 16_000
THRESHOLD = 0.3
MARGIN = 1.0
SHORTEST, LONGEST = 4, 8  # letters of a word beginning

# Letters of other scripts that look like Latin ones, and characters put for letters.
_LOOKALIKE = dict(zip("аеорсухкмнтвіјѕԁԛѡ" + "αβεικνορτυχωγ", "aeopcyxkmhtbijsdqw" + "abeikvoptuxwy"))
_DIGITS = dict(zip("0134578", "oieastb"))
_SIGNS = dict(zip("@$!", "asi"))
_TABLE = str.maketrans(_LOOKALIKE | _DIGITS | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})
_SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])|(?<![^\W_])[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms and accents undone, look-alikes, digits and signs within words as letters."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN_IN_WORD.sub(lambda m: _SIGNS[m[0]], text)
    return text.translate(_TABLE)


class Lexicon(NamedTuple):
    """``terms``: entry -> weight, an entry that ends in '*' being a word beginning; ``exceptions``: two-word phrases."""

    terms: dict[str, float]
    exceptions: frozenset[str]
    coefficients: tuple[float, float, float]


class Matcher:
    """Finds lexicon entries at word bounds in folded text."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.exceptions, self.any = lexicon.exceptions, bool(lexicon.terms)
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            start = term.endswith("*")
            word = term.rstrip("*")
            known = self.automaton.get(word, None) or [word, None, None]
            known[1 + start] = weight
            self.automaton.add_word(word, known)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end of the word, weight), one per word: of several entries the heaviest."""
        if not self.any:
            return []
        best: dict[int, tuple[int, float]] = {}
        for last, (word, whole, start) in self.automaton.iter(folded):
            first = last - len(word) + 1
            if first and folded[first - 1].isalpha():
                continue
            weight = start
            if whole is not None and not folded[last + 1:last + 2].isalpha():
                weight = whole if start is None else max(whole, start)
            if weight is not None and (first not in best or best[first][1] < weight):
                end = last + 1
                while end < len(folded) and folded[end].isalpha():
                    end += 1
                best[first] = (end, weight)
        return [(a, b, w) for a, (b, w) in sorted(best.items())]

    def weighed(self, folded: str) -> tuple[float, int]:
        """Sum of the weights outside exception phrases, and the number of hits that count."""
        found = self.hits(folded)
        if found and self.exceptions:
            found = [h for h in found if self.exceptions.isdisjoint(phrases(folded, h[0], h[1]))]
        return sum(w for _, _, w in found), len(found)

    def matched(self, folded: str) -> set[str]:
        """All entries that stand in a text outside exception phrases."""
        out = set()
        for first, end, _ in self.hits(folded):
            if self.exceptions.isdisjoint(phrases(folded, first, end)):
                word = folded[first:end]
                for entry in (word[:k] for k in range(1, len(word) + 1)):
                    known = self.automaton.get(entry, None)
                    if known and known[1] is not None and entry == word:
                        out.add(word)
                    if known and known[2] is not None:
                        out.add(entry + "*")
        return out


def phrases(folded: str, first: int, end: int) -> list[str]:
    """The entry's word with the word before it, and with the word after it."""
    word = folded[first:end]
    before = _WORD.findall(folded[max(0, first - 40):first])
    after = _WORD.search(folded[end:end + 40])
    return ([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def train_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out: int = 2) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents, half of them of each label, those of the smallest hash.

    A document whose crc32(doc_id as text) mod 4 is ``held_out`` is never among them, nor is one with a null id or label.
    The sample of keys is bounded, so it is broadcast.
    """
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("__toxic"))
           .where((fold_number(F.col("doc_id")) != held_out) & F.col("__toxic").isin(0, 1)))
    picked = [own.where(F.col("__toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows // 2) for y in (0, 1)]
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("__text"))
            .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("__text", "__toxic"))


def fold_number(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _counted(rows: DataFrame, keys_of, least: int = 1) -> Counter:
    """(key, toxic documents, other documents) over rows; tasks add up before the shuffle, rare keys stay there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (yes if toxic else no).update(keys_of(fold(text)))
        keys = list(yes)
        for k in range(0, len(keys), 50_000):
            own = keys[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([yes[x] for x in own]), pa.array([no[x] for x in own])],
                                             names=["key", "yes", "no"])
        keys = [k for k in no if k not in yes]
        for k in range(0, len(keys), 50_000):
            own = keys[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([0] * len(own), pa.int64()), pa.array([no[x] for x in own])],
                                             names=["key", "yes", "no"])

    return (rows.mapInArrow(run, "key string, yes long, no long").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
            .where((F.col("yes") >= least) | (F.col("key") == "")))


def _terms(folded: str) -> set[str]:
    out = {""}
    for w in set(_WORD.findall(folded)):
        if len(w) >= 3:
            out.add(w)
            out.update(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def learn(rows: DataFrame, bound: float = 2.0, open_bound: float = 0.5) -> Lexicon:
    """The lexicon of ``rows`` (a bounded sample, see ``train_rows``).

    Entries whose log-odds reach ``open_bound`` (all bounds hold for the lower 95 % limit) are candidates; phrases around them
    that other documents have rather than toxic ones are exceptions; without those a candidate must reach ``bound``.  A word
    beginning is taken only where it covers clearly more toxic documents than any word or longer beginning under it, an
    entry only where enough toxic documents have none that is heavier by MARGIN.  Without rows of both labels the lexicon is empty.
    """
    rows = stored(rows, "train")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy(F.col("__toxic").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    if not yes or not no:
        base = 0.02 if not yes else 0.98
        return Lexicon({}, frozenset(), (math.log(base / (1 - base)), 0.0, 0.0))

    def weight(a: int, b: int) -> float:
        return math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1))

    def lower(a: int, b: int) -> float:
        return weight(a, b) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    least = max(5, yes // 200)  # so at most some tens of thousands of entries come back, whatever the corpus
    counts = {r["key"]: (r["yes"], r["no"]) for r in _counted(rows, _terms, least).collect() if r["key"]}
    matcher = Matcher(Lexicon({k: 1.0 for k, n in counts.items() if lower(*n) >= open_bound}, frozenset(), (0, 0, 0)))
    near = _counted(rows, lambda f: {p for a, b, _ in matcher.hits(f) for p in phrases(f, a, b)}, 0)
    matcher.exceptions = frozenset(r["key"] for r in near.where("no >= 5").collect() if r["key"] and weight(r["yes"], r["no"]) < 0)
    found = {r["key"]: (r["yes"], r["no"]) for r in _counted(rows, matcher.matched, least).collect() if r["key"]}
    good = {k: weight(*n) for k, n in found.items() if lower(*n) >= bound}
    terms: dict[str, float] = {}
    for k in sorted(good, key=lambda k: (len(k), k)):
        stem = k.rstrip("*")
        if any(stem.startswith(t[:-1]) for t in terms if t.endswith("*")):
            continue
        if k.endswith("*"):
            under = max((n[0] for x, n in found.items() if x != k and x.rstrip("*").startswith(stem)
                         and (not x.endswith("*") or len(x) > len(k))), default=0)
            if found[k][0] < 1.15 * under:
                continue
        terms[k] = good[k]
    # words of a text that comes in many copies look telling too; an entry stays if no much heavier one stands in enough of its toxic documents
    every = Matcher(Lexicon(terms, matcher.exceptions, (0, 0, 0)))

    def telling(folded: str) -> set[str]:
        own = every.matched(folded)
        top = max((terms[t] for t in own), default=0.0)
        return {t for t in own if terms[t] >= top - MARGIN}

    first = {r["key"] for r in _counted(rows, telling, least).collect() if lower(r["yes"], r["no"]) >= bound}
    terms = {t: w for t, w in terms.items() if t in first}
    kept = Matcher(Lexicon(terms, frozenset(), (0, 0, 0)))
    exceptions = frozenset(p for p in matcher.exceptions if kept.hits(p))
    lexicon = Lexicon(terms, exceptions, (0, 0, 0))
    return lexicon._replace(coefficients=_fit(rows, lexicon))


def _fit(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """A ridge logistic fit on the two features of the bounded sample, by Newton's method."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            x = [features(matcher.weighed(fold(t))[0], len(t.split())) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in x], pa.float64()) for k in (0, 1)] + [b.column(1)], names=["a", "b", "y"])

    got = rows.mapInArrow(run, "a double, b double, y int").groupBy("a", "b", "y").count().collect()
    x = np.array([(1.0, r["a"], r["b"]) for r in got])
    y, n = np.array([float(r["y"]) for r in got]), np.array([float(r["count"]) for r in got])
    c = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * n.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ c))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ c)
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in c)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of every whole text; null texts are empty; null ids stay and are not held out."""
    small_batches(docs.sparkSession)
    a, b, c = lexicon.coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(2).to_pylist():
                total, n = matcher.weighed(fold(text))
                x, y = features(total, len(text.split()))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y)))))
                hits.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array(hits, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "hits"])

    ids = F.col("doc_id").cast("long")
    return (docs.select(ids.alias("doc_id"), F.coalesce(fold_number(ids) == 2, F.lit(False)).alias("held_out"), text_of().alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits long"))
