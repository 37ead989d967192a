"""Token counts under a unigram vocabulary, with the forward scores of shared prefixes computed once.

The distinct pre-tokens of a block go into a trie (as sorted words, one stack of nodes); a node's forward score is the best
score of any segmentation of the letters down to it, and the terminal node of a pre-token stores its number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, text_of

SPACE = "▁"
CHARS_AT_ONCE = 2_000_000
KEPT = 300_000


def piece_scores(model: str) -> dict[str, float]:
    """Log probabilities of a sentencepiece file's pieces: its scores where they are log probabilities, else, for a file whose
    scores are merge ranks, minus log of the rank (Zipf's law)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    own = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
           if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if min(own.values(), default=0) < -100:
        order = sorted(own, key=lambda p: (-own[p], p))
        norm = math.log(math.fsum(1 / (k + 2) for k in range(len(order))) or 1)
        own = {p: -math.log(k + 2) - norm for k, p in enumerate(order)}
    return own


class Vocabulary:
    """Pieces by their last letters, so that a node looks up only lengths that some piece there has."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        lengths: dict[str, set[int]] = {}
        for p in scores:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.single = {k for k in scores if len(k) == 1}
        self.unknown = min(scores.values(), default=0.0) - 10.0  # per byte of a letter that no piece has

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word under its best segmentation; of equal scores the fewer tokens, then the longer last piece."""
        out: dict[str, int] = {}
        best, used = [0.0], [0]  # forward score and tokens of the path's nodes
        path = ""
        scores, lengths, single = self.scores, self.lengths, self.single
        for word in sorted(words):
            same = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                same += 1
            del best[same + 1:], used[same + 1:]
            for j in range(same + 1, len(word) + 1):
                letter = word[j - 1]
                if letter in single:
                    top, n = best[j - 1] + scores[letter], used[j - 1] + 1
                else:
                    size = len(letter.encode("utf-8", "surrogatepass"))
                    top, n = best[j - 1] + size * self.unknown, used[j - 1] + size
                if j > 1:
                    for k in lengths.get(word[j - 2:j], ()):
                        if k > j:
                            break
                        s = scores.get(word[j - k:j])
                        if s is not None:
                            s += best[j - k]
                            m = used[j - k] + 1
                            if s > top or s == top and m <= n:
                                top, n = s, m
                best.append(top)
                used.append(n)
            path = word
            out[word] = used[len(word)]
        return out


_vocabularies: dict[str, tuple[Vocabulary, dict[str, int]]] = {}


def _vocabulary(model: str) -> tuple[Vocabulary, dict[str, int]]:
    if model not in _vocabularies:
        _vocabularies[model] = (Vocabulary(piece_scores(model)), {})
    return _vocabularies[model]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; pre-tokens are the words between white space, each after a word mark.

    Null and empty texts have none; repeated rows give a row each; other columns are not read.  A worker remembers the
    counts of at most KEPT pre-tokens; a block of texts brings its own on top.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _vocabulary(model)

        def flush(ids: list, words: list[list[str]]) -> pa.RecordBatch:
            new = [w for w in set().union(*words) if w not in known]
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list(set().union(*words))
            marked = vocabulary.counts([SPACE + w for w in new])
            known.update((w, marked[SPACE + w]) for w in new)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([sum([known[x] for x in w]) for w in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

        for b in batches:
            ids, words, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc)
                words.append(text.split())
                size += len(text)
                if size >= CHARS_AT_ONCE:
                    yield flush(ids, words)
                    ids, words, size = [], [], 0
            if ids:
                yield flush(ids, words)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
