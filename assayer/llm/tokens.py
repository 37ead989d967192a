"""Token ids of whole texts by the tokenizers library, each distinct chunk between white space encoded once."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Between a visible character and white space no pre-token of either file format goes on, so a text's ids are its chunks' ids
# in order.  A text with rare white space, or with controls that are white space to Python only, is encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Where one of these stands, white space is more than single spaces and newlines; plain searches are faster than a pattern.
_MORE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f")
_CONTROLS = tuple("\x1c\x1d\x1e\x1f")
_SPACED = re.compile(r"\s*\S+|\s+")
# A word of Latin letters, after a space or not, and signs after it: one pre-token each in both file formats, so the model takes
# them as they are.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-įı-ž]+)([.,;:!?#$%&*|]*)")
LONGEST_KEPT = 64
_ID = attrgetter("id")
BLOCK_CHARS = 4_000_000


def _odd(text: str) -> bool:
    return any(map(text.__contains__, _CONTROLS)) if text.isascii() else _ODD.search(text) is not None


def _loose(text: str) -> bool:
    return any(map(text.__contains__, _MORE)) or text[-1] in " \n"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level files write bytes with: visible Latin-1 characters stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Known(dict):
    """Chunk -> ids of the chunks used last; those of the generation before are taken over when they come again."""

    def __init__(self, encode, old: dict):
        super().__init__()
        self.encode, self.old = encode, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids; about the ``keep`` chunks used last are remembered.

    ``spaces`` says whether white space is part of the vocabulary (byte-level files) or dropped (word-end files).
    """

    def __init__(self, path: str, spaces: bool, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds the name of a special token is encoded whole, by the library's default as one id
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.spaces, self.keep = self.tokenizer.model.tokenize, spaces, keep
        self.signs: dict[str, bytes] = {"": b""}
        self.newline = self._whole("\n")
        self.spaced = _Known(self._after_space, {})  # pieces between single spaces, each with the space before it
        self.chunks = _Known(self._chunk, {})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _after_space(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and len(piece) < LONGEST_KEPT:
            return array("I", map(_ID, self.tokenize(_LETTERS[32] + piece))).tobytes()
        if piece[0] == "\n":
            return self.newline + (self._chunk(piece[1:]) if len(piece) > 1 else b"")
        return self._chunk(" " + piece)

    def _chunk(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk) if len(chunk) <= LONGEST_KEPT else None
        if not m:
            return self._whole(chunk)
        word, signs = m.groups()
        after = self.signs.get(signs)
        if after is None:
            after = self._whole(signs)
            if len(self.signs) < 10_000:
                self.signs[signs] = after
        if not self.spaces:
            word = word.lower()
        elif signs and word[0] == " ":
            return self.spaced[word[1:]] + after  # a word is encoded once, whatever signs follow it
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        elif word[0] == " ":
            word = _LETTERS[32] + word[1:]
        return array("I", map(_ID, self.tokenize(word))).tobytes() + after

    def _alone(self, text: str) -> bool:
        return any(map(text.__contains__, self.special)) or _odd(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._alone(text):
            return self._whole(text)
        if not self.spaces:
            ids = b"".join(map(self.chunks.__getitem__, text.split()))
        elif _loose(text):
            ids = b"".join(map(self.chunks.__getitem__, _SPACED.findall(text)))
        else:  # a space or newline begins each chunk
            first, *rest = text.replace("\n", " \n").split(" ")
            ids = (self.chunks[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        self._turn()
        return ids

    def _turn(self) -> None:
        if len(self.spaced) + len(self.chunks) > self.keep // 2:
            self.spaced.old = self.chunks.old = {}
            self.spaced, self.chunks = _Known(self._after_space, self.spaced), _Known(self._chunk, self.chunks)

    def _block(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts of single spaces and newlines: each distinct piece is looked up once and its ids are copied to its places."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        ends, pieces = split.offsets.to_numpy(), split.flatten()
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        firsts = pieces.take(pa.array(ends[:-1])).to_numpy(zero_copy_only=False).tolist()  # no space before them
        ids = [self.spaced[w] if w else b"" for w in words] + [self.chunks[w] if w else b"" for w in firsts]
        at = coded.indices.to_numpy().astype(np.int64)
        at[ends[:-1]] = len(words) + np.arange(len(texts))
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, size = (np.cumsum(size) - size)[at], size[at]
        stop = np.cumsum(size)
        out = flat[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]))]
        self._turn()
        last = stop[ends[1:] - 1].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *last], last)]

    def many(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, by blocks where its white space allows; a text beyond BLOCK_CHARS is encoded by itself."""
        found: list[bytes] = [b""] * len(texts)
        block, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.spaces or len(text) > BLOCK_CHARS or self._alone(text) or _loose(text):
                found[i] = self.encode(text)
                continue
            block.append(i)
            chars += len(text)
            if chars > BLOCK_CHARS:
                self._fill(found, texts, block)
                block, chars = [], 0
        if block:
            self._fill(found, texts, block)
        return found

    def _fill(self, found: list[bytes], texts: Sequence[str], block: Sequence[int]) -> None:
        for i, ids in zip(block, self._block([texts[i] for i in block])):
            found[i] = ids

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        return map(self.encode, texts)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for a file; it outlives a task, so that its chunks are reused."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]
