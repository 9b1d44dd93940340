"""Tokenise whole text columns: each distinct piece of text between safe cut points is encoded once.

A tokenizer with a word-splitting pre-tokenizer never joins text across certain points: before a space or line feed
that follows a printable character, and between a letter and a full stop or comma.  Text is cut there (as
offsets into the Arrow buffer, no copy), the distinct pieces of a slice are encoded by the tokenizers library, and the ids
are put back in text order.  Tests compare the result with encoding the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import utf8

CACHE_BYTES = 112 << 20  # of the pieces and ids that a worker remembers; above it the memory is emptied and filled anew
ENTRY_BYTES = 170  # of a piece beside its own bytes: two byte strings and their place in the dictionary

WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # ASCII and Latin-1 letters
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on.
OTHERS = [b for b in range(256) if b not in PRINTED]
BYTE_CHARS = "".join(chr(b if b in PRINTED else 256 + OTHERS.index(b)) for b in range(256))
BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x0A, 0x2E, 0x2C]] = True


def cut_points(data: np.ndarray) -> np.ndarray:
    """The byte positions before which a cut is safe, ascending."""
    at = np.flatnonzero(BREAK[data])
    at = at[at > 0]
    b, prev, lead = data[at], data[at - 1], data[np.maximum(at - 2, 0)]
    cont = (prev >= 0x80) & (prev < 0xC0) & (at > 1)
    two = cont & (lead >= 0xC3) & (lead <= 0xDF)  # the character before is U+00C0..U+07FF: none is white space
    latin = cont & (lead == 0xC3) & (prev != 0x97) & (prev != 0xB7)  # it is a letter U+00C0..U+00FF
    letter = ((prev >= 0x41) & (prev <= 0x5A)) | ((prev >= 0x61) & (prev <= 0x7A)) | latin
    white = (b == 0x20) | (b == 0x0A)
    return at[np.where(white, ((prev > 0x20) & (prev < 0x7F)) | two, letter)]


class TextEncoder:
    """Token ids of text columns with the tokenizer file at ``path``.

    ``plain_specials``: treat the strings of special tokens in a text as ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.known: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the memory, about
        self._word = self._word_model()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows (null: none) as uint32, and each row's offset in them."""
        data, offs = utf8(column)
        starts = np.sort(np.concatenate([cut_points(data), offs[:-1][np.diff(offs) > 0]]), kind="stable")
        starts = starts[np.diff(starts, prepend=-1) > 0]
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        enc = pieces.dictionary_encode()
        index = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, at = self._pieces(enc.dictionary.to_pylist())
        size = np.diff(at)[index]
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        flat = ids[np.repeat(at[:-1][index] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[np.searchsorted(starts, offs)]

    def _word_model(self):
        """How to give a piece that is one word of Latin letters to the model without the pipeline around it.

        Only for byte-level tokenizers, and only if it gives the pipeline's ids for a list of words; else None.
        """
        spec = json.loads(self.tokenizer.to_str())
        kinds = re.findall(r'"type":\s*"(\w+)"', json.dumps([spec["normalizer"], spec["pre_tokenizer"]]))
        if "ByteLevel" not in kinds:
            return None
        lower, strip = "Lowercase" in kinds, "Split" in kinds
        model = self.tokenizer.model

        def ids(piece: bytes) -> bytes:
            if strip:
                piece = piece.lstrip(b" ")
            if lower:
                piece = piece.decode().lower().encode()
            return array("I", [t.id for t in model.tokenize(piece.decode("latin-1").translate(BYTE_CHARS))]).tobytes()

        words = ["a", " a", "The", " the", " Zebra", "naïve", " ÉTÉ", " straße", " ÿ", "xqzjk", " internationalization", " Ñandú"]
        same = all(ids(w.encode()) == array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words)
        return ids if same else None

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        new = [t for t in texts if t not in self.known]
        self.held += sum(map(len, new)) * 2 + len(new) * ENTRY_BYTES  # ids take about as much as the text
        if self._word:
            rest = []
            for t in new:
                if WORD.fullmatch(t):
                    self.known[t] = self._word(t)
                else:
                    rest.append(t)
            new = rest
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            for t, e in zip(part, self.tokenizer.encode_batch_fast([t.decode() for t in part], add_special_tokens=False), strict=True):
                self.known[t] = array("I", e.ids).tobytes()
        got = [self.known[t] for t in texts]
        at = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(g) >> 2 for g in got], out=at[1:])
        return np.frombuffer(b"".join(got), np.uint32), at


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> TextEncoder:
    """The encoder of this Python worker."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, plain_specials)
    return _ENCODERS[key]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of the tokenizer at ``path``, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def with_end(flat: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new offsets."""
    n = len(offs) - 1
    new = offs + np.arange(n + 1)
    out = np.full(len(flat) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = flat
    return out, new
