"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary n-gram classifier (logistic regression on hashed byte trigrams)
is trained for each bit.  A text is decoded to the codeword whose bits have the least total loss under the classifiers'
margins, each bit weighted by how reliable its classifier was in training.  The gap to the second-nearest codeword tells
whether the answer is ambiguous.

Training takes whole texts, up to ``per_lang`` of each language that occurs and until they reach ``max_bytes`` of it; prediction
reads whole texts.

Defined results: a null text or one without any letter gets ``und`` with score 0 and is ambiguous; without a labelled row
all texts get ``und``; with one language all texts with a letter get it with score 1; repeated rows are each predicted;
an empty table gives no rows; only id, text and (for training) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, sample_key, slices, text_rows, training_sample, utf8

DIMS = 1 << 13
PER_LANG, MAX_BYTES = 700, 4 << 20  # training texts of a language
UNKNOWN = "und"
RESULT = "struct<lang_pred:string, score:double, ambiguous:boolean, runner_up:string>"
FORM = UPPER.copy()  # lower case; everything in ASCII that is no letter becomes a space
FORM[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
LETTER = regex.compile(r"\p{L}")  # by category: numerals such as \u2167 or \u00bd are no letters


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, one row per document."""
    n = len(offs) - 1
    x = FORM[data].astype(np.uint32)
    x = np.concatenate([x, np.full(2, 0x20, np.uint32)])
    h = ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)).astype(np.int64)
    d = np.repeat(np.arange(n), np.diff(offs))
    keep = np.ones(len(data), bool)  # no trigram spans two documents
    for back in (1, 2):
        at = offs[1:] - back
        keep[at[at >= offs[:-1]]] = False
    counts = np.bincount(d[keep] * DIMS + h[keep], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all splits of up to five languages, otherwise random balanced
    columns, of several draws the one with the largest least distance."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        cols = [[1 if i == 0 else (1 if c >> (i - 1) & 1 else -1) for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.float32).T
    rng, bits, best, far = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        base = np.where(np.arange(n) % 2, 1, -1)
        code = np.stack([rng.permutation(base) for _ in range(bits)], axis=1).astype(np.float32)
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray     # languages x bits, rows sum to 1
    gap: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score, whether it is ambiguous, and the second nearest."""
        n, k = len(margins), len(self.languages)
        if k < 2:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool), np.zeros(n, int)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        total = (loss * self.trust[None]).sum(2)
        order = np.argsort(total, axis=1, kind="stable")
        best, second = order[:, 0], order[:, 1]
        p = np.exp(-(total - total.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        rows = np.arange(n)
        return best, p[rows, best], total[rows, second] - total[rows, best] < self.gap, second

    def predict(self, column: pa.Array) -> pa.Array:
        data, offs = utf8(column)
        letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
        known = letters[offs[1:]] > letters[offs[:-1]]
        for i in np.flatnonzero(~known & (np.diff(offs) > 0)):
            known[i] = bool(LETTER.search(data[offs[i]:offs[i + 1]].tobytes().decode()))
        known &= bool(self.languages)
        if self.languages:
            best, score, ambiguous, second = self.decode(features(data, offs) @ self.weights + self.bias)
            names = np.array(self.languages, object)
            best, second = names[best], names[second]
        else:
            n = len(column)
            best = second = np.full(n, UNKNOWN, object)
            score, ambiguous = np.zeros(n), np.ones(n, bool)
        return pa.StructArray.from_arrays(
            [pa.array(np.where(known, best, UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0)),
             pa.array(ambiguous | ~known), pa.array(np.where(known, second, UNKNOWN), pa.string())],
            names=["lang_pred", "score", "ambiguous", "runner_up"])


def fit(texts: list[str], langs: list[str], *, rounds: int = 40, rate: float = 0.5, decay: float = 1e-5, gap: float = 0.25) -> LanguageModel:
    """Train the classifiers of all bits together by gradient descent with Adam."""
    names = sorted(set(langs))
    code = codebook(len(names))
    bits = code.shape[1]
    if not bits:
        return LanguageModel(names, code, np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32), np.ones((len(names), 0)), gap)
    data, offs = utf8(pa.array(texts, pa.large_string()))
    x = np.concatenate([features(data[offs[i]:offs[min(i + 256, len(texts))]], offs[i:min(i + 256, len(texts)) + 1] - offs[i])
                        for i in range(0, len(texts), 256)])
    which = np.array([names.index(v) for v in langs])
    y = code[which]
    share = np.bincount(which, minlength=len(names)) / len(which)
    per = (1 / (len(names) * share[which]))[:, None].astype(np.float32)  # each language weighs the same
    w, b = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = -y * per / (1 + np.exp(y * (x @ w + b))) / len(x)
        gw = x.T @ g + decay * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        b -= rate * g.sum(0)
    right = (np.sign(x @ w + b) == y)
    trust = np.array([[max(right[which == i, j].mean(), 0.01) for j in range(bits)] for i in range(len(names))])
    return LanguageModel(names, code, w, b, trust / trust.sum(1, keepdims=True), gap)


def fit_table(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", *,
              per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES) -> LanguageModel:
    """Train on the rows of ``docs`` that have a language and a text: whole texts, up to ``per_lang`` of each language that occurs and
    until they reach ``max_bytes`` of it.  The driver receives that bounded sample."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    t = t.where("lang is not null and text is not null").select(sample_key(F.col("doc_id"), F.col("text")).alias("h"), "text", "lang")
    rows, _ = training_sample(t.select("h", F.octet_length("text").alias("bytes"), "lang"), t, "lang", per_lang, max_bytes)
    return fit([text for text, _ in rows], [lang for _, lang in rows])


def predict(text: Column, model: LanguageModel) -> Column:
    """Struct column (``RESULT``) of a text column."""

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [model.predict(p.column(0)) for p in slices(pa.record_batch([column], names=["text"]), limit=1 << 20, rows=256)]
            yield pa.concat_arrays(parts) if parts else model.predict(column)

    return run.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous, runner_up."""
    t = text_rows(docs, id_col, text_col)
    return t.select("doc_id", predict(F.col("text"), model).alias("r")).select("doc_id", "r.*")
