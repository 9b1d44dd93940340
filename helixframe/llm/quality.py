"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of ``CHUNK`` bytes that overlap by a filter's reach, so that every window of 8 bytes (at
steps of 4) of the whole document lies in a chunk.  Each byte has a learned embedding and a flag that tells whether the
8 bytes up to it repeat those 3 to 24 bytes before (runs of the same word); learned filters run over the windows, their
largest responses are pooled over each chunk, the chunks' maxima and means are combined by a hidden layer into one
probability.

Training and scoring read every chunk of a text.  Training takes whole labelled documents, up to ``per_label`` of each label
and until their texts reach ``max_bytes``.

Defined results: a null or empty text is one chunk of padding and gets the score the network gives to that; without both
classes in the training rows the score is the share of label 1 (0.5 without rows); repeated rows get equal scores; an
empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_key, slices, text_rows, training_sample, utf8

CHUNK, STEP, EMBED, FILTERS, HIDDEN = 512, 4, 7, 24, 16
BLOCK = 1024  # chunks that are cut at a time
LAGS = range(3, 25)
PER_LABEL, MAX_BYTES = 1500, 8 << 20  # training documents of a label


def chunk_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all documents (rows of CHUNK + STEP bytes, zeros behind the end) and each one's document."""
    sizes = np.diff(offs)
    n = np.maximum(1, -(-sizes // CHUNK))
    doc = np.repeat(np.arange(len(sizes)), n)
    no = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    x = np.zeros((len(doc), CHUNK + STEP), np.uint8)
    for i in range(0, len(doc), BLOCK):  # positions take eight times the room of the bytes
        own = doc[i:i + BLOCK]
        at = (offs[own] + no[i:i + BLOCK] * CHUNK)[:, None] + np.arange(CHUNK + STEP)
        inside = at < offs[own + 1][:, None]
        x[i:i + BLOCK][inside] = data[at[inside]]
    return x, doc


def repeats(x: np.ndarray) -> np.ndarray:
    """Whether the 8 bytes up to a byte are those of 3 to 24 bytes before."""
    out = np.zeros(x.shape, bool)
    for d in LAGS:
        e = (x[:, d:] == x[:, :-d]) & (x[:, d:] != 0)
        e = e[:, 1:] & e[:, :-1]
        e = e[:, 2:] & e[:, :-2]
        out[:, d + 7:] |= e[:, 4:] & e[:, :-4]
    return out


@dataclass
class QualityModel:
    embed: np.ndarray   # 256 x EMBED
    filters: np.ndarray  # STEP * (EMBED + 1) x 2 FILTERS: the first and the second half of each window
    bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None

    def planes(self, x: np.ndarray) -> np.ndarray:
        """Input rows of STEP bytes each."""
        table = np.zeros((512, EMBED + 1), np.float32)
        table[:256, :EMBED] = table[256:, :EMBED] = self.embed
        table[256:, EMBED] = 1
        z = np.take(table, x + repeats(x).astype(np.int64) * 256, axis=0, mode="clip")
        return z.reshape(len(x), -1, STEP * (EMBED + 1))

    def responses(self, z: np.ndarray) -> np.ndarray:
        """Filter responses at each window: chunks x windows x FILTERS."""
        p = (z.reshape(-1, z.shape[2]) @ self.filters).reshape(len(z), -1, 2 * FILTERS)
        return p[:, :-1, :FILTERS] + p[:, 1:, FILTERS:] + self.bias

    def combine(self, pooled: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and means of the chunks' pooled responses, and the logits."""
        first = np.searchsorted(doc, np.arange(n))
        f = np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / np.bincount(doc, minlength=n)[:, None]], axis=1)
        h = np.tanh(f @ self.hidden + self.hidden_bias)
        return np.concatenate([f, h], axis=1), h @ self.out + self.out_bias

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text."""
        n = len(column)
        if self.constant is not None or not n:
            return np.full(n, self.constant if self.constant is not None else 0.5)
        data, offs = utf8(column)
        x, doc = chunk_bytes(data, offs)
        pooled = np.concatenate([np.maximum(self.responses(self.planes(x[i:i + 256])).max(1), 0) for i in range(0, len(x), 256)])
        _, logit = self.combine(pooled, doc, n)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def fit(texts: list[str], labels: list[int], *, epochs: int = 5, steps: int = 300, batch: int = 64,
        rate: float = 0.01, seed: int = 11, prior: float | None = None) -> QualityModel:
    """Train with Adam over ``epochs``, or as many as make ``steps``; the gradient of a pooled response goes to the window it
    came from.  ``prior``: the share of label 1 where scores will be given (that of the sample if None)."""
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-steps * batch // max(1, len(labels))))
    y = np.array(labels, np.float32)
    blank = QualityModel(np.zeros((256, EMBED), np.float32), np.zeros((STEP * (EMBED + 1), 2 * FILTERS), np.float32),
                         np.zeros(FILTERS, np.float32), np.zeros((2 * FILTERS, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32),
                         np.zeros(HIDDEN, np.float32), 0.0)
    if len(set(labels)) < 2:
        blank.constant = float(y.mean()) if len(y) else 0.5
        return blank
    data, offs = utf8(pa.array(texts, pa.large_string()))
    x, doc = chunk_bytes(data, offs)
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    model = QualityModel(rng.normal(0, 1, (256, EMBED)).astype(np.float32), rng.normal(0, 0.15, blank.filters.shape).astype(np.float32),
                         np.zeros(FILTERS, np.float32), rng.normal(0, 0.15, blank.hidden.shape).astype(np.float32), np.zeros(HIDDEN, np.float32),
                         rng.normal(0, 0.3, HIDDEN).astype(np.float32), 0.0)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    names = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")
    m, v, t = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), 0
    half = STEP * (EMBED + 1)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            docs = order[i:i + batch]
            own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            d = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            z = model.planes(x[own])
            r = model.responses(z)
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None], 1)[:, 0]
            pooled = np.maximum(top, 0)
            fh, logit = model.combine(pooled, d, len(docs))
            f, h = fh[:, :2 * FILTERS], fh[:, 2 * FILTERS:]
            g = weight[docs] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[docs]) / len(docs)
            grad = {"out": h.T @ g, "out_bias": g.sum()}
            gh = g[:, None] * model.out * (1 - h * h)
            grad["hidden"], grad["hidden_bias"] = f.T @ gh, gh.sum(0)
            gf = gh @ model.hidden.T
            counts = np.bincount(d, minlength=len(docs))[:, None]
            gp = gf[d, :FILTERS] * (pooled == f[d, :FILTERS]) + (gf[:, FILTERS:] / counts)[d]
            gp = (gp * (top > 0)).astype(np.float32)
            c = np.arange(len(own))[:, None]
            left, right = z[c, at], z[c, at + 1]  # chunks x FILTERS x half
            grad["bias"] = gp.sum(0)
            grad["filters"] = np.concatenate([np.einsum("cf,cfk->kf", gp, left), np.einsum("cf,cfk->kf", gp, right)], axis=1)
            ge = np.zeros((256, EMBED), np.float32)
            for side, w in ((0, model.filters[:, :FILTERS]), (1, model.filters[:, FILTERS:])):
                back = (gp[:, :, None] * w.T[None]).reshape(len(own), FILTERS, STEP, EMBED + 1)[..., :EMBED]
                byte = x[own][c[:, :, None], (at + side)[:, :, None] * STEP + np.arange(STEP)]
                for e in range(EMBED):
                    ge[:, e] += np.bincount(byte.ravel(), weights=back[..., e].ravel(), minlength=256)
            grad["embed"] = ge
            t += 1
            step = rate * (1 - 0.8 * epoch / epochs)
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.99 * v[k] + 0.01 * grad[k] ** 2
                move = step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)
                setattr(model, k, getattr(model, k) - (move.astype(np.float32) if k != "out_bias" else float(move)))
    assert half == model.filters.shape[0]
    # The classes weighed the same in training; the shift makes the score a probability under the classes' shares.
    prior = share if prior is None else prior
    model.out_bias = float(model.out_bias + np.log(prior / (1 - prior)))
    return model


def fit_table(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *,
              per_label: int = PER_LABEL, max_bytes: int = MAX_BYTES) -> QualityModel:
    """Train on documents that have a label 0 or 1 (a null text is empty); the driver receives the bounded sample and the number of
    documents of each label."""
    label = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and of is not null").distinct()
    t = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("h", sample_key(F.col("doc_id"), F.col("text")))
    rows = t.select("doc_id", "h", F.octet_length("text").alias("bytes")).join(label, F.col("doc_id") == F.col("of"))
    rows, counts = training_sample(rows, t, "y", per_label, max_bytes)
    total = sum(counts.values())
    return fit([text for text, _ in rows], [y for _, y in rows], prior=counts.get(1, 0) / total if total else None)


def probability(text: Column, model: QualityModel) -> Column:
    """Probability of label 1 of a text column."""

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [model.score(p.column(0)) for p in slices(pa.record_batch([column], names=["text"]), limit=1 << 19, rows=2048)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run.asNondeterministic()(text)


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted (1 if the score is 0.5 or more)."""
    t = text_rows(docs, id_col, text_col)
    return t.select("doc_id", probability(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
