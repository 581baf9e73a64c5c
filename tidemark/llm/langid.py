"""Language identification with a byte convolutional network.

A window of `LENGTH` bytes goes through filters of several widths (a filter's response at a place is the sum
of a weight for each byte under it), the maximum of each filter over the window, and a softmax layer. The
network is trained in numpy on a bounded sample of labelled windows; a text's windows cover all of it, and
their mean scores give its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .ppm import remainder

LENGTH, FILTERS, SIZES = 256, 8, (2, 3, 4)
#: The sample: documents of each language (at most, and in expectation), and windows of each document.
DOCS_EACH, WINDOWS_EACH = 400, 6
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 7
UNKNOWN = "und"
#: Windows that go through the network at once.
AT_ONCE = 64
#: A letter, as for fit(): signs such as superscripts, fractions and Roman numerals are none.
LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> np.ndarray:
    """All of data as rows of LENGTH bytes; the last is filled up with zeros, or starts earlier if data has room."""
    x = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(x) // LENGTH))
    out = np.zeros((n, LENGTH), np.uint8)
    out.reshape(-1)[: len(x)] = x
    if n > 1:
        out[-1] = x[-LENGTH:]
    return out


class Network:
    def __init__(self, classes: list[str], rng: np.random.Generator):
        self.classes = classes
        self.filters = [rng.normal(0, 0.3, (size, 256, FILTERS)).astype(np.float32) for size in SIZES]
        self.bias = np.zeros(len(SIZES) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, (len(SIZES) * FILTERS, len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, (window, place, filter)."""
        out = []
        for w in self.filters:
            places = x.shape[1] - len(w) + 1
            total = w[0].take(x[:, :places], axis=0)
            for k in range(1, len(w)):
                total += w[k].take(x[:, k : k + places], axis=0)
            out.append(total)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([r.max(axis=1) for r in self.responses(x)], axis=1) + self.bias, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[at : at + AT_ONCE]) @ self.dense + self.offset for at in range(0, len(x), AT_ONCE)])

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; a maximum passes its gradient to the bytes under the place that gave it."""
        params = [*self.filters, self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                own = order[at : at + BATCH]
                grads = self.gradients(x[own], y[own])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        maps = self.responses(x)
        best = [r.argmax(axis=1) for r in maps]
        raw = np.concatenate([np.take_along_axis(r, b[:, None, :], axis=1)[:, 0] for r, b in zip(maps, best, strict=True)], axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ self.dense + self.offset)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.dense.T) * (raw > 0)
        out = []
        rows = np.arange(len(x))[:, None]
        for k, (w, b) in enumerate(zip(self.filters, best, strict=True)):
            g = np.zeros_like(w)
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(w)):
                np.add.at(g[j], (x[rows, b + j], np.arange(FILTERS)[None, :]), part)
            out.append(g)
        return [*out, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their classes, and the classes, of up to about DOCS_EACH documents for each language.

    Documents are drawn by a hash of their text, at a rate for each language that its count sets; their
    windows lie evenly over the whole text. What reaches the driver is bounded by DOCS_EACH * WINDOWS_EACH * LENGTH
    bytes for each language.
    """
    langs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*(F.lit(v) for lang, n in sorted(langs.items()) for v in (lang, min(1.0, DOCS_EACH / n))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs_, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = windows(text.encode("utf-8", "surrogatepass"))
                for k in sorted({int(i) for i in np.linspace(0, len(own) - 1, WINDOWS_EACH)}):
                    langs_.append(lang)
                    rows.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs_, pa.string()), pa.array(rows, pa.binary())], names=["lang", "bytes"])

    drawn = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(cut, "lang string, bytes binary").toArrow()
    pairs = sorted(zip(drawn["lang"].to_pylist(), drawn["bytes"].to_pylist(), strict=True))
    classes = sorted(langs)
    place = {c: k for k, c in enumerate(classes)}
    x = np.frombuffer(b"".join(b for _, b in pairs), np.uint8).reshape(-1, LENGTH)
    return x, np.array([place[lang] for lang, _ in pairs], np.int64), classes


def fit(labelled: DataFrame) -> Network | None:
    """A network trained on labelled(lang, text); None if it has no rows with a letter."""
    x, y, classes = sample(labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")))
    if not classes:
        return None
    rng = np.random.default_rng(SEED)
    net = Network(classes, rng)
    counts = np.bincount(y, minlength=len(classes))
    even = np.concatenate([rng.choice(np.nonzero(y == k)[0], counts.max()) if counts[k] < counts.max() else np.nonzero(y == k)[0] for k in range(len(classes)) if counts[k]])
    net.train(x[even], y[even], rng)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(doc_id, held_out, text) to doc_id, held_out, lang_pred, score of every whole text.

    A null text, or one without a letter, is "und" with score 0, and so is every text if there is no network.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            told = [k for k, t in enumerate(texts) if t and own and LETTER.search(t)]
            for at in range(0, len(told), 128):
                part = told[at : at + 128]
                cut = [windows(texts[k].encode("utf-8", "surrogatepass")) for k in part]
                sizes = np.array([len(c) for c in cut])
                sums = np.add.reduceat(own.logits(np.concatenate(cut)), np.cumsum(sizes) - sizes, axis=0)
                chance = softmax((sums / sizes[:, None]).astype(np.float64))
                for k, row in zip(part, chance, strict=True):
                    langs[k], scores[k] = own.classes[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predicts the language of every row of docs(doc_id, text, lang), learning from rows with a language whose
    crc32(doc_id) mod folds is not `held`. Repeated rows are predicted each; other columns are not read."""
    scratch.long_rows(docs.sparkSession)
    marked = docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "text", "lang")
    return predict(marked, fit(marked.where("not held_out").select("lang", "text")))
