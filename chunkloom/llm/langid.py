"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the runs of two, three and four bytes of the lower-cased text, hashed
into buckets. A text's vector is the mean of its subwords' embeddings; a linear
layer and softmax give the languages' probabilities. Embeddings and layer are learned
together by stochastic gradient descent in numpy from a bounded sample of labelled
texts; a temperature, fitted on a part of the sample that was held back, calibrates
the probabilities, and a text whose best one stays below a threshold, set on the
same part, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one_task, sampled_texts
from .textcore import _LOWER, chunks, column_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class LangRules:
    """sample: labelled texts to learn from at most (by hash of their id). buckets, width: of the embeddings.
    accept: share of right answers of the held-back part that the rejection threshold lets through."""

    sample: int = 2000
    buckets: int = 1 << 15
    width: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 20.0
    accept: float = 0.995
    seed: int = 3


@dataclass
class LangModel:
    """table: the languages' score of each bucket, embedding times layer. bias, temperature and threshold of the calibrated probability."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, offsets: np.ndarray, rules: LangRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (buckets, first): of every run of so many bytes within a document."""
    data = _LOWER[data].astype(np.uint32)
    n, sizes = len(data), np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for k in rules.orders:
        m = max(0, n - k + 1)
        h = np.zeros(m, np.uint32)
        for i in range(k):
            h = h * np.uint32(0x01000193) + data[i : i + m] + np.uint32(1)
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(8)) & np.uint32(rules.buckets - 1)
        inside = doc[:m] == doc[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
        first = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.maximum(sizes - k + 1, 0), out=first[1:])
        yield h[inside].astype(np.int64), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row sums of each document's run of rows; zero for empty runs."""
    out = np.zeros((len(first) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], rules: LangRules = LangRules()) -> LangModel | None:
    """Learn from labelled texts; None if there is none."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(rules.seed)
    counted = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = np.concatenate([b for b, _ in subwords(data, np.array([0, len(data)]), rules)])
        counted.append(np.unique(found, return_counts=True) if len(found) else None)
    y = np.array([names.index(x) for x in langs])
    usable = np.array([i for i, c in enumerate(counted) if c is not None], dtype=np.int64)
    rng.shuffle(usable)
    held, own = usable[: len(usable) // 5], usable[len(usable) // 5 :]
    emb = rng.uniform(-1, 1, (rules.buckets, rules.width)) / rules.width
    layer, bias = np.zeros((len(names), rules.width)), np.zeros(len(names))
    steps, t = max(1, rules.epochs * len(own)), 0
    for _ in range(rules.epochs):
        rng.shuffle(own)
        for i in own:
            buckets, n = counted[i]
            share = (n / n.sum())[:, None]
            vec = (emb[buckets] * share).sum(axis=0)
            error = softmax((layer @ vec + bias)[None])[0]
            error[y[i]] -= 1
            rate = rules.rate * (1 - t / steps) / rules.width
            back = layer.T @ error
            layer -= rate * np.outer(error, vec)
            bias -= 0.05 * rate * error
            emb[buckets] -= rate * share * back
            t += 1
    table = emb @ layer.T
    part = held if len(held) else own
    logits = np.array([(table[counted[i][0]] * (counted[i][1] / counted[i][1].sum())[:, None]).sum(axis=0) + bias for i in part]).reshape(len(part), len(names))
    temperature, threshold = 1.0, 0.0
    if len(part):
        grid = np.exp(np.linspace(0, 3, 31))  # it may soften, never sharpen
        loss = [-np.log(softmax(logits / t)[np.arange(len(part)), y[part]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[part]])
        threshold = float(right[int((1 - rules.accept) * len(right))]) if len(right) else 0.0
    return LangModel(names, table.astype(np.float32), bias, temperature, threshold)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = _LOWER[data]
    first = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    out = np.diff(first[offsets]) > 0
    for d in np.flatnonzero(~out & (np.diff(wide[offsets]) > 0)):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def probabilities(data: np.ndarray, offsets: np.ndarray, model: LangModel, rules: LangRules) -> np.ndarray:
    total, n = np.zeros((len(offsets) - 1, len(model.langs))), np.zeros(len(offsets) - 1)
    for buckets, first in subwords(data, offsets, rules):
        total += sums(model.table[buckets], first)
        n += np.diff(first)
    return softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)


def learn(docs: DataFrame, rules: LangRules = LangRules()) -> LangModel | None:
    """A model from a bounded sample of the rows of docs with a text and a lang, those whose id hashes lowest.

    A row that comes again counts once; if it has several languages, the first by name.
    The sample is learned from in one task; the driver gets the model alone.
    """
    known = docs.filter("lang is not null and text is not null and text <> ''")
    marks = known.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min("lang").alias("lang"))

    def fit(rows: list[dict]) -> LangModel | None:
        rows = sorted(rows, key=lambda r: r["text_hash"])
        return train([r["text"] for r in rows], [r["lang"] for r in rows], rules)

    return in_one_task(sampled_texts(known, marks, rules.sample, "lang"), fit)


def identify(docs: DataFrame, model: LangModel | None, rules: LangRules = LangRules()) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of whole texts, a row per input row.

    Null texts and texts without a letter are ``und`` with score 0, not accepted, as
    is every text if there was nothing to learn from. score is the calibrated
    probability; accepted is false where it stays below the model's threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j, part, at in chunks(data, offsets):
                known = has_letter(part, at) if model else np.zeros(j - i, bool)
                p = probabilities(part, at, model, rules) if model else np.zeros((j - i, 1))
                best = p.argmax(axis=1)
                score = np.where(known, p.max(axis=1), 0.0)
                names = np.array(model.langs if model else [UNKNOWN], dtype=object)[best]
                names[~known] = UNKNOWN
                accepted = known & (score >= (model.threshold if model else 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(tell, "doc_id long, lang_pred string, score double, accepted boolean")
