"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded (shares of byte classes and of byte-class
pairs, word shape and repetition, then one dense tanh layer); gated attention (a tanh gate times a sigmoid gate) weighs
the passages; the weighted sum is scored by a logistic unit. Encoder, attention and classifier are learned together
from document labels by Adam on the whole bag's loss, classes weighed evenly.

The fit uses a bounded sample of labelled rows, ``TRAIN_ROWS`` a class by the smallest hash and ``TRAIN_BYTES`` of text a class
(documented parameters; a longer text is left out of the sample), so that what comes to the driver is bounded too;
scoring covers every row and every passage of every text.

Defined results: null and empty texts are one empty passage and get a score; without labelled rows of both classes every
score is the share of label 1 (0.5 without labels); null labels teach nothing; a doc_id with several labels teaches
each; repeated rows are scored each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.llm.langid import crc_mod
from jobtide.llm.textvec import give_back, of_text, slices, span_hashes, word_spans

PASSAGE = 512
SLICE, SLICE_ROWS = 1 << 20, 4096  # of texts encoded at a time
TRAIN_ROWS, TRAIN_BYTES = 1500, 32 << 20
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

# Byte classes: each ASCII mark for itself, digits, upper and lower case, blanks, line feeds, other bytes.
_CLASS = np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _k, _b in enumerate(_marks):
    _CLASS[_b] = 7 + _k
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
CLASSES = 7 + len(_marks)
_COARSE = np.minimum(_CLASS, 7)
WIDTH = CLASSES + 64 + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each text (texts + 1 values)."""
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n, total = len(data), int(first[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if not n:
        return x, first
    doc = np.repeat(np.arange(len(sizes)), sizes)
    of = first[doc] + (np.arange(n) - offsets[doc]) // PASSAGE
    size_of = np.bincount(of, minlength=total).astype(np.float32)
    length = np.maximum(1, size_of)
    kinds = np.bincount(of * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    coarse = _COARSE[data]
    inside = np.flatnonzero(doc[1:] == doc[:-1])  # a pair of bytes lies in one text
    pairs = np.bincount(of[inside + 1] * 64 + coarse[inside] * 8 + coarse[inside + 1], minlength=total * 64).reshape(total, 64)
    x[:, :CLASSES] = np.sqrt(kinds / length[:, None])
    x[:, CLASSES : CLASSES + 64] = np.sqrt(pairs / length[:, None])
    starts, ends, _ = word_spans(data, offsets)
    if len(starts):
        where, size = of[starts], (ends - starts).astype(np.float32)
        many = np.bincount(where, minlength=total).astype(np.float32)
        words = np.maximum(1, many)
        mean = np.bincount(where, size, total) / words
        spread = np.sqrt(np.maximum(0, np.bincount(where, size * size, total) / words - mean * mean))
        keys = (where.astype(np.uint64) << np.uint64(40)) | (span_hashes(data, starts, ends) >> np.uint64(24))
        own = np.bincount((np.unique(keys) >> np.uint64(40)).astype(np.int64), minlength=total)
        title = (data[starts] >= 65) & (data[starts] < 91)
        base = CLASSES + 64
        x[:, base] = np.log1p(mean) / 4
        x[:, base + 1] = np.log1p(spread) / 4
        x[:, base + 2] = own / words
        x[:, base + 3] = np.bincount(where, title, total) / words
        x[:, base + 4] = many / 100
    x[:, -1] = np.minimum(size_of / PASSAGE, 1)
    return x, first


@dataclass
class Model:
    """Weights of encoder, gated attention and classifier, with the scaling of the features."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float | None = None

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention of each passage."""
        if self.prior is not None:
            per = np.diff(first)
            return np.full(len(per), self.prior), np.repeat(1.0 / per, per)
        z, parts = _forward(self.weights, (x - self.shift) / self.scale, first)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), parts["a"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    g = (t * s) @ w["q"]
    per = np.diff(first)
    top = np.maximum.reduceat(g, first[:-1])
    a = np.exp(g - np.repeat(top, per))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), per)
    m = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return m @ w["c"] + w["b"], {"h": h, "t": t, "s": s, "a": a, "m": m}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, dz: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    per = np.diff(first)
    h, t, s, a, m = p["h"], p["t"], p["s"], p["a"], p["m"]
    dm = np.repeat(dz[:, None] * w["c"], per, axis=0)
    da = (dm * h).sum(1)
    dg = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), per))
    dts = dg[:, None] * w["q"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (a[:, None] * dm + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "q": (t * s).T @ dg, "c": m.T @ dz, "b": np.array([dz.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn from bags of passage features and their document labels."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, prior=float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(0), every.std(0) + 0.05
    bags = [((b - shift) / scale).astype(np.float64) for b in bags]
    w = {
        "E": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "q": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
    }
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            x = np.concatenate([bags[i] for i in pick])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            z, parts = _forward(w, x, first)
            dz = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, g in _gradients(w, x, first, dz, parts).items():
                g = g + DECAY * w[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                w[name] = w[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)
    return Model(shift, scale, w)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> DataFrame:
    """At most ``rows`` labelled ids a class, those with the smallest hash, and at most ``most`` bytes of their texts."""
    known = labels.filter(labels[label].isin(0, 1)).select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("label"))
    known = known.withColumn("_h", F.md5(F.concat(F.lit("quality/"), F.col("_id").cast("string"))))
    least = [known.filter(F.col("label") == value).orderBy("_h", "_id").limit(rows) for value in (0, 1)]
    chosen = least[0].unionByName(least[1])
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most)
    known_texts = texts.join(F.broadcast(chosen), "_id").withColumn("_t", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))  # 2 * rows ids
    known_texts = known_texts.dropDuplicates(["_id", "_t", "label"])
    parts = [known_texts.filter(F.col("label") == value).orderBy("_h", "_id", "_t").limit(2 * rows) for value in (0, 1)]
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.partitionBy("label").orderBy("_h", "_id", "_t").rowsBetween(W.unboundedPreceding, 0))  # 4 * rows texts
    return parts[0].unionByName(parts[1]).withColumn("_sum", so_far).filter(F.col("_sum") <= most).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the bounded sample: passages are encoded in tasks, the bags of the sample come to the driver."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, most=SLICE, rows=SLICE_ROWS):
            x, first = passages(data, offsets)
            blobs = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], ["bag", "label"])

    got = sample(docs, labels, label, rows).mapInArrow(encode, "bag binary, label int").collect()  # 4 * rows at most
    got.sort(key=lambda r: (r["label"], r["bag"]))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in got]
    model = fit(bags, np.array([r["label"] for r in got]))
    del got, bags
    give_back()  # of the driver's memory
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, predicted, n_passages, top_passage (the passage with most attention)."""
    spec = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        x, first = passages(data, offsets)
        found, attention = spec.value.score(x, first)
        top = np.array([int(attention[a:b].argmax()) for a, b in zip(first[:-1], first[1:], strict=True)], np.int32)
        found = np.clip(np.round(found, 9), 0, 1)
        return [pa.array(found), pa.array((found >= 0.5).astype(np.int32)), pa.array(np.diff(first).astype(np.int32)), pa.array(top)]

    found = of_text(docs[text], "score double, predicted int, n_passages int, top_passage int", run, SLICE, SLICE_ROWS)
    return docs.select(*keep, found.alias("_found")).select(*keep, "_found.*")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows whose crc32(doc_id) mod 3 is not 1; score all: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = train(rows, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return score(rows, model, keep=("doc_id", "held_out"))
