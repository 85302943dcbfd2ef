"""Toxicity by a factorization machine over hashed terms.

Terms are 64-bit hashes of lower-cased words (letters, digits and bytes beyond ASCII; marks part words) and
of their first bytes (``PREFIXES``), which all forms of a stem share. A window is
``WINDOW`` words, a new one every ``STEP`` words; its features are its distinct known terms. The machine gives a window

    b + sum_i w_i + sum_(i<j) <v_i, v_j>

so that a pair, such as an insult with the mention of a group, counts apart from its terms' own weights. A text scores
what its highest window does: words act on each other where they stand together, and long texts are not thinned out.

The fit uses a bounded sample of labelled rows, ``TRAIN_ROWS`` a class by the smallest hash of the id and no more than
``TRAIN_BYTES`` of text a class (documented parameters; a longer text is left out of the sample), weighed by how many
labelled rows each class has; near copies in the sample count as one text. Known terms are those in a share of ``OFTEN`` of the sampled texts and
those that tell the labels apart by more than chance, ``TERMS`` of each at most. Highest windows and weights are found in turns: windows by the present weights, weights by Adam on the
chosen windows. Scoring covers every word of every text.

Defined results: null and empty texts have one window without terms and get the score of that; without labelled rows of
both classes every score is the share of label 1 (0 without labels); null labels teach nothing; a doc_id with several
labels teaches each; repeated rows are scored each for itself; an empty table gives an empty result; further columns are
ignored.
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
from jobtide.llm.textvec import LOWER, mixed, of_text, slices, span_hashes, word_spans

WINDOW, STEP = 64, 32
SLICE, SLICE_ROWS = 1 << 20, 1 << 14
TRAIN_ROWS, TRAIN_BYTES = 3000, 8 << 20
TERMS = 8192
PREFIXES = (5,)  # bytes of a word's beginning that are a term too
LEAST_TEXTS = 3  # sampled texts that hold a known term, at least; near copies count as one
OFTEN = 0.02  # share of the sampled texts that a term of neither label is in
FACTORS = 8
ROUNDS, STEPS, BATCH, RATE = 6, 200, 128, 0.03
DECAY_TELLING, DECAY_COMMON, DECAY_V = 0.03, 30.0, 3.0  # shared by the sampled texts
TOXIC = 0.7

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


@dataclass
class Terms:
    """Occurrences of terms in windows: each (window, term) once; ``first`` has the first window of each text (texts + 1 values)."""

    window: np.ndarray
    term: np.ndarray
    first: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> Terms:
    """Terms of the windows of all texts: places in the sorted hashes ``known``, or the hashes themselves."""
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, _GAP)
    words = np.diff(before)
    per = np.maximum(1, -(-np.maximum(words - (WINDOW - STEP), 0) // STEP))
    first = np.concatenate([[0], np.cumsum(per)])
    term, word = [], []
    for k in (0, *PREFIXES):
        long = np.flatnonzero(ends - starts >= k)
        some = span_hashes(data, starts[long], starts[long] + k if k else ends) ^ np.uint64(k)
        if known is not None:
            at = np.searchsorted(known, some)
            at[at == len(known)] = 0
            hit = known[at] == some if len(known) else np.zeros(len(some), bool)
            some, long = at[hit], long[hit]
        term.append(some)
        word.append(long)
    term, word = np.concatenate(term), np.concatenate(word)
    text = np.searchsorted(before, word, "right") - 1
    place = word - before[text]
    # A word lies in the window that begins at its step, and in the one before.
    own = place // STEP
    pairs = [(np.minimum(own, per[text] - 1), slice(None)), (own - 1, (own > 0) & (own < per[text]))]
    window = np.concatenate([first[text[m]] + (w[m]) for w, m in pairs])
    term = np.concatenate([term[m] for _, m in pairs])
    if known is not None:
        both = np.unique(window * np.int64(max(1, len(known))) + term)
        return Terms(both // max(1, len(known)), both % max(1, len(known)), first)
    return Terms(window, term, first)


@dataclass
class Model:
    """Hashes of the known terms in order, bias, weights and factors."""

    known: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray
    prior: float | None = None

    def windows(self, t: Terms) -> np.ndarray:
        """The machine's value of each window; half of (sum v)**2 - sum v**2 is the sum over pairs."""
        n = int(t.first[-1])
        out = np.full(n, self.b) + np.bincount(t.window, self.w[t.term], n)
        for v in self.v:
            x = v[t.term]
            sums = np.bincount(t.window, x, n)
            out += 0.5 * (sums * sums - np.bincount(t.window, x * x, n))
        return out

    def score(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and its highest window."""
        if self.prior is not None:
            return np.full(len(t.first) - 1, self.prior), np.zeros(len(t.first) - 1, np.int32)
        value = self.windows(t)
        top = highest(value, t.first)
        return sigmoid(value[t.first[:-1] + top]), top


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def highest(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the (first) highest window within each text."""
    best = np.repeat(np.maximum.reduceat(value, first[:-1]), np.diff(first))
    hit = np.flatnonzero(value == best)
    text = np.searchsorted(first, hit, "right") - 1
    _, at = np.unique(text, return_index=True)
    return (hit[at] - first[:-1]).astype(np.int32)


def gradients(v: np.ndarray, term: np.ndarray, row: np.ndarray, dz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by weights and factors of the sum of ``dz`` times the machine's values; ``row`` names each term's window."""
    n, size = len(dz), v.shape[1]
    dw = np.bincount(term, dz[row], size)
    dv = np.empty_like(v)
    for k, f in enumerate(v):
        x = f[term]
        sums = np.bincount(row, x, n)
        dv[k] = np.bincount(term, dz[row] * (sums[row] - x), size)
    return dw, dv


def sliced(data: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: place of the first one, bytes and offsets."""
    k = 0
    while k < len(offsets) - 1:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k]
        k = stop


def least_runs(data: np.ndarray, offsets: np.ndarray, words: int, seeds: tuple[int, ...], base: int) -> np.ndarray:
    """The least hashed run of words of each text under each function; a text without words has a value of its own."""
    n = len(offsets) - 1
    starts, ends, before = word_spans(data, offsets, _GAP)
    hashes = span_hashes(LOWER[data], starts, ends)
    run = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        run[: len(hashes) - k] += hashes[k:] * np.uint64(2 * k + 1)
    stop = np.maximum(before[1:] - words + 1, before[:-1] + 1)  # a shorter text has one run
    full = before[1:] > before[:-1]
    edges = np.stack([before[:-1], stop], 1)[full].ravel()
    out = np.empty((len(seeds), n), np.uint64)
    for j, seed in enumerate(seeds):
        h = mixed(run ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out[j] = np.arange(base, base + n)
        if len(edges):
            out[j, full] = np.minimum.reduceat(np.append(h, np.uint64((1 << 64) - 1)), edges)[::2]
    return out


def copies(data: np.ndarray, offsets: np.ndarray, words: int = 3, seeds: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """A group for each text: texts whose least hashed runs of words agree under two of three hash functions are near copies."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64)
    least = np.concatenate([least_runs(d, o, words, seeds, k) for k, d, o in sliced(data, offsets)], axis=1)
    group = np.arange(n)
    keys = [np.unique(mixed(least[a]) + least[b], return_inverse=True)[1] for a, b in ((0, 1), (0, 2), (1, 2))]
    while True:
        last = group.copy()
        for key in keys:
            first = np.full(key.max() + 1, n)
            np.minimum.at(first, key, group)
            group = first[key]
        if (group == last).all():
            return group


def choose(term: np.ndarray, text: np.ndarray, labels: np.ndarray, weight: np.ndarray, share: np.ndarray, most: int = TERMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the known terms, their log odds and whether they tell the labels apart, from distinct (term, text) pairs; ``share`` counts a text.

    Evidence of a term is the log likelihood ratio of the split of the labels by it.
    """
    names, at = np.unique(term, return_inverse=True)
    texts = np.bincount(at, share[text], len(names))
    one = np.bincount(at, (labels * weight)[text], len(names))
    zero = np.bincount(at, ((1 - labels) * weight)[text], len(names))
    n_one, n_zero = (labels * weight).sum(), ((1 - labels) * weight).sum()
    part, both = n_one / (n_one + n_zero), one + zero
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(one * np.log(one / (both * part))) + np.nan_to_num(zero * np.log(zero / (both * (1 - part))))
    held = np.flatnonzero(texts >= LEAST_TEXTS)
    often = held[texts[held] >= OFTEN * share.sum()]
    often = often[np.lexsort((names[often], -texts[often]))][:most]
    telling = held[ratio[held] >= np.log(max(1, len(held))) + 2]  # more than the best of so many terms would by chance
    telling = telling[np.lexsort((names[telling], -ratio[telling]))][:most]
    chosen = np.union1d(often, telling)
    odds = np.log((one[chosen] + 0.5) / (n_one + 1)) - np.log((zero[chosen] + 0.5) / (n_zero + 1))
    return names[chosen], odds, np.isin(chosen, telling)


def fit(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weight: np.ndarray, seed: int = 12) -> Model:
    """Learn from texts (bytes and offsets), their labels and weights."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), 0.0, np.zeros(0), np.zeros((FACTORS, 0)), prior=float(labels.mean()) if len(labels) else 0.0)
    group = copies(data, offsets)
    share = 1 / np.bincount(group)[group]  # near copies count as one text
    weight = weight * share
    weight = weight / weight.sum() * share.sum()
    terms, texts = [], []
    for k, d, o in sliced(data, offsets):  # distinct terms of each text
        raw = windows(d, o)
        of = np.searchsorted(raw.first, raw.window, "right") - 1
        order = np.lexsort((raw.term, of))
        of, term = of[order], raw.term[order]
        new = np.append(True, (of[1:] != of[:-1]) | (term[1:] != term[:-1])) if len(of) else np.zeros(0, bool)
        terms.append(term[new])
        texts.append((of[new] + k).astype(np.int32))
    known, odds, telling = choose(np.concatenate(terms), np.concatenate(texts), labels, weight, share)
    del terms, texts
    parts = [windows(d, o, known) for _, d, o in sliced(data, offsets)]
    before = np.cumsum([0, *(p.first[-1] for p in parts)])
    t = Terms(np.concatenate([p.window + b for p, b in zip(parts, before, strict=False)]), np.concatenate([p.term for p in parts]), np.concatenate([[0], *(p.first[1:] + b for p, b in zip(parts, before, strict=False))]))
    del parts
    rng = np.random.default_rng(seed)
    bias = float(np.log((labels * weight).sum() / ((1 - labels) * weight).sum()))
    p = {"b": np.array([bias]), "w": np.zeros(len(known)), "v": rng.normal(0, 0.02, (FACTORS, len(known)))}
    m1, m2 = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    ends = np.searchsorted(t.window, np.arange(int(t.first[-1]) + 1))
    guess = Model(known, bias, np.where(telling, odds, 0), np.zeros((FACTORS, len(known))))
    decay_w = np.where(telling, DECAY_TELLING, DECAY_COMMON) / share.sum()  # common words act in pairs, not by themselves
    decay_v = DECAY_V / share.sum()
    epochs = -(-STEPS // -(-len(labels) // BATCH))
    step, total = 0, ROUNDS * epochs * -(-len(labels) // BATCH)
    for round_ in range(ROUNDS):
        model = guess if round_ == 0 else Model(known, float(p["b"][0]), p["w"], p["v"])
        top = t.first[:-1] + highest(model.windows(t), t.first)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                many = ends[top[pick] + 1] - ends[top[pick]]
                row = np.repeat(np.arange(len(pick)), many)
                term = t.term[np.repeat(ends[top[pick]] - (np.cumsum(many) - many), many) + np.arange(len(row))]
                z = p["b"][0] + np.bincount(row, p["w"][term], len(pick))
                for f in p["v"]:
                    x = f[term]
                    z += 0.5 * (np.bincount(row, x, len(pick)) ** 2 - np.bincount(row, x * x, len(pick)))
                dz = weight[pick] * (sigmoid(z) - labels[pick]) / len(pick)
                dw, dv = gradients(p["v"], term, row, dz)
                step += 1
                rate = RATE * (1 - step / total)
                for name, g in (("b", np.array([dz.sum()])), ("w", dw + decay_w * p["w"]), ("v", dv + decay_v * p["v"])):
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.99 * m2[name] + 0.01 * g * g
                    p[name] = p[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)
    return Model(known, float(p["b"][0]), p["w"], p["v"])


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> DataFrame:
    """Columns text, label, of: at most ``rows`` labelled ids a class by the smallest hash, and ``most`` bytes of their texts; ``of`` counts the class."""
    known = labels.filter(labels[label].isin(0, 1)).select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("label"))
    known = known.withColumn("_h", F.md5(F.concat(F.lit("toxicity/"), F.col("_id").cast("string"))))
    counts = known.groupBy("label").agg(F.count("*").alias("of"))
    least = [known.filter(F.col("label") == value).orderBy("_h", "_id").limit(rows) for value in (0, 1)]
    chosen = least[0].unionByName(least[1])
    texts = docs.select(docs["doc_id"].alias("_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).filter(F.octet_length("text") <= most)
    found = texts.join(F.broadcast(chosen), "_id").withColumn("_t", F.md5(F.col("text").cast("binary")))  # 2 * rows ids
    found = found.dropDuplicates(["_id", "_t", "label"])
    found = [found.filter(F.col("label") == value).orderBy("_h", "_id", "_t").limit(rows) for value in (0, 1)]
    found = found[0].unionByName(found[1])  # 2 * rows texts
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("label").orderBy("_h", "_id", "_t").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumn("_sum", so_far).filter(F.col("_sum") <= most)
    return found.join(F.broadcast(counts), "label").orderBy("label", "_h", "_id", "_t").select("text", "label", "of")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """Fit on the bounded sample: 2 * ``most`` bytes of text come to the driver at most."""
    got = sample(docs, labels, label, rows, most).toArrow().combine_chunks()
    marks, of = got.column("label").to_numpy(), got.column("of").to_numpy().astype(float)
    kept = np.bincount(marks, minlength=2)
    parts = list(slices(iter(got.to_batches()), most=1 << 62))
    if not parts:
        return fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), marks, of)
    data = np.concatenate([d for _, d, _ in parts])
    sizes = np.concatenate([np.diff(o) for _, _, o in parts])
    return fit(data, np.concatenate([[0], np.cumsum(sizes)]), marks, of / kept[marks])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = TOXIC) -> DataFrame:
    """``keep``, score, predicted, n_windows, top_window (from 0)."""
    spec = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * TERMS terms

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        model = spec.value
        t = windows(data, offsets, model.known)
        found, top = model.score(t)
        found = np.clip(np.round(found, 9), 0, 1)
        return [pa.array(found), pa.array((found >= least).astype(np.int32)), pa.array(np.diff(t.first).astype(np.int32)), pa.array(top)]

    found = of_text(docs[text], "score double, predicted int, n_windows int, top_window int", run, SLICE, SLICE_ROWS)
    return docs.select(*keep, found.alias("_found")).select(*keep, "_found.*")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows whose crc32(doc_id) mod 3 is not 1; score all: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = train(rows, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return score(rows, model, keep=("doc_id", "held_out"))
