"""Language identification as inference of a mixture of languages.

Model: per language the log-frequencies of hashed byte trigrams of lower-cased text (digits and ASCII marks count as
blanks), learned from all labelled training rows; a fixed number of buckets a language. A text is a mixture of
languages: expectation-maximisation estimates the proportions from the trigram likelihoods, and the set of languages
is the one that a likelihood with a penalty of ``PENALTY`` per language and sqrt-free log length (as in BIC) prefers.
A text whose best single language already meets the optimality conditions of the mixture (no other language would
raise the penalised likelihood) needs no iterations; that is most of them, and it changes no result.

All languages of the training rows are learned. The model is ``BUCKETS`` numbers a language; more than ``MOST_LANGUAGES``
languages (64 MB) are no list of languages and end the job with an error.

Defined results: texts that are null or have no letter are ``und`` with score 0; ties go to the language first in
order; rows without language teach nothing; without any training row every text is ``und``; repeated rows are predicted
each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.textvec import LOWER, of_text, slices

BUCKETS = 4096
PENALTY = 3.0
ROUNDS = 30
UND = "und"
_BLANK = LOWER.copy()
_BLANK[:97] = 32
_BLANK[123:128] = 32
MOST_LANGUAGES = 4096
SLICE, SLICE_ROWS = 1 << 20, 256  # of texts counted at a time: 4 MB of counts


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every trigram that holds a letter; trigrams don't cross rows."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = _BLANK[LOWER[data]]
    chars = chars.astype(np.uint32)
    keys = chars[:-2] << 16 | chars[1:-1] << 8 | chars[2:]
    use = (chars[1:-1] != 32) & ((chars[:-2] != 32) | (chars[2:] != 32))
    for edge in (offsets[1:-1] - 1, offsets[1:-1] - 2):
        edge = edge[(edge >= 0) & (edge < n - 2)]
        use[edge] = False
    at = np.flatnonzero(use)
    buckets = (keys[at] * np.uint32(2654435761)) >> np.uint32(20)
    rows = np.searchsorted(offsets, at, "right") - 1
    return rows, buckets.astype(np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, buckets = _grams(data, offsets)
    n = len(offsets) - 1
    return np.bincount(rows * BUCKETS + buckets, minlength=n * BUCKETS).astype(np.float32).reshape(n, BUCKETS)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of their trigram buckets, from all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, data, offsets in slices(batches, most=SLICE):
            langs = np.array(batch.column(0).to_pylist(), object)
            row, bucket = _grams(data, offsets)
            for name in set(langs):
                sums[name] = sums.get(name, 0) + np.bincount(bucket[(langs == name)[row]], minlength=BUCKETS)
        for name, got in sums.items():
            at = np.append(0, np.flatnonzero(got[1:]) + 1)  # the first bucket always, so that a language without trigrams is known
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], ["lang", "bucket", "n"])

    known = docs.filter(docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    total = known.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = total.limit(MOST_LANGUAGES * BUCKETS + 1).toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return [], np.zeros((0, BUCKETS))
    counts = np.zeros((len(langs), BUCKETS))
    place = {name: k for k, name in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def mixture(counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Proportions of the languages in one text (a bucket histogram), after choice of the language set."""
    k, counts = len(logp), counts.astype(float)
    single = logp @ counts
    best = int(single.argmax())
    theta = np.zeros(k)
    theta[best] = 1.0
    total = counts.sum()
    cost = PENALTY * np.log(max(total, 2.0))
    at = np.flatnonzero(counts)
    c, p = counts[at], np.exp(logp[:, at].astype(float))
    # Upper bound of the gain that adding language j to the best one can bring, from the slope of the likelihood.
    slope = (p / p[best]) @ c - total
    slope[best] = 0.0
    if slope.max(initial=0.0) <= cost:
        return theta
    live = np.flatnonzero(slope > 0)
    live = np.union1d(live, [best])
    value = single[best] - cost
    while len(live) > 1:
        q = p[live]
        w = np.full(len(live), 1.0 / len(live))
        for _ in range(ROUNDS):
            share = w[:, None] * q
            new = (share / share.sum(0)) @ c / total
            if np.abs(new - w).max() < 1e-4:
                w = new
                break
            w = new
        found = float(c @ np.log(w @ q)) - cost * len(live)
        if found > value:
            value, theta = found, np.zeros(k)
            theta[live] = w
        live = np.delete(live, w.argmin())  # backward choice: drop the smallest share and fit again
    return theta


def _has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def single(counts: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text, and whether no mixture can do better (the bound of ``mixture``)."""
    best, total = (counts @ logp.T).argmax(1), counts.sum(1)
    sure = np.zeros(len(best), bool)
    for b in np.unique(best):
        mine = np.flatnonzero(best == b)
        slope = counts[mine] @ np.exp(logp - logp[b]).T - total[mine, None]
        slope[:, b] = 0
        sure[mine] = slope.max(1) <= PENALTY * np.log(np.maximum(total[mine], 2.0))
    return best, sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (share of that language), mixture (``lang:share`` of the chosen set, largest first)."""
    langs, logp = model
    spec = docs.sparkSession.sparkContext.broadcast((langs, logp))  # at most MOST_LANGUAGES * BUCKETS floats

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        langs, logp = spec.value
        counts = _counts(data, offsets)
        best, sure = single(counts, logp)
        pred, score, mixed = [], [], []
        for k in range(len(counts)):
            if sure[k]:
                theta = np.zeros(len(langs))
                theta[best[k]] = 1.0
            else:
                theta = mixture(counts[k], logp)
            order = np.argsort(-theta, kind="stable")
            pred.append(langs[order[0]])
            score.append(float(min(1.0, theta[order[0]])))
            mixed.append(",".join(f"{langs[j]}:{theta[j]:.3f}" for j in order if theta[j] > 0))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())]

    kind = "lang_pred string, score double, mixture string"
    found = of_text(docs[text], kind, run, SLICE, SLICE_ROWS) if langs else F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    rows = docs.select(*keep, _has_letter(docs[text]).alias("_letter"), found.alias("_found"))
    letter = F.col("_letter") & F.col("_found").isNotNull()
    return rows.select(
        *keep, F.when(letter, F.col("_found.lang_pred")).otherwise(UND).alias("lang_pred"), F.when(letter, F.col("_found.score")).otherwise(0.0).alias("score"),
        F.when(letter, F.col("_found.mixture")).otherwise("").alias("mixture"),
    )


def crc_mod(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % n


def predict(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2; predict all: doc_id, held_out, lang_pred, score, mixture."""
    rows = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = learn(rows.filter(~F.col("held_out")))
    return identify(rows, model, keep=("doc_id", "held_out"))
