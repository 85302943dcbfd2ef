"""Prefix trie, toxicity and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtide.llm import prefix_trie, textvec, toxicity, whitening

CONVERSATION = "conv_id long, turn long, role string, text string, depth int, seq string"


# 11: prefix trie


def turn_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), parent, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        size = rng.choice((0, 1, 2, 3, 5, 9, 14)) if c % 3 else 3
        for k in range(size):
            text = rng.choice(("a", "b", "äö", "", None)) if c % 3 else "same"
            rows.append((c, rng.choice((k, k, k, None, 0)), rng.choice(("user", "user", None)) if c % 3 else "user", text))
    rows += [(None, 1, "user", "x"), *[r for r in rows if r[0] in (2, 3)]]  # no conversation; repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, block", [(1, 60, 2), (2, 90, 7), (3, 40, 1 << 16)])
def test_prefix_trie(spark, seed, n, block):
    rows = conversations(seed, n)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)
    got = prefix_trie.trie(prefix_trie.rebuilt(frame), block_rows=block).select(*prefix_trie.RESULT).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain_trie(rows)


def test_one_group_over_many_blocks(spark):
    rows = [(c, k, "user", f"t{min(k, 2)}") for c in range(0, 400) for k in range(3)] + [(1000 + c, 0, "user", f"other {c}") for c in range(30)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)
    got = prefix_trie.trie(prefix_trie.rebuilt(frame), block_rows=20).collect()
    assert {tuple(r[c] for c in prefix_trie.RESULT) for r in got} == plain_trie(rows)


def test_prefix_trie_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATION)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-1, 4), min_size=1, max_size=40), st.data())
def test_extents(values, data):
    at, depth = data.draw(st.integers(0, len(values) - 1)), data.draw(st.integers(0, 5))
    levels = prefix_trie.sparse(np.array(values))
    left = prefix_trie.left_end(levels, np.array([at]), np.array([depth]))[0]
    right = prefix_trie.right_end(levels, np.array([at]), np.array([depth]))[0]
    assert left == max((k for k in range(at + 1) if values[k] < depth), default=-1)
    assert right == next((k - 1 for k in range(at + 1, len(values)) if values[k] < depth), len(values) - 1)
    assert prefix_trie.range_min(levels, np.array([at]), np.array([right]))[0] == min(values[at : right + 1])


# 12: toxicity


def plain_windows(text):
    """Distinct terms of each window, by their spelling."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    per = max(1, -(-max(len(words) - (toxicity.WINDOW - toxicity.STEP), 0) // toxicity.STEP))
    return [{w for w in words[k * toxicity.STEP : k * toxicity.STEP + toxicity.WINDOW]} for k in range(per)]


def hash_of(word, prefix=0):
    return int(textvec.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([prefix or len(word)]))[0]) ^ prefix


def plain_score(model, text):
    """The machine's sums over all pairs."""
    place = {int(h): k for k, h in enumerate(model.known)}
    best = None
    for words in plain_windows(text):
        terms = {place.get(hash_of(w)) for w in words} | {place.get(hash_of(w, k)) for w in words for k in toxicity.PREFIXES if len(w) >= k}
        terms = sorted(t for t in terms if t is not None)
        z = model.b + sum(model.w[t] for t in terms) + sum(model.v[:, a] @ model.v[:, b] for i, a in enumerate(terms) for b in terms[i + 1 :])
        best = z if best is None else max(best, z)
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def test_scores_are_the_plain_ones(docs, awkward):
    rng = np.random.default_rng(5)
    words = sorted({w for r in awkward for s in plain_windows(r[1]) for w in s})
    known = np.unique(np.array([hash_of(w) for w in words[::2]] + [hash_of(w, k) for w in words[::3] for k in toxicity.PREFIXES if len(w) >= k], np.uint64))
    model = toxicity.Model(known, -0.5, rng.normal(size=len(known)) * 0.1, rng.normal(size=(3, len(known))) * 0.05)
    got = toxicity.score(docs.drop("score"), model, keep=("doc_id", "text", "cls")).collect()
    assert len(got) == len(awkward)
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, r["text"]), abs=1e-8)
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["n_windows"] == len(plain_windows(r["text"]))


def test_gradients_of_the_machine():
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=(3, 6)), rng.normal(size=6)
    row, term, dz = np.array([0, 0, 0, 1, 1]), np.array([0, 2, 5, 2, 3]), np.array([0.7, -0.4])

    def total(w, v):
        t = toxicity.Terms(row, term, np.array([0, 1, 2]))
        return float(dz @ toxicity.Model(np.arange(6, dtype=np.uint64), 0.3, w, v).windows(t))

    dw, dv = toxicity.gradients(v, term, row, dz)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert dw[k] == pytest.approx((total(w + e, v) - total(w - e, v)) / 2e-6, abs=1e-6)
        for f in range(3):
            step = np.zeros_like(v)
            step[f, k] = 1e-6
            assert dv[f, k] == pytest.approx((total(w, v + step) - total(w, v - step)) / 2e-6, abs=1e-5)


def sentences(seed, n):
    """Texts of two kinds: toxic ones have an insult, or a common word beside a word for a group, each harmless alone."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ra", "to", "li", "men") for b in ("ka", "su", "vo", "ne", "pi")]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice((12, 30, 60)))]
        kind = k % 6
        extra = {0: ["grum"], 1: ["pest", "zorbs"], 2: ["pest"], 3: ["zorbs"]}.get(kind, [])
        for w in extra:
            words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append(int(kind < 2))
    return texts, np.array(labels)


def test_pairs_are_learned():
    texts, labels = sentences(1, 1800)
    data, offsets = textvec.utf8(pa.array(texts))
    model = toxicity.fit(data, offsets, labels, np.ones(len(labels)))
    texts, labels = sentences(2, 600)
    score, _ = model.score(toxicity.windows(*textvec.utf8(pa.array(texts)), model.known))
    assert ((score >= 0.7) == labels).mean() > 0.97
    alone, _ = model.score(toxicity.windows(*textvec.utf8(pa.array(["raka pest tosu", "raka zorbs tosu", "raka pest zorbs", "raka grum"])), model.known))
    assert (alone >= 0.7).tolist() == [False, False, True, True]
    far = "pest " + "raka " * 200 + "zorbs"  # not in one window
    assert model.score(toxicity.windows(*textvec.utf8(pa.array([far])), model.known))[0][0] < 0.7
    long = "lika " * 20_000 + "grum " + "lika " * 20_000
    assert model.score(toxicity.windows(*textvec.utf8(pa.array([long])), model.known))[0][0] >= 0.7


def test_near_copies_are_one_group():
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    near = texts[0].split()
    near[40] = "changed"
    group = toxicity.copies(*textvec.utf8(pa.array([*texts, texts[0], " ".join(near), "", "", "one"])))
    assert group[0] == group[6] == group[7]
    assert len(set(group.tolist())) == 6 + 3


def test_toxicity(spark, docs, empty):
    texts, labels = sentences(3, 1500)
    rows = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(None, None, 0.5), (0, texts[0], 0.5)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(k, int(y), "z") for k, y in enumerate(labels)] + [(7, None, "z"), (None, 1, "z")], "doc_id long, toxic int, text string")
    got = toxicity.predict(rows, marks).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.predict(rows, other).collect()), key=repr) == sorted(map(tuple, got), key=repr)  # held-out labels teach nothing
    assert toxicity.predict(empty, marks).count() == 0
    assert {r["score"] for r in toxicity.predict(docs, marks.limit(0)).collect()} == {0.0}


def test_toxicity_sample_is_bounded(spark):
    rows = spark.createDataFrame([(k, "x" * (100 if k % 10 else 5000)) for k in range(100)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    got = toxicity.sample(rows, marks, rows=30, most=1000).collect()
    for y in (0, 1):
        mine = [r for r in got if r["label"] == y]
        assert mine and sum(len(r["text"]) for r in mine) <= 1000 and {r["of"] for r in mine} == {50}


# 13: whitening


def near(values, vectors, scatter):
    top = max(float(np.abs(scatter).max()), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - scatter).max() / top < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from(("normal", "copies", "axes", "rank", "wide", "zero")))
def test_rank_one_updates(seed, d, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, d))
    x = {
        "normal": x, "copies": np.repeat(x[:2], 20, 0), "axes": np.eye(d)[rng.integers(0, d, 40)] * 3, "rank": x[:, :1] @ rng.normal(size=(1, d)), "wide": x * np.logspace(0, -8, d), "zero": np.zeros((5, d)),
    }[kind]
    near(*whitening.absorb(np.zeros(d), np.eye(d), x), x.T @ x)


def test_roots_lie_between_poles():
    d, z = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-5, 0.3, 0.2, 2.0])
    roots, apart = whitening.secular(d, z)
    assert (roots > d).all() and (roots[:-1] < d[1:]).all()
    assert np.abs(1 + (z[:, None] ** 2 / apart).sum(0)).max() < 1e-6 * np.abs(z[:, None] ** 2 / apart).max()


def checked(rows, vectors, ids):
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, x.shape[1])
    assert len(rows) == n * k
    want = (x - s / n) @ axes[:, :k] / np.sqrt(values[:k])
    deviation = ((n * x - s) ** 2).sum(1)
    by_id = {i: j for j, i in enumerate(ids)}
    got = np.zeros_like(want)
    for r in rows:
        j, c = by_id[r["vec_id"]], r["component"] - 1
        got[j, c] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[j])
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-10)
        assert r["identity_error"] < 1e-9
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-7
    return got


@pytest.mark.parametrize("d, parts", [(3, 1), (12, 5), (12, 40)])
def test_whitening(spark, d, parts):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(150, d)) * np.linspace(3, 1, d)).astype(np.float32)
    faulty = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, []), (905, [1.0]), (906, [1e30] * d)]
    rows = [(k, v.tolist(), "z", 1.0) for k, v in enumerate(vectors)] + [(*f, "z", 1.0) for f in faulty]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, whitened double").repartition(parts)
    checked(whitening.whiten(frame).collect(), vectors, range(150))


def test_whitening_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])], kind)).collect()
    assert [(r["component"], r["n"]) for r in got] == [(1, 3)] * 3  # one direction; null and repeated ids are rows
    assert {r["deviation"] for r in got} == {(2 * 1024) ** 2, 1024**2}


def test_deviations_are_exact_or_null(spark):
    rows = [(k, [float(k % 2) * 2.0**30, 0.5 * k]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None}
    assert max(r["identity_error"] for r in got) < 1e-4
