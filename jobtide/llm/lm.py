"""Language-model scoring with a log-frequency Bloom filter.

All n-grams (n = 1, 2) of all training texts are counted; counts are quantised on a log scale, and for a count of level
q the entries (n-gram, 1) ... (n-gram, q) are put into a Bloom filter. A count is read back by probing level after level
until one is absent, as deep as the largest level put in. With c for counts as they are read back, the probability of a
word w after b is ``(1 - LAMBDA) * (c(b w) - DISCOUNT) / c(b)`` if the pair was seen (absolute discounting), and
``LAMBDA * (c(w) + ALPHA) / space`` if it was not, where space is that of the contract's estimate.

The filter is cut by hash into segments of ``BITS`` bits per entry, whatever their number: it grows with the corpus, and its
error does not. So it is never gathered in one place. Texts are read once, in slices of about ``SLICE_TEXT`` bytes. What a
slice asks for and what it teaches are the same list, its distinct n-grams with their numbers: it travels to the tasks that
hold the segments, which sum up, fill the segment, probe it, and send the levels back. Words come back with exact counts
too, for the base score. The slice's words travel beside as ranks by frequency, about two bytes a word. Slices and segments
depend on the texts alone, not on the cluster.

Tokens are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end mark, which also stands before the first word.

Defined results: null and empty texts are the end mark alone; without training rows N and V are 0 and all probabilities
are those of an unseen word; repeated rows count and are scored each for itself; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.langid import crc_mod
from jobtide.llm.textvec import LOWER, mixed, slices, span_hashes, word_spans
from jobtide.session import checkpointed

END = np.uint64(0x5851F42D4C957F2D)
ALPHA = 0.1  # of the contract's unigram estimate
LAMBDA, DISCOUNT = 0.4, 0.75
PER_DOUBLING = {1: 4, 2: 1}  # quantisation levels per doubling of a count
BITS, HASHES = 10, 4
SEGMENT_BYTES = 1 << 30  # a larger segment would be an error, not a coarser filter
LEAST_LANES, LANE_TEXT = 64, 2 << 20  # segments at least, and bytes of text to one of more
SLICE_TEXT = 4 << 20  # bytes of text to a slice, about
READ = 1 << 20  # bytes of text in one piece of a slice
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end mark after each, and the offsets of the texts."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets)
    hashes = np.insert(span_hashes(data, starts, ends), words[1:], END)
    return hashes, words + np.arange(len(words))


def bigrams(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    before = np.empty_like(token)
    if len(token):
        before[1:] = token[:-1]
        before[at[:-1]] = END
    return mixed(before * _A + token * _B)


def level(counts: np.ndarray, order: int) -> np.ndarray:
    """Quantisation level of counts from 1 on."""
    return 1 + np.floor(np.log2(counts) * PER_DOUBLING[order] + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, order: int) -> np.ndarray:
    """The count a level stands for: the middle of its range on the log scale; level 0 is count 0."""
    step = PER_DOUBLING[order]
    low, high = np.exp2((levels - 1) / step), np.exp2(levels / step)
    first, last = np.ceil(low - 1e-9), np.maximum(np.ceil(low - 1e-9), np.ceil(high - 1e-9) - 1)
    return np.where(levels > 0, np.sqrt(first * last), 0.0)


def _places(rest: np.ndarray, depth: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """The bit places of (n-gram, level) entries in segments of these sizes."""
    h = mixed(rest.astype(np.uint64) * _B + depth.astype(np.uint64) * _A)
    step = (h >> np.uint64(33)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(0xFFFFFFFF)) * bits.astype(np.uint64) >> np.uint64(32)


def segment(rest: np.ndarray, counts: np.ndarray, order: int, most: int = SEGMENT_BYTES) -> bytes:
    """One segment of the filter, ``BITS`` bits per entry."""
    deep = level(counts, order)
    entries = int(deep.sum())
    bits = max(64, -(-entries * BITS // 64) * 64)
    if bits > most * 8:
        raise ValueError(f"a filter segment of {entries} entries: more lanes are needed")
    table = np.zeros(bits, bool)
    for depth in range(1, int(deep.max(initial=0)) + 1):
        inside = rest[deep >= depth]
        for place in _places(inside, np.full(len(inside), depth), np.full(len(inside), bits)):
            table[place.astype(np.int64)] = True
    return np.packbits(table, bitorder="little").tobytes()


class Filter:
    """The log-frequency Bloom filter of one order, from its segments."""

    def __init__(self, order: int, lanes: int, segments: dict[int, bytes], deepest: int = 255) -> None:
        sizes = np.array([len(segments.get(k, b"")) for k in range(lanes)], np.int64)
        self.order, self.lanes, self.deepest = order, lanes, deepest
        self.first, self.bits = np.concatenate([[0], np.cumsum(sizes)])[:-1] * 8, sizes * 8
        self.table = np.frombuffer(b"".join(segments.get(k, b"") for k in range(lanes)), np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts read back by repeated membership probes."""
        return count_of(self.levels(hashes), self.order)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        lane = ((hashes >> np.uint64(32)) % np.uint64(self.lanes)).astype(np.int64)
        rest, levels = hashes & np.uint64(0xFFFFFFFF), np.zeros(len(hashes), np.int64)
        live = np.flatnonzero(self.bits[lane] > 0)
        depth = 0
        while len(live) and depth < self.deepest:
            depth += 1
            where, good = lane[live], np.ones(len(live), bool)
            for place in _places(rest[live], np.full(len(live), depth), self.bits[where]):
                at = self.first[where] + place.astype(np.int64)
                good &= (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[good]
            levels[live] = depth
        return levels


WORDS, PAIRS, TEXTS, RANKS, TOTALS = range(1, 6)  # kinds of rows


def _by_lane(hashes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted hashes by lane, the lanes that occur, and the first place of each (one more at the end)."""
    lane = ((hashes >> np.uint64(32)) % np.uint64(lanes)).astype(np.int32)
    order = np.argsort(lane, kind="stable")
    found, first = np.unique(lane[order], return_index=True)
    return order, found, np.append(first, len(hashes))


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each, or in eight each if one is larger."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<i8").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    """What ``_small`` wrote; nothing stands for zeros."""
    if not raw:
        return np.zeros(n, np.int64)
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<i8").astype(np.int64)


def _planes(ranks: np.ndarray) -> bytes:
    return pa.compress(ranks.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _ranks(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class _Rows:
    """Rows of one layout: to, slice, kind, place, the columns to keep, keys, counts."""

    def __init__(self, keep: pa.Schema) -> None:
        self.keep = keep
        self.names = ["to", "slice", "kind", "place", *keep.names, "keys", "counts"]

    def batch(self, rows: list[tuple[int, int, int, int, bytes, bytes]], kept: list[pa.Array] | None = None) -> pa.RecordBatch:
        to, ident, kind, place, keys, counts = zip(*rows, strict=True)
        kept = kept or [pa.nulls(len(rows), f.type) for f in self.keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(to, pa.int64()), pa.array(ident, pa.int64()), pa.array(kind, pa.int32()), pa.array(place, pa.int32()), *kept, pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], self.names
        )


def _read(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, and the offsets of its texts."""
    parts = [tokens(data, offsets) for _, data, offsets in slices(iter(batches), most=READ)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([t for t, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def asked(docs: DataFrame, keep: tuple[str, ...], learn: str, lanes: int) -> DataFrame:
    """One reading of the texts: rows of texts, of word ranks, and of words and pairs with their numbers in training texts."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size, done, task = {False: 0, True: 0}, 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece, _, offsets in slices(iter([batch]), most=SLICE_TEXT):
                taught = np.array(piece.column(piece.num_columns - 1).to_pylist(), bool)
                for flag in (False, True):
                    at = np.flatnonzero(taught == flag)
                    if len(at):
                        held[flag].append(piece.take(pa.array(at)))
                        size[flag] += int(np.diff(offsets)[at].sum()) + len(at)
                    if size[flag] >= SLICE_TEXT:
                        yield from one(task << 32 | done, held[flag], flag)
                        held[flag], size[flag], done = [], 0, done + 1
        for flag in (False, True):
            if held[flag]:
                yield from one(task << 32 | done, held[flag], flag)
                done += 1

    def one(ident: int, batches: list[pa.RecordBatch], taught: bool) -> Iterator[pa.RecordBatch]:
        rows = _Rows(pa.schema([batches[0].schema.field(k) for k in range(len(keep))]))
        token, at = _read(batches)
        to = 2 * lanes + ((ident >> 32) * 7919 + ident) % lanes
        place = 0
        for batch in batches:
            n = np.diff(at[place : place + batch.num_rows + 1])
            yield rows.batch([(to, ident, TEXTS, place + k, b"", int(x).to_bytes(8, "little")) for k, x in enumerate(n.tolist())], batch.columns[: len(keep)])
            place += batch.num_rows
        word, inverse, n = np.unique(token, return_inverse=True, return_counts=True)
        common = np.argsort(-n, kind="stable")
        rank = np.empty(len(word), np.int64)
        rank[common] = np.arange(len(word))
        out = [(to, ident, RANKS, len(token), word[common].tobytes(), _planes(rank[inverse]))]
        pair, many = np.unique(bigrams(token, at), return_counts=True)
        for kind, keys, counts in ((WORDS, word, n), (PAIRS, pair, many)):
            order, found, first = _by_lane(keys, lanes)
            keys, counts = keys[order], counts[order]
            keys = keys if kind == WORDS else (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for lane, a, b in zip(found.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                out.append(((kind - 1) * lanes + lane, ident, kind, lane, keys[a:b].tobytes(), _small(counts[a:b]) if taught else b""))
        yield rows.batch(out)

    rows = docs.select(*keep, docs["text"].alias("text"), F.coalesce(docs[learn], F.lit(False)).alias("_learn"))
    return rows.mapInArrow(run, f"to bigint, slice bigint, kind int, place int, {own}, keys binary, counts binary")


def answered(rows: DataFrame, keep: tuple[str, ...], lanes: int, parts: int) -> DataFrame:
    """Lane by lane: counts summed up, a segment filled and probed; levels (and counts of words) for each slice that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            to = batch.column(0).to_numpy()
            for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))([0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]), strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if to[a] >= 2 * lanes:
                    yield part
                    continue
                if to[a] != now and held:
                    yield lane(held)
                    held = []
                now = to[a]
                held.append(part)
        if held:
            yield lane(held)

    def lane(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, place, to = (batches[0].column(k)[0].as_py() for k in (2, 3, 0))
        rows = _Rows(pa.schema([batches[0].schema.field(4 + k) for k in range(len(keep))]))
        idents = [x for b in batches for x in b.column(1).to_pylist()]
        asks = [np.frombuffer(x, np.uint64 if kind == WORDS else np.uint32) for b in batches for x in b.column(b.num_columns - 2).to_pylist()]
        taught = [x for b in batches for x in b.column(b.num_columns - 1).to_pylist()]
        counts = np.concatenate([_large(x, len(k)) for x, k in zip(taught, asks, strict=True)])
        keys, inverse = np.unique(np.concatenate(asks), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, counts)
        rest = keys.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        known = total > 0
        table = Filter(kind, 1, {0: segment(rest[known], total[known], kind)}, int(level(total[known], kind).max(initial=0)))
        levels = table.levels(rest).astype(np.uint8)
        out, start = [], 0
        for ident, ask in zip(idents, asks, strict=True):
            mine = inverse[start : start + len(ask)]
            start += len(ask)
            out.append((to, ident, kind, place, levels[mine].tobytes(), _small(total[mine]) if kind == WORDS else b""))
        if kind == WORDS:
            out.append((to, -1 - place, TOTALS, 0, b"", np.array([total.sum(), known.sum()], "<i8").tobytes()))
        return rows.batch(out)

    rows = rows.repartition(parts, "to").sortWithinPartitions("to")
    return rows.mapInArrow(run, rows.schema)


def _bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def score(docs: DataFrame, learn: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score, score of every row; counts from all rows where ``learn`` is true."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(LEAST_LANES, -(-_bytes(docs) // LANE_TEXT))
    given, keep = keep, tuple(f"_k{k}" for k in range(len(keep)))  # names that clash with none here
    docs = docs.select(*[F.col(c).alias(k) for c, k in zip(given, keep, strict=True)], "text", F.col(learn).alias("_learn"))
    learn = "_learn"
    rows = answered(asked(docs, keep, learn, lanes), keep, lanes, parts)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = [*keep, "n_tokens", "n_known", "_base", "_seen", "_unseen", "_n", "_v"]

    def values(keys: np.ndarray, kind: int, place: list[int], data: list[bytes], wide: bool) -> np.ndarray:
        """What the lanes sent for the sorted keys of a slice."""
        order, found, first = _by_lane(keys, lanes)
        out = np.zeros(len(keys), np.int64)
        got = dict(zip(place, data, strict=True))
        for lane, a, b in zip(found.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            out[order[a:b]] = _large(got[lane], b - a) if wide else np.frombuffer(got[lane], np.uint8)
        return out

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        pick = lambda kind: table.take(pa.array(np.flatnonzero(kinds == kind)))
        if table.column("slice")[0].as_py() < 0:
            n, v = np.sum([np.frombuffer(x, "<i8") for x in pick(TOTALS).column("counts").to_pylist()], axis=0).tolist()
            none = [pa.nulls(1, table.schema.field(c).type) for c in keep]
            return pa.table([*none, *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], pa.array([n]), pa.array([v])], names)
        texts = pick(TEXTS).sort_by("place")
        sizes = np.array([int.from_bytes(x, "little") for x in texts.column("counts").to_pylist()], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        ranks = pick(RANKS)
        word = np.frombuffer(ranks.column("keys")[0].as_py(), np.uint64)
        index = _ranks(ranks.column("counts")[0].as_py(), ranks.column("place")[0].as_py())
        token = word[index]
        answers = {kind: [pick(kind).column(c).to_pylist() for c in ("place", "keys", "counts")] for kind in (WORDS, PAIRS)}
        by_key = np.argsort(word)
        exact, read = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        exact[by_key] = values(word[by_key], WORDS, answers[WORDS][0], answers[WORDS][2], True)
        read[by_key] = values(word[by_key], WORDS, answers[WORDS][0], answers[WORDS][1], False)
        pair, back = np.unique(bigrams(token, at), return_inverse=True)
        joint = count_of(values(pair, PAIRS, answers[PAIRS][0], answers[PAIRS][1], False), 2)[back]
        of_word = count_of(read, 1)
        own = of_word[index]
        before = np.empty(len(token))
        before[1:] = own[:-1]
        before[at[:-1]] = of_word[np.flatnonzero(word == END)[0]]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        seen = joint > 0
        p = (1 - LAMBDA) * np.minimum(1.0, (joint - DISCOUNT) / np.maximum(np.maximum(before, joint), 1.0))
        logs = np.where(seen, np.log10(np.maximum(p, 1e-300)), np.log10(LAMBDA * (own + ALPHA)))
        add = lambda x: np.bincount(doc, x, len(sizes))
        return pa.table([
            *[texts.column(c).combine_chunks() for c in keep], pa.array(sizes), pa.array(add(exact[index] > 0).astype(np.int64)), pa.array(add(np.log10(exact + ALPHA)[index])), pa.array(add(logs)),
            pa.array(add(~seen).astype(np.int64)), pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.int64()),
        ], names)

    done = rows.drop("to").groupBy("slice").applyInArrow(run, f"{own}, n_tokens bigint, n_known bigint, _base double, _seen double, _unseen bigint, _n bigint, _v bigint")
    done = checkpointed(done)
    total = done.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_v"), F.lit(0)).alias("v")).first()
    space = F.log10(F.lit(total["n"] + ALPHA * (total["v"] + 1)))
    return done.filter(F.col("n_tokens").isNotNull()).select(
        *[F.col(k).alias(c) for c, k in zip(given, keep, strict=True)], "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), (F.col("_base") - F.col("n_tokens") * space).alias("base_score"),
        (F.col("_seen") - F.col("_unseen") * space).alias("score"),
    )


def predict(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 10 is not 0; score all rows."""
    held = crc_mod(F.col("doc_id"), 10) == 0
    return score(docs.select("doc_id", "text", held.alias("held_out"), (~held).alias("learn")), "learn", keep=("doc_id", "held_out"))
