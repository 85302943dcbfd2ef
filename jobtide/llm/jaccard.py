"""N-gram Jaccard join by parity sketches, and near-duplicate groups from its links.

A text is the set of its distinct word n-grams. Texts with equal sets form a class; a class is handled once.

*Keys.* Sizes fall into bands such that linked sets lie in the same band or in neighbouring ones. For a pair of bands
the largest symmetric difference d of a linked pair is known. Every n-gram toggles one bit of a sketch of m = d + 1 + e
words of ``WORD_BITS`` bits: it belongs to one word. At most d words of a linked pair differ, so at least e + 1 agree
(pigeonhole). Words that agree are join keys; as a word has few bits set, it is kept as a parity hash of them. Words of no
or one n-gram are left out as long as they are fewer than e.

*Candidates.* Because e + 1 words agree, linked sets share several keys. Pairs in groups of up to ``SMALL_GROUP`` sets are
counted one by one. Of larger groups each set counts how many it is in: two sets can share no more keys there than the one
with fewer has. Pairs whose keys from small groups and this bound together are too few are chance meetings. A larger
group gives a star, an edge of each set to the first one, but only of those sets that could be linked by keys of large
groups alone: a common line puts many texts into one large group, and as one agreeing word is not enough, into no
family. Sets that edges connect are a family; linked sets are always of one family.

*Verification.* Families are cut into blocks of bounded size. Each pair of blocks is a task of its own: short sketches are
compared (their Hamming distance is a lower bound of the symmetric difference and rejects what can't be linked), then all
pairs that are left are verified on the n-grams. What leaves the task are, for each set, the number of its links and
the least set that it is connected with there, not the pairs. So all links are found and counted, and rows that leave
stay in proportion to the sets; a set's n-grams travel once for each block of its family, so a family of F sets costs
F * F / ``BLOCK`` copies. ``links`` gives the pairs themselves.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, hashed to 64 bits as the n-grams are. A class is a
64-bit hash of its set; if two sets ever have one hash, a second hash tells and the job ends with an error.

Defined results: null, empty and blank texts have no n-grams and are a group of their own; a text with fewer words than
n has one n-gram, its whole sequence; repeated rows and equal texts are in one group; the group's id is its smallest id
(null ids have none, a group of null ids has null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.graph import components
from jobtide.llm.textvec import LOWER, give_back, lists, mixed, signed, slices, span_hashes, word_spans
from jobtide.session import checkpointed, shared_folder

FILTER_BITS = 1 << 26  # of the bit table that tells which sets a scan has to emit: 8 MB
SPARE = 5  # one word in so many is spare: more keys, but linked sets share several of them
WORD_BITS = 1 << 20
SMALL_GROUP = 16
BLOCK = 4096  # sets in one block
BLOCK_GRAMS = 1 << 21  # n-grams in one block, about
STEP = 1024  # sets that are compared at a time
SKETCH_BITS = 512
COLUMNS = 2048  # n-grams of a product of indicator matrices at a time
HELD_KEYS = 1 << 20  # keys that a task holds before it hands them on
SHARES = 4  # lanes of a shuffle partition; a task handles the keys of one lane, or of a share of all lanes, at a time
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled = rolled * _FACTOR + h[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = one * _FACTOR + h[k]
            out.append(mixed(one))
        else:
            out.append(h[:0])
    return out


def set_hashes(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers for a set; the lowest four bits of the first are 0, free for ``segment_keys``."""
    both = mixed(np.array([grams.sum(dtype=np.uint64), np.bitwise_xor.reduce(grams) + np.uint64(len(grams))]))
    first = mixed(both[:1] * _FACTOR + both[1:])[0] & ~np.uint64(15)
    return int(first.view(np.int64)), int(mixed(both[:1] + both[1:] * _FACTOR)[0].view(np.int64))


def set_hash(grams: np.ndarray) -> int:
    return set_hashes(grams)[0]


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 31) -> list[int]:
    """Lower ends of the size bands: a linked partner of a set lies at most one band away."""
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * den // num + 1)
    return edges


def largest_difference(band: int, num: int, den: int) -> int:
    """Most n-grams that are in one set only, for linked sets in this band and the next."""
    edges = bands(num, den)
    a = edges[band + 1] - 1
    return (a + min(edges[band + 2] - 1, a * den // num)) * (den - num) // (den + num)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of ``SKETCH_BITS`` bits, rows of 64-bit words."""
    out = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    for row, grams in zip(out, sets, strict=True):
        row[:] = np.bincount((grams & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def possible(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of x (rows of sketches) may be linked with which of y, by sizes and Hamming distances of the sketches."""
    out = np.empty((len(x), len(y)), bool)
    for i, (row, own) in enumerate(zip(x, size_x.tolist(), strict=True)):
        fair = (size_y * den >= own * num) & (own * den >= size_y * num)
        apart = np.zeros(len(y), np.int64)
        for k in range(x.shape[1]):
            apart += np.bitwise_count(y[:, k] ^ row[k])
        out[i] = fair & (apart * (den + num) <= (size_y + own) * (den - num))
    return out


def schemes(size: int, num: int, den: int) -> Iterator[tuple[int, int, int, int]]:
    """The schemes of a set's own band and of the one below: band, words m, spare words e, role (0: own band, 1: below)."""
    own = int(np.searchsorted(bands(num, den), size, "right")) - 1
    for role, band in enumerate((own, own - 1)):
        if band >= 0 and (d := largest_difference(band, num, den)):  # else only equal sets link, and they are one class
            spare = 1 + d // SPARE
            yield band, d + 1 + spare, spare, role


def _words(grams: np.ndarray, m: int, spare: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and parity hashes of the sketch words that serve as keys, and how many words do not.

    Words of few n-grams meet by chance. Those of at most one are left out, or else the empty ones, as long as they are
    two thirds of the spare words at most; else no word is left out.
    """
    word = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the n-grams are
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    value = np.bitwise_xor.reduceat(mixed((grams & np.uint64(WORD_BITS - 1)) + np.uint64(1)), first)
    where, many = word[first], np.diff(np.append(first, len(grams))) > 1
    most = 2 * spare // 3
    if m - int(many.sum()) <= most:
        return where[many], value[many], m - int(many.sum())
    if m - len(where) <= most:
        return where, value, m - len(where)
    gone = np.setdiff1d(np.arange(m, dtype=np.uint64), where)
    return np.concatenate([where, gone]), np.concatenate([value, np.zeros(len(gone), np.uint64)]), 0


def segment_keys(grams: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set, its sketch words in each scheme, and a tag.

    The tag has the role there (1 bit), the log2 of the sure matches (2 bits: 8 at most are asked for), and whether a
    partner may have half as many (1 bit).
    """
    keys, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band, m, spare, role in schemes(len(grams), num, den):
        where, value, left = _words(grams, m, spare)
        keys.append(mixed(value + mixed(where + np.uint64((band + 1) << 40))))
        sure = min(3, (1 + spare - left).bit_length() - 1)
        least = min(3, (1 + spare - 2 * spare // 3).bit_length() - 1)  # of a partner that leaves out all it may
        tags.append(np.full(len(where), role | sure << 1 | (least < sure) << 3, np.int64))
    return np.concatenate(keys), np.concatenate(tags)


def sure_matches(tag: np.ndarray) -> np.ndarray:
    """Keys that the set shares with a linked one for sure, if the other has no fewer sure ones."""
    return 1 << (tag >> 1 & 3)


def least_matches(tag: np.ndarray) -> np.ndarray:
    """Keys that the set shares with any linked one for sure."""
    return np.maximum(1, sure_matches(tag) >> (tag >> 3 & 1))


def signatures(docs: DataFrame, words: int, num: int, den: int, text: str, ident: str) -> DataFrame:
    """Per row: ident, n_shingles, cls (hash of the set; null if empty), proof (a second hash)."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            sets = ngram_sets(data, offsets, words)
            both = [set_hashes(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c for c, _ in both], pa.int64()), pa.array([c for _, c in both], pa.int64())],
                ["ident", "n_shingles", "cls", "proof"],
            )

    return docs.select(docs[ident].alias("ident"), docs[text].alias("text")).mapInArrow(run, f"ident {kind}, n_shingles bigint, cls bigint, proof bigint")


def dealt(keys: list[np.ndarray], owners: list[np.ndarray], lanes: int) -> Iterator[pa.RecordBatch]:
    """Keys and owners by lane, taken out of the lists; one batch for each of ``SHARES`` shares of the lanes, so that temporaries stay small."""
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    keys.clear()
    owners.clear()
    share = (key % np.uint64(SHARES)).astype(np.int8)  # of the lane too, as their number is a multiple
    for k in range(SHARES):
        if (mine := share == k).any():
            yield _lane_rows(key[mine], owner[mine], lanes)


def _lane_rows(key: np.ndarray, owner: np.ndarray, lanes: int) -> pa.RecordBatch:
    """Of a group that is large already here, ``SMALL_GROUP`` + 1 sets go on; the others are members of the first one's group for sure."""
    order = np.lexsort((owner, owner & 1, key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    beyond = np.arange(len(key)) - np.repeat(first, size) > SMALL_GROUP
    edges, many = np.unique(np.stack([owner[np.repeat(first, size)[beyond]] & ~15, owner[beyond]], 1), axis=0, return_counts=True)
    key, owner = key[~beyond], owner[~beyond]
    lane = np.concatenate([(key % np.uint64(lanes)).astype(np.int32), (edges[:, 1].view(np.uint64) // np.uint64(16) % np.uint64(lanes)).astype(np.int32)])
    values = np.concatenate([signed(key), edges[:, 0]]), np.concatenate([owner, edges[:, 1]])
    kind = np.repeat([0, 1], [len(key), len(edges)])
    order = np.lexsort((lane, kind))
    group = kind[order] * lanes + lane[order]
    found, at = np.unique(group, return_index=True)
    ends = np.append(at, len(order))
    many = lists(many[order[len(key) :] - len(key)].astype(np.int32), np.maximum(0, ends - len(key)))  # of members alone, which come last
    return pa.RecordBatch.from_arrays(
        [pa.array((found % lanes).astype(np.int32)), pa.array(found >= lanes), lists(values[0][order], ends), lists(values[1][order], ends), many], ["lane", "edge", "keys", "owners", "many"]
    )


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``met`` from rows in order of their lanes; one lane's keys are held at a time."""
    last, keys, owners = None, [], []
    for batch in batches:
        for lane, edge, key, owner, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
            if lane != last:
                yield from _meetings(keys, owners)
                last, keys, owners = lane, [], []
            if edge:
                yield _members(np.asarray(key.values), np.asarray(owner.values), np.asarray(many.values))
            else:
                keys.append(np.asarray(key.values).view(np.uint64))
                owners.append(np.asarray(owner.values))
    yield from _meetings(keys, owners)


def _meetings(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of ``met`` from all keys of a lane."""
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    role = (owner & 1).astype(bool)
    mixed_roles = np.add.reduceat(~role, first) > 0
    first, size = first[mixed_roles], size[mixed_roles]
    pairs = []
    for s in range(2, SMALL_GROUP + 1):
        at = first[size == s]
        if len(at):
            i, j = np.triu_indices(s, 1)
            x, y = owner[at[:, None] + i].ravel(), owner[at[:, None] + j].ravel()
            keep = (x & y & 1) == 0
            pairs.append(np.sort(np.stack([x[keep], y[keep]], 1), 1))
    if pairs:
        pair, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        yield _shown(pair[:, 0] & ~15, pair[:, 1] & ~15, pair[:, 0] & 1, pair[:, 1] & 1, n, np.minimum(sure_matches(pair[:, 0] & 15), sure_matches(pair[:, 1] & 15)))
    stars = []
    for f, k in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        own = owner[f : f + k]
        stars.append(np.stack([np.full(k, own.min() & ~15), own], 1))
    if stars:
        star, many = np.unique(np.concatenate(stars), axis=0, return_counts=True)
        yield _members(star[:, 0], star[:, 1], many)


def _members(hub: np.ndarray, owner: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return _shown(hub, owner & ~15, np.full(len(hub), -1), owner & 1, many, least_matches(owner & 15))


def _shown(a: np.ndarray, b: np.ndarray, *small: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(x.astype(np.int32)) for x in small)], ["a", "b", "ra", "rb", "n", "need"])


def met(docs: DataFrame, words: int, num: int, den: int, text: str) -> DataFrame:
    """Classes that share keys, as rows a, b, ra, rb, n, need.

    Pairs in groups up to ``SMALL_GROUP``: classes and roles, shared keys, sure matches. Members of larger groups: the first
    class of the group, the member, -1, its role, the number of such groups, its least matches; the first is its own member.
    Sets that are both of the upper band of a scheme meet in their own scheme, so not here.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = SHARES * parts

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has emitted; forgetting some costs only repeated rows
        keys, owners, held = [], [], 0
        for _, data, offsets in slices(batches):
            if len(seen) > 1 << 20:
                seen.clear()
            for grams in ngram_sets(data, offsets, words):
                if len(grams) and (cls := set_hash(grams)) not in seen:
                    seen.add(cls)
                    got, tag = segment_keys(grams, num, den)
                    keys.append(got)
                    owners.append(cls + tag)
                    held += len(got)
            if held > HELD_KEYS:
                yield from dealt(keys, owners, lanes)
                held = 0
        yield from dealt(keys, owners, lanes)

    rows = docs.select(docs[text].alias("text")).mapInArrow(keyed, "lane int, edge boolean, keys array<bigint>, owners array<bigint>, many array<int>")
    return rows.repartitionById(parts, F.col("lane") % parts).sortWithinPartitions("lane").mapInArrow(grouped, "a bigint, b bigint, ra int, rb int, n int, need int")


def candidates(found: DataFrame) -> DataFrame:
    """Edges a, b between classes that may be linked, directly or by way of a group, from the rows of ``met`` (summed up)."""
    large = found.filter("ra < 0")
    # In how many large groups a class is; copies of a text that several tasks have seen may count twice, which keeps more.
    held = large.groupBy("b", "rb").agg(F.sum("n").alias("held"))
    # A first class keeps its edges: one group may have several, one from each task that had a large part of it.
    first = large.select(F.col("a").alias("b")).distinct().withColumn("first", F.lit(True))
    kept = (F.col("held") >= F.col("need")) | F.coalesce("first", F.lit(False))
    stars = large.join(held, ["b", "rb"]).join(first, "b", "left").filter(kept & (F.col("a") != F.col("b"))).select("a", "b")
    of = lambda x: held.select(F.col("b").alias(x), F.col("rb").alias(f"r{x}"), F.col("held").alias(f"held_{x}"))
    pairs = found.filter("ra >= 0").join(of("a"), ["a", "ra"], "left").join(of("b"), ["b", "rb"], "left")
    most = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    return pairs.filter(F.col("n") + most >= F.col("need")).select("a", "b").unionByName(stars).distinct()


def _bit_table(ids: DataFrame) -> bytes:
    """A bit table of ``FILTER_BITS`` of the ids; a set bit may be a chance hit, a clear one is certain."""
    place = F.pmod("cls", F.lit(FILTER_BITS))
    rows = ids.select(F.shiftright(place, 16).alias("seg"), place.bitwiseAND(F.lit(65535)).cast("int").alias("bit"))
    rows = rows.groupBy("seg").agg(F.collect_set("bit").alias("bits"))  # at most 65,536 a group

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column(1):
                flags = np.zeros(65536, np.uint8)
                flags[np.asarray(bits.values)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["seg", "table"])

    table = bytearray(FILTER_BITS // 8)
    for row in rows.mapInArrow(pack, "seg bigint, table binary").collect():  # FILTER_BITS / 8 bytes at most
        table[row["seg"] * 8192 : (row["seg"] + 1) * 8192] = row["table"]
    return bytes(table)


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text: str, table: Broadcast) -> DataFrame:
    """The n-gram sets of the wanted classes: cls, grams. One scan; the bit table keeps other sets at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        seen: set[int] = set()
        for _, data, offsets in slices(batches):
            cls, grams = [], []
            if len(seen) > 1 << 20:
                seen.clear()
            for s in ngram_sets(data, offsets, words):
                if not len(s):
                    continue
                c = set_hash(s)
                place = c % FILTER_BITS
                if bits[place >> 3] >> (place & 7) & 1 and c not in seen:
                    seen.add(c)
                    cls.append(c)
                    grams.append(s)
            if cls:
                ends = np.cumsum([0, *map(len, grams)])
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), lists(signed(np.concatenate(grams)), ends)], ["cls", "grams"])

    found = docs.select(docs[text].alias("text")).mapInArrow(run, "cls bigint, grams array<bigint>")
    return found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _placed(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where each class of a family is verified: cls, label (its family), home, block, blocks.

    Large families have a home of their own and are cut into blocks by hash; small ones are put together, a block each home.
    """
    members = components(edges).join(sizes, F.col("node") == F.col("cls")).select("cls", "label", "n_shingles")
    needs = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_GRAMS))).cast("int")
    families = members.groupBy("label").agg(needs.alias("blocks"), F.sum("n_shingles").alias("grams"))
    families = checkpointed(families)
    many = families.filter("blocks = 1").agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0] // BLOCK_GRAMS + 1
    home = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("label"), F.lit(many))).otherwise(F.abs("label"))
    families = families.select("label", "blocks", home.alias("home"))
    return checkpointed(members.join(families, "label").select("cls", "label", "home", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), "blocks"))


def common(x: list[np.ndarray], y: list[np.ndarray], alive: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets x with the sets y, at least where ``alive``."""
    out = np.zeros(alive.shape, np.int32)
    where = np.nonzero(alive)
    if len(where[0]) <= 4 * sum(alive.shape):
        for i, j in zip(*where, strict=True):
            out[i, j] = len(np.intersect1d(x[i], y[j], assume_unique=True))
        return out
    rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    held = [x[i] for i in rows.tolist()] + [y[j] for j in cols.tolist()]
    gram, of = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(s) for s in held])
    order = np.argsort(gram, kind="stable")  # stable: those of x come first
    gram, of = gram[order], of[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    first = np.flatnonzero(new)
    left = np.add.reduceat((of < len(rows)).astype(np.int32), first)
    use = (left > 0) & (np.diff(np.append(first, len(gram))) > left)  # n-grams on both sides
    column = np.cumsum(use) - 1
    shown = np.repeat(use, np.diff(np.append(first, len(gram))))
    of, place = of[shown], column[np.cumsum(new) - 1][shown]
    total = np.zeros((len(rows), len(cols)), np.float32)
    for start in range(0, int(use.sum()), COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        grid = np.zeros((len(held), COLUMNS), np.float32)
        grid[of[a:b], place[a:b] - start] = 1
        total += grid[: len(rows)] @ grid[len(rows) :].T
    out[np.ix_(rows, cols)] = total
    return out


def linked(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of x are linked with which of y: those that sketches leave possible, verified."""
    out = np.zeros((len(x), len(y)), bool)
    for i in range(0, len(x), STEP):
        some, size = x[i : i + STEP], np.array([len(s) for s in x[i : i + STEP]], np.int64)
        flat = sketches(some)
        for j in range(0, len(y), STEP):
            others, sizes = y[j : j + STEP], np.array([len(s) for s in y[j : j + STEP]], np.int64)
            alive = possible(flat, sketches(others), size, sizes, num, den)
            both = common(some, others, alive).astype(np.int64)
            out[i : i + STEP, j : j + STEP] = alive & (both * den >= (size[:, None] + sizes[None, :] - both) * num)
    return out


def _connected(links: np.ndarray) -> np.ndarray:
    """The least number that each row, and then each column, of a matrix of links is connected with; rows are numbered before columns."""
    rows, cols = np.arange(links.shape[0], dtype=np.int32), np.arange(links.shape[1], dtype=np.int32) + np.int32(links.shape[0])
    none = np.int32(1 << 30)
    while True:
        before = rows.copy()
        for i in range(0, len(rows), STEP):
            cols = np.minimum(cols, np.where(links[i : i + STEP], rows[i : i + STEP, None], none).min(0, initial=none))
        for i in range(0, len(rows), STEP):
            rows[i : i + STEP] = np.minimum(rows[i : i + STEP], np.where(links[i : i + STEP], cols[None, :], none).min(1, initial=none))
        if (rows == before).all():
            return np.concatenate([rows, cols])


def _verified(edges: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, num: int, den: int, text: str, pairs: bool) -> DataFrame:
    """All links among the families of the edges, written to the checkpoint folder.

    With ``pairs``: a, b. Else per class and pair of blocks: cls, n (links there), least (a class it is connected with there).
    """
    places = _placed(edges, sizes)
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(places.select("cls")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    needs = places.select("cls", "label", "home", "block", other).select("cls", "label", "home", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    sets = needs.join(_sets(docs, places.select("cls"), words, text, table), "cls")

    def found(x: list[np.ndarray], y: list[np.ndarray], of_x: np.ndarray, of_y: np.ndarray, own: bool) -> pa.Table:
        links = linked(x, y, num, den)
        if pairs:
            at = np.nonzero(np.triu(links, 1) if own else links)
            both = np.sort(np.stack([of_x[at[0]], of_y[at[1]]], 1), 1)
            return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})
        if own:
            np.fill_diagonal(links, False)
        n, cls = np.concatenate([links.sum(1), links.sum(0)]), np.concatenate([of_x, of_y])
        if own:
            np.fill_diagonal(links, True)  # row and column of a set are one
        least = cls[_connected(links)]
        some = n > 0
        if own:
            some[len(of_x) :] = False
        return pa.table({"cls": cls[some], "n": n[some].astype(np.int64), "least": least[some]})

    def run(table: pa.Table) -> pa.Table:
        give_back()
        table = table.combine_chunks()
        cls, label, block = (table.column(c).to_numpy() for c in ("cls", "label", "block"))
        grams = table.column("grams").combine_chunks()
        ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        sets = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        out = []
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):  # one family, or the small ones of this home
            x, y = rows[block[rows] == lo].tolist(), rows[block[rows] == hi].tolist()
            if x and y:
                out.append(found([sets[i] for i in x], [sets[i] for i in y], cls[x], cls[y], lo == hi))
        return pa.concat_tables(out) if out else found([], [], cls[:0], cls[:0], False)

    kind = "a bigint, b bigint" if pairs else "cls bigint, n bigint, least bigint"
    links = checkpointed(sets.groupBy("home", "lo", "hi").applyInArrow(run, kind))
    table.destroy()
    return links


def _links(rows: DataFrame, docs: DataFrame, words: int, num: int, den: int, text: str, pairs: bool = False) -> DataFrame:
    sizes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"))
    found = met(docs, words, num, den, text).groupBy("a", "b", "ra", "rb").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    # Read three times; as columns, chance meetings take a third of the room that a checkpoint would take.
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/met_{uuid.uuid4().hex}"
    found.write.parquet(folder)
    edges = checkpointed(candidates(spark.read.schema(found.schema).parquet(folder)))  # chance meetings end here
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return _verified(edges, sizes, docs, words, num, den, text, pairs)


def links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The join: every pair (a, b) of linked classes, a < b, once. Rows of one class have equal sets."""
    return _links(checkpointed(signatures(docs, words, num, den, text, ident)), docs, words, num, den, text, pairs=True)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: ident, n_shingles, component_id, n_links (links of its class with other classes, all of them).

    Two rows link when ``den * |common| >= num * |union|`` of their n-gram sets.
    """
    rows = checkpointed(signatures(docs, words, num, den, text, ident))
    links = _links(rows, docs, words, num, den, text)
    labels = components(links, "cls", "least")
    degree = links.groupBy("cls").agg(F.sum("n").alias("n_links"))
    sure = F.when(F.min("proof") == F.max("proof"), F.min("ident")).otherwise(F.raise_error(F.lit("two n-gram sets have the same 64-bit hash")))
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(sure.alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(degree, "cls", "left")
    ids = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "label").select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("ident", "n_shingles", "cls").join(classes, "cls", "left")
    component: Column = F.when(F.col("cls").isNull(), F.col("ident")).otherwise(F.col("component_id"))
    return out.select(F.col("ident").alias(ident), "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
