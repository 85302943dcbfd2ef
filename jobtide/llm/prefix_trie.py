"""Prefix trie of conversations from sorted sequences and range minima over their common prefixes.

Rebuilt conversations are sorted by the digests of their turns, so that the members of a prefix stand side by side. Between
neighbours lies the length of their longest common prefix (LCP). A prefix of depth d that holds at row i covers the rows
around i between which no LCP falls below d; both ends are found apart from each other by binary search over a sparse
table of range minima. No stack is kept and no prefix waits for another one.

The sorted rows lie in blocks of a range shuffle (equal sequences may span several). A block works alone on its own
table; a prefix that leaves its block is found by a second sparse table over the least LCP of each block, which with
the LCPs at the borders is all the driver sees. Such a prefix gives one piece a block; pieces are added up by (block in
which the prefix begins, depth). Members, children, leaves and saved bytes of a prefix are sums over its rows, so pieces
add up without order; the ids of conversations that end at a prefix are sorted already and are hashed as a stream.

Texts stay where they are read: only digests and lengths are shuffled. A conversation is one row of digests (16 bytes a
turn), so one conversation has to fit into a task; groups of conversations don't.

Defined results: null roles and texts are empty; turns of equal number go by the digest of role and text, repeated rows are
turns of their own; rows without conv_id belong to no conversation; a conversation without turns left is a member of
the root alone; without conversations there is no node; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.session import checkpointed

#: Rows and turns of a block, on average; the number of blocks grows with the table.
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 20
#: Ids of conversations that end at one prefix travel in strings of so many.
CHUNK = 1024
NONE = hashlib.sha256(b"").hexdigest()
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests and bytes (arrays in the order of the turns) of each conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("one"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))  # null turns first
    return rows.select("conv_id", F.col("all.digest").alias("digests"), F.col("all.bytes").alias("bytes"))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Every conversation with its first h turns replaced by those of conversation c - c % ``group``; h = crc32(c) % (most + 1)."""
    own = sequences(conversations)
    source = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_source"), F.slice("digests", 1, most).alias("_digests"), F.slice("bytes", 1, most).alias("_bytes"))
    own = own.withColumn("_h", (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int"))
    rows = own.join(source, F.col("conv_id") - F.col("conv_id") % group == F.col("_source"), "left")
    head = lambda c: F.coalesce(F.slice(f"_{c}", F.lit(1), F.col("_h")), F.slice(c, 1, 0))
    tail = lambda c: F.slice(c, F.col("_h") + 1, F.size(c))
    whole = lambda c: F.when(F.size(c) > F.col("_h"), F.concat(head(c), tail(c))).otherwise(head(c))
    return rows.select("conv_id", F.unhex(F.array_join(whole("digests"), "")).alias("seq"), whole("bytes").alias("bytes"))


# Range minima


def sparse(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of the 2**k values from each place on."""
    levels = [values]
    while 2 * (width := 1 << (len(levels) - 1)) <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
    return levels


def left_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The nearest place at or before ``at`` whose value is below ``depth``; -1 if there is none."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        to = at - (1 << k)
        go = to >= -1
        go[go] = levels[k][to[go] + 1] >= depth[go]
        at[go] = to[go]
    return at


def right_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place from ``at`` on before a value (of a place behind ``at``) falls below ``depth``."""
    at, n = at.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        to = at + (1 << k)
        go = to < n
        go[go] = levels[k][at[go] + 1] >= depth[go]
        at[go] = to[go]
    return at


def range_min(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum from place ``first`` to place ``last``."""
    width = last - first + 1
    out = np.empty(len(first), levels[0].dtype)
    kind = np.frexp(width.astype(float))[1] - 1
    for k in np.unique(kind):
        m = kind == k
        out[m] = np.minimum(levels[k][first[m]], levels[k][last[m] - (1 << int(k)) + 1])
    return out


def common(digests: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it; the first has 0."""
    turns = np.diff(offsets)
    out = np.zeros(len(turns), np.int64)
    if len(turns) < 2:
        return out
    out[1:] = both = np.minimum(turns[1:], turns[:-1])
    pair = np.repeat(np.arange(1, len(turns)), both)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
    apart = np.flatnonzero((digests[offsets[pair] + k] != digests[offsets[pair - 1] + k]).any(1))
    rows, first = np.unique(pair[apart], return_index=True)
    out[rows] = k[apart[first]]
    return out


# Blocks


@dataclass
class Block:
    """The sorted rows of one block."""

    ident: int
    conv: np.ndarray
    digests: np.ndarray  # two words a turn
    bytes: np.ndarray
    offsets: np.ndarray  # turns before each row


def _block(batches: Iterator[pa.RecordBatch]) -> Block | None:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts).combine_chunks()
    conv = table.column("conv_id").combine_chunks().to_numpy()
    seq = table.column("seq").combine_chunks().cast(pa.large_binary())
    at = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    raw = seq.buffers()[2]
    words = np.frombuffer(raw, np.uint64, (int(at[-1]) - int(at[0])) // 8, int(at[0])) if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint64)
    size = table.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return Block(int(table.column("block")[0].as_py()), conv, words.reshape(-1, 2), size, (at - at[0]) // 16)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = _block(batches)
    if b:
        lcp = common(b.digests, b.offsets)
        least = int(lcp[1:].min()) if len(lcp) > 1 else None
        ends = [b.digests[x:y].tobytes() for x, y in ((b.offsets[0], b.offsets[1]), (b.offsets[-2], b.offsets[-1]))]
        yield pa.RecordBatch.from_arrays([pa.array([b.ident]), pa.array([least], pa.int64()), *(pa.array([e], pa.binary()) for e in ends)], ["block", "least", "first", "last"])


@dataclass
class Borders:
    """Blocks that have rows in order, the LCP at the border before each (-1 before the first, one more behind the last), and the range minima of whole blocks."""

    place: dict[int, int]
    before: np.ndarray
    levels: list[np.ndarray]


def borders(blocks: DataFrame) -> Borders:
    """Two rows of digests and a number of each block come to the driver."""
    got = blocks.mapInArrow(_summary, "block bigint, least bigint, first binary, last binary").toArrow().to_pylist()
    got.sort(key=lambda r: r["block"])
    before = np.full(len(got) + 1, -1, np.int64)
    for k in range(1, len(got)):
        both = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in (got[k - 1]["last"], got[k]["first"])]
        n = min(len(both[0]), len(both[1]))
        apart = np.flatnonzero((both[0][:n] != both[1][:n]).any(1))
        before[k] = apart[0] if len(apart) else n
    least = np.array([min(int(before[k]), r["least"] if r["least"] is not None else 1 << 60) for k, r in enumerate(got)], np.int64)
    return Borders({r["block"]: k for k, r in enumerate(got)}, before, sparse(least))


PIECE = {
    "block": pa.int64(), "start": pa.int64(), "partial": pa.bool_(), "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "shared": pa.int64(), "base": pa.int64(), "parent_conv_id": pa.int64(), "parent_start": pa.int64(), "ends_sha256": pa.string(), "ids": pa.list_(pa.string()),
}
_DDL = ", ".join(f"{k} {'array<string>' if k == 'ids' else 'string' if k == 'ends_sha256' else 'boolean' if k == 'partial' else 'bigint'}" for k in PIECE)


def pieces(b: Block, edges: Borders) -> pa.RecordBatch:
    """All prefixes of a block's rows: complete ones, and pieces of those that go beyond its borders.

    ``start`` is the place of the block in which a prefix begins, which with its depth names it among the partial ones.
    """
    n, here = len(b.conv), edges.place[b.ident]
    turns = np.diff(b.offsets)
    lcp = common(b.digests, b.offsets)
    lcp[0] = edges.before[here]
    behind = int(edges.before[here + 1])
    table, least_conv = sparse(lcp), sparse(b.conv)
    # Candidates: each prefix at its first row in the block.
    low = lcp + 1
    low[0] = 0
    many = turns - low + 1
    row = np.repeat(np.arange(n), many)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]

    def extent(row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last row, the block in which the prefix begins, and whether it leaves the block."""
        first, last = left_end(table, row, depth), right_end(table, row, depth)
        entering = first < 0
        start = np.full(len(row), here)
        if entering.any():
            start[entering] = left_end(edges.levels, np.full(int(entering.sum()), here - 1), depth[entering])
        return np.maximum(first, 0), last, start, entering | ((last == n - 1) & (behind >= depth))

    first, last, start, partial = extent(row, depth)
    up = depth > 0
    p_first, p_last, p_start, p_partial = (np.zeros(len(row), x.dtype) for x in (first, last, start, partial))
    p_first[up], p_last[up], p_start[up], p_partial[up] = extent(row[up], depth[up] - 1)
    # Sums over rows.
    begins = depth > lcp[row]
    keys = np.sort(depth[begins] * (n + 1) + row[begins])
    children = np.searchsorted(keys, (depth + 1) * (n + 1) + last, "right") - np.searchsorted(keys, (depth + 1) * (n + 1) + first, "left")
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], behind) < turns)])
    sums = np.concatenate([[0], np.cumsum(b.bytes)])
    head = sums[b.offsets[:-1] + np.maximum(lcp, 0)] - sums[b.offsets[:-1]]  # bytes of what a row shares with the row before
    heads = np.concatenate([[0], np.cumsum(head)])
    shared = heads[last + 1] - heads[first] - np.where(start == here, head[first], 0)
    base = sums[b.offsets[row] + np.maximum(depth - 1, 0)] - sums[b.offsets[row]]
    # Conversations that end at the prefix: equal rows, first in its interval, by id.
    new = np.flatnonzero(np.append(True, ~((lcp[1:] == turns[1:]) & (turns[1:] == turns[:-1]))))
    until = dict(zip(new.tolist(), np.append(new[1:], n).tolist(), strict=True))
    sha: list[str | None] = []
    ids: list[list[str] | None] = []
    for r, ends, open_ in zip(row.tolist(), (turns[row] == depth).tolist(), partial.tolist(), strict=True):
        mine = list(map(str, b.conv[r : until[r]].tolist())) if ends else []
        sha.append(None if open_ else hashlib.sha256(",".join(mine).encode()).hexdigest() if mine else NONE)
        ids.append([",".join(mine[k : k + CHUNK]) for k in range(0, len(mine), CHUNK)] if open_ else None)
    known = up & ~p_partial
    parent = np.zeros(len(row), np.int64)
    parent[known] = range_min(least_conv, p_first[known], p_last[known])
    columns = [
        np.full(len(row), b.ident), start, partial, depth, range_min(least_conv, first, last), last - first + 1, children, leaf[last + 1] - leaf[first], shared, base,
        pa.array(parent, mask=~known), pa.array(p_start, mask=~(up & p_partial)), pa.array(sha, pa.string()), pa.array(ids, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, PIECE.values(), strict=True)], list(PIECE))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of strings of ids that come sorted by prefix and place; a prefix may run over any number of batches."""
    now, state = None, None
    for batch in batches:
        out = []
        for start, depth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if (start, depth) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (start, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _hashed(out)
    if now:
        yield _hashed([(*now, state.hexdigest())])


def _hashed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["start", "depth", "ends"])


def trie(sequences: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the prefix trie of rows (conv_id, seq, bytes): ``seq`` has 16 bytes a turn, ``bytes`` the turns' lengths."""
    spark = sequences.sparkSession
    rows = checkpointed(sequences)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("bytes")), F.lit(0)).alias("turns")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // block_rows), -(-size["turns"] // block_turns))
    rows = rows.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = checkpointed(rows.select("conv_id", "seq", "bytes", F.spark_partition_id().alias("block")))
    edges = spark.sparkContext.broadcast(borders(rows))  # some numbers a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _block(batches)
        if b:
            yield pieces(b, edges.value)

    found = checkpointed(rows.mapInArrow(run, _DDL))
    saved = F.col("shared") - (F.col("n_convs") - 1) * F.col("base")
    whole = found.filter(~F.col("partial")).withColumn("saved_tokens", saved)
    # Prefixes over several blocks: at most the LCPs at the borders, a few a block.
    part = found.filter("partial")
    ids = part.select("start", "depth", "block", F.posexplode("ids").alias("k", "text"))
    ids = ids.repartition("start", "depth").sortWithinPartitions("start", "depth", "block", "k")
    ends = ids.mapInArrow(_digests, "start bigint, depth bigint, ends string")
    sums = part.groupBy("start", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")], F.max("base").alias("base"), F.min("parent_start").alias("parent_start")
    )
    sums = checkpointed(sums.join(ends, ["start", "depth"], "left").withColumn("saved_tokens", saved).withColumn("ends_sha256", F.coalesce("ends", F.lit(NONE))))
    above = sums.select(F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    wide = sums.join(above, ["parent_start", "depth"], "left").withColumn("parent_conv_id", F.col("_parent"))
    # Prefixes of one block below such a prefix: the block is part of the key, so a parent has at most a block's rows.
    here = part.select("block", F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth")).join(above, ["parent_start", "depth"])
    below = whole.filter(F.col("parent_start").isNotNull()).join(here, ["block", "parent_start", "depth"]).withColumn("parent_conv_id", F.col("_parent"))
    inside = whole.filter(F.col("parent_start").isNull())
    return inside.select(*RESULT).unionByName(below.select(*RESULT)).unionByName(wide.select(*RESULT))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(conversations))


def oracle() -> str:
    """The same nodes in SQL: every prefix as a list of turns, ancestors by slices of it."""
    return """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) AS t(i))),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS ts FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 9 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN s.ts IS NULL OR a.h = 0 THEN a.ts[1:0] ELSE s.ts[1:a.h] END, a.ts[a.h + 1:]) AS ts
  FROM heads a LEFT JOIN own s ON s.conv_id = a.conv_id - a.conv_id % 5),
members AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN ts[1:0] ELSE ts[1:d] END AS p, len(ts) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(ts[d].x) END AS w
  FROM rebuilt, unnest(range(0, len(ts) + 1)) AS u(d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM members GROUP BY p, d),
kids AS (SELECT CASE WHEN d = 1 THEN p[1:0] ELSE p[1:d - 1] END AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
named AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
subtrees AS (
  SELECT CASE WHEN e = 0 THEN p[1:0] ELSE p[1:e] END AS p, sum((n_convs - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM named, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM named a JOIN subtrees s USING (p) LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = CASE WHEN a.d = 1 THEN a.p[1:0] ELSE a.p[1:a.d - 1] END
"""
