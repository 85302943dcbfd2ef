"""Token counts of byte-level BPE by a compiled finite-state transducer.

The tokenizer becomes two machines. The first cuts a text into pieces as the vocabulary's pre-tokenizer does; it needs
one character of context only, so it runs on whole arrays of character classes. The second reads the bytes of a piece.
A known fact of BPE carries it: the last token of the encoding of every prefix is unique, and a token may follow
another exactly if the pair, encoded together, stays that pair. So a state is the set of unfinished vocabulary prefixes
that end here, each with the token before it and the number of tokens there relative to here; its transition on a byte
is annotated with the change of the token count (which can be negative: letters join into longer tokens). States are
finite in number. The driver compiles those that a few texts need and broadcasts them; workers determinise the others
on first use; when ``MAX_STATES`` are held the table starts anew, which costs time, never exactness.

Texts are cut into chunks of ``CHUNK`` bytes that step through the table side by side. A chunk starts in an unknown
state; its state map becomes constant at its first piece start. The maps are composed by a scan over the chunks: what
leaves chunk k enters chunk k + 1, whose head is then replayed; chunks without any piece start pass states on in
further rounds.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each for itself; an empty
table gives an empty result; very long texts are handled in chunks like all others; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from jobtide.llm.textvec import slices

CHUNK = 1024
MAX_STATES = 400_000
SLICE = 2 << 20  # bytes of text between two looks at the size of the table
#: The contractions of the pre-tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points that count as white space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, BLANK, SPACE = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point. Code points that this Python doesn't know yet are asked of the library."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(k))[0], OTHER) for k in range(0x110000)], np.uint8)
    later = regex.compile(r"[\p{L}\p{N}]+")
    some = [k for k in np.flatnonzero(table == OTHER).tolist() if not 0xD800 <= k < 0xE000 and later.match(chr(k))]
    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    for kind, sign in ((LETTER, "a"), (NUMBER, "1")):
        shown = "".join(f"{sign}{chr(k)}\n" for k in some)
        starts = np.zeros(len(shown), bool)
        starts[[span[0] for _, span in cut.pre_tokenize_str(shown)]] = True
        table[[k for i, k in enumerate(some) if not starts[3 * i + 1]]] = kind
    table[list(WHITE)] = BLANK
    table[32] = SPACE
    return table


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a piece. ``first`` marks the characters that begin a text."""
    n = len(points)
    kind = classes[points]
    white = kind >= BLANK
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_white = np.empty(n, bool)
    after_white[0], after_white[1:] = False, white[:-1]
    after_white &= ~first
    after_space = after_white & (before == SPACE)
    ends = np.empty(n, bool)  # the next character belongs to another text, or there is none
    ends[-1], ends[:-1] = True, first[1:]
    next_white = np.empty(n, bool)
    next_white[-1], next_white[:-1] = True, white[1:]
    start = first.copy()
    start |= ~white & ~after_space & (after_white | (kind != before))
    start |= white & ~after_white
    start |= white & ~next_white & ~ends  # the last blank before a word stands alone or joins the word
    quotes = np.flatnonzero((points == 39) & start & ~ends)
    if len(quotes):
        limit = np.append(np.flatnonzero(first), n)
        stop = limit[np.searchsorted(limit, quotes, "right")]
        done = np.zeros(len(quotes), bool)
        for word in CONTRACTIONS:
            fits = ~done & (quotes + len(word) < stop)
            for k, letter in enumerate(word):
                fits[fits] = points[quotes[fits] + 1 + k] == ord(letter)
            at = quotes[fits]
            start[at + 1] = False
            nxt = at + len(word) + 1
            inside = nxt < stop[fits]
            nxt = nxt[inside]
            start[nxt[~white[nxt]]] = True  # a blank run there has begun by its own rule
            done |= fits
    return start


class Vocabulary:
    """Tokens and merges, and the trie of the tokens' bytes."""

    FEW = 16

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.rank = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((raw(a), raw(b)), k)
        added = {t["content"] for t in spec["added_tokens"]}
        tokens = {raw(t) for t in model["vocab"] if t not in added}
        self.words: list[bytes | None] = [None]  # per node: its bytes, if they are a token
        self.below: list[dict[int, int]] = [{}]
        #: Per token: its last merge (rank and both parts); bytes have none.
        last = {t: self._last_merge(t) for t in tokens}
        for token in sorted(t for t in tokens if last[t] is not None):
            node = 0
            for byte in token:
                if byte not in self.below[node]:
                    self.below[node][byte] = len(self.below)
                    self.below.append({})
                    self.words.append(None)
                node = self.below[node][byte]
            self.words[node] = token
        #: Per node: the token nodes strictly below it, or None if they are more than FEW.
        self.longer: list[list[int] | None] = [None] * len(self.below)
        for node in reversed(range(len(self.below))):
            found: list[int] | None = []
            for child in self.below[node].values():
                found = None if found is None or self.longer[child] is None else found + [child] * (self.words[child] is not None) + self.longer[child]
            self.longer[node] = found if found is not None and len(found) <= self.FEW else None
        place = {word: node for node, word in enumerate(self.words) if word is not None}
        self.order = [-1] * len(self.words)  # rank of the last merge, and the nodes of its parts
        self.parts: list[tuple[int, int] | None] = [None] * len(self.words)
        for word, node in place.items():
            if len(word) > 1:
                self.order[node], left, right = last[word]
                self.parts[node] = place[left], place[right]
        self.joins = {(place[a], place[b]): rank for (a, b), rank in self.rank.items() if a in place and b in place}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _last_merge(self, word: bytes) -> tuple[int, bytes, bytes] | None:
        """Rank and parts of the merge that ends the encoding of a token; None if it isn't encoded as itself."""
        if len(word) == 1:
            return -1, word, b""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.rank[parts[0], parts[1]], parts[0], parts[1]) if (parts[0], parts[1]) in self.rank else None

    def encode(self, word: bytes) -> list[bytes]:
        """Plain BPE: merge the pair of lowest rank until none is left."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """True if the tokens of nodes a and b, encoded together, stay these two tokens.

        Seen backwards, the merges of both are undone, the latest first. At every stage the two pieces at the border would
        merge if their pair ranks before the merge that is undone next; on equal rank the one further left goes first.
        """
        key = (a, b)
        if key not in self._pairs:
            if len(self._pairs) > 1 << 18:
                self._pairs.clear()
            self._pairs[key] = self._apart(a, b)
        return self._pairs[key]

    def _apart(self, a: int, b: int) -> bool:
        order, parts, joins = self.order, self.parts, self.joins
        before = 1 << 40  # a pair that ranks below this would have merged across the border
        while True:
            if joins.get((a, b), 1 << 40) < before:
                return False
            if order[a] < 0 and order[b] < 0:
                return True
            if order[a] > order[b]:
                before, a = order[a], parts[a][1]
            else:
                before, b = order[b] + 1, parts[b][0]


class Transducer:
    """Byte transitions with count annotations, determinised on first use. State 0: start of a piece; 1: unknown.

    A state is a tuple of (node, token before it, tokens there less tokens here). Where few tokens lie below a node, the
    token before is replaced by the set of them that it admits, as a bit mask stored as -2 - mask: states that admit the
    same continuations are one. -1 stands for the start of a piece, before which all are admitted.
    """

    START, UNKNOWN = 0, 1

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.classes = char_classes()
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 16
        self.keys = np.full(self.slots, -1, np.int64)  # open addressing: state and byte, to the next state and the count
        self.next = np.zeros(self.slots, np.int32)
        self.emit = np.zeros(self.slots, np.int8)
        self.used = 0
        self.states: list[tuple | None] = [((0, -1, 0),), None]
        self.index = {state: k for k, state in enumerate(self.states)}

    def _narrowed(self, node: int, before: int, child: int) -> int | None:
        """What a child keeps of the token before its node; None if nothing below it is admitted."""
        voc = self.vocabulary
        if (few := voc.longer[child]) is None:
            return before
        if before < -1:
            mask, above = -2 - before, voc.longer[node]
            kept = sum(1 << k for k, x in enumerate(few) if mask >> above.index(x) & 1)
        else:
            kept = sum(1 << k for k, x in enumerate(few) if before == -1 or voc.may_follow(before, x))
        return -2 - kept if kept else None

    def _admits(self, node: int, before: int, child: int) -> bool:
        if before < -1:
            return bool((-2 - before) >> self.vocabulary.longer[node].index(child) & 1)
        return before == -1 or self.vocabulary.may_follow(before, child)

    def resolve(self, state: int, byte: int) -> None:
        """Compile one transition."""
        voc, change, last, going = self.vocabulary, 0, None, []
        for node, before, count in self.states[state] or ():
            child = voc.below[node].get(byte)
            if child is None:
                continue
            if last is None and voc.words[child] is not None and self._admits(node, before, child):
                last, change = child, count + 1
            if voc.below[child] and (kept := self._narrowed(node, before, child)) is not None:
                going.append((child, kept, count))
        target = None if state == self.UNKNOWN else (*((n, b, c - change) for n, b, c in going), (0, last, 0))
        k = self.index.get(target)
        if k is None:
            k = self.index[target] = len(self.states)
            self.states.append(target)
        if self.used * 2 > self.slots:
            self._grow()
        self._put(state << 8 | byte, k, change)

    def _place(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40 & self.slots - 1

    def _put(self, key: int, state: int, change: int) -> None:
        at = self._place(key)
        while self.keys[at] >= 0:
            at = at + 1 & self.slots - 1
        self.keys[at], self.next[at], self.emit[at] = key, state, change
        self.used += 1

    def _grow(self) -> None:
        full = np.flatnonzero(self.keys >= 0)
        old = self.keys[full].tolist(), self.next[full].tolist(), self.emit[full].tolist()
        self.slots *= 4
        self.keys, self.next, self.emit, self.used = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int8), 0
        for entry in zip(*old, strict=True):
            self._put(*entry)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't compiled."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)
        found = self.keys[at]
        miss = np.flatnonzero(found != keys)
        while len(miss):
            empty = found[miss] < 0
            at[miss[empty]] = -1
            miss = miss[~empty]
            at[miss] = at[miss] + 1 & self.slots - 1
            found[miss] = self.keys[at[miss]]
            miss = miss[found[miss] != keys[miss]]
        return at

    def step(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for every lane: the states reached and the counts emitted."""
        keys = states.astype(np.int64) << 8 | chars
        at = self._find(keys)
        if len(at) and at.min() < 0:
            for key in np.unique(keys[at < 0]).tolist():
                self.resolve(key >> 8, key & 255)
            at = self._find(keys)
        return self.next[at], self.emit[at]

    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The count emitted at every byte. ``starts``: marks the bytes that begin a piece; the first byte does."""
        if len(self.states) > MAX_STATES:
            self.clear()
        n = len(data)
        lanes = -(-n // CHUNK)
        grid = lambda x: np.ascontiguousarray(np.pad(x, (0, lanes * CHUNK - n)).reshape(lanes, CHUNK).T)
        chars, begins = grid(data), grid(starts)
        begins.reshape(-1)[0] = True
        out = np.zeros((CHUNK, lanes), np.int8)
        # Every chunk from an unknown state: constant from its first piece start on.
        states = np.full(lanes, self.UNKNOWN, np.int32)
        for k in range(CHUNK):
            states[begins[k]] = self.START
            states, out[k] = self.step(states, chars[k])
        head = np.where(begins.any(0), begins.argmax(0), CHUNK)
        # Scan: the state that leaves a chunk enters the next one; its head is replayed from there.
        todo = np.flatnonzero(head)
        while len(todo):
            now = todo[states[todo - 1] != self.UNKNOWN]
            ready, entering = now, states[now - 1]
            for k in range(int(head[ready].max())):
                live = head[ready] > k
                ready, entering = ready[live], entering[live]
                entering, out[k, ready] = self.step(entering, chars[k, ready])
                passed = head[ready] == CHUNK
                if k == CHUNK - 1:
                    states[ready[passed]] = entering[passed]
            todo = np.setdiff1d(todo, now, assume_unique=True)
        return out.T.reshape(-1)[:n]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


#: Texts, and bytes of each, that the driver compiles transitions from before the work begins.
WARM_TEXTS, WARM_BYTES = 400, 2000


def compiled(docs: DataFrame, path: str, text: str = "text") -> Transducer:
    """The transducer with the transitions that some texts need, so that workers begin with the frequent ones.

    What else a worker meets it compiles itself: results don't depend on the texts, which are the first ones at hand.
    """
    machine = transducer(path)
    if len(machine.states) < WARM_TEXTS:  # once a process
        some = docs.select(F.substring(docs[text], 1, WARM_BYTES).alias("text")).limit(WARM_TEXTS).toArrow().combine_chunks()
        for _, data, offsets in slices(iter(some.to_batches()), most=SLICE):
            count(data, offsets, machine)
    return machine


def count(data: np.ndarray, offsets: np.ndarray, machine: Transducer) -> np.ndarray:
    """Tokens of each text; special strings inside a text are one token each, as the library takes them."""
    n = len(data)
    if not n:
        return np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    bounds = np.zeros(n + 1, bool)  # byte places where a text or a special string begins or ends
    bounds[offsets] = True
    special = np.zeros(n, bool)
    for word in machine.vocabulary.special:
        at = raw.find(word)
        while at >= 0:
            stop = at + len(word)
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, stop, "left"):
                bounds[[at, stop]] = True
                special[at:stop] = True
            at = raw.find(word, stop)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(n, bool)
    starts[lead[piece_starts(points, bounds[lead], machine.classes)]] = True
    emitted = machine.run(data, starts)
    if special.any():
        emitted = emitted.copy()
        emitted[special] = 0
        emitted[np.flatnonzero(special & bounds[:n])] = 1
    total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_held: dict[str, Transducer] = {}


def held(path: str, shared: Broadcast) -> Transducer:
    """The worker's own transducer: the driver's at first, then with all that the worker has compiled, for later jobs too."""
    if path not in _held:
        _held[path] = shared.value
    return _held[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: ident, n_bytes, n_tokens, over_limit (n_tokens > limit). ``path``: a byte-level BPE file."""
    kind = docs.schema[ident].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(compiled(docs, path, text))  # vocabulary and a bounded table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held(path, shared)
        for batch, data, offsets in slices(batches, most=SLICE):
            tokens = count(data, offsets, machine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], [ident, "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(docs[ident], docs[text].alias("text"))
    return rows.mapInArrow(run, f"{ident} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
