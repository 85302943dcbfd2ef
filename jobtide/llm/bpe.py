"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never end up in one token, so the place between
them is a certain cut: BPE on both sides is independent. A text is normalised and split into words as the vocabulary
file says; each word is cut at its forced boundaries (once per task for each distinct word); fragments are encoded independently and the ids are concatenated. Decoding maps ids to token strings joined by blanks, as the library
does for a file without decoder.

Defined results: null and empty texts have no ids and decode to the empty text; special strings inside a text become
their ids; a symbol outside the vocabulary is left out, as the library does without an unknown token; repeated rows are
encoded each for itself; an empty table gives an empty result; very long texts are handled whole; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from jobtide.llm.textvec import slices, with_text

#: A task's memory of words starts anew beyond so many entries.
MEMORY = 1 << 18
SLICE = 1 << 20
#: All code points below were assigned before the library versions at hand.
_FAR = re.compile("[\u0500-\U0010ffff]")
#: Code points that count as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0  -     　"


class Codec:
    """Encoder and decoder of a word-end BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = dict(zip([*shown, *hidden], [*map(chr, shown), *(chr(256 + k) for k in range(len(hidden)))], strict=True))
        self.sign = [sign[b] for b in range(256)]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = list(dict.fromkeys(tuple(merge if isinstance(merge, list) else merge.split(" ")) for merge in model["merges"]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}"))
        self.library = Tokenizer.from_file(path)
        self.disputed, self.exact = self._disputed_letters()
        self.joined = self._pairs_inside()
        self.inner, self.final = BPE(self.vocab, merges), BPE(self.vocab, merges, end_of_word_suffix=self.end)

    def _disputed_letters(self) -> tuple[re.Pattern, re.Pattern]:
        """Unicode versions differ between libraries: the code points that only one takes for assigned, and the word
        pattern with the letters and numbers that the tokenizer's own pre-tokenizer finds among them."""
        import regex

        kind = regex.compile(r"[\p{L}\p{N}]")
        some = [c for c in map(chr, (k for k in range(0x110000) if not 0xD800 <= k < 0xE000)) if unicodedata.category(c) == "Cn" and kind.match(c)]
        later = [c for c in some if len(self.library.pre_tokenizer.pre_tokenize_str("!" + c)) == 1]
        spans = _spans(set(later))
        pattern = self.words.pattern.replace(r"[\p{L}]+", rf"(?:(?![{spans}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{spans}])\p{{N}}")
        pattern = pattern.replace(r"\p{L}\p{N}]+", rf"\p{{L}}\p{{N}}]|[{spans}])+").replace("[^", "(?:[^") if later else pattern
        return re.compile(f"[{_spans(set(some))}]"), regex.compile(pattern)

    def _pairs_inside(self) -> np.ndarray:
        """256 x 256: pairs of adjacent symbols that occur inside a token."""
        place = {c: b for b, c in enumerate(self.sign)}
        inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token.removesuffix(self.end) if len(token) > len(self.end) else token
            if all(c in place for c in body):
                codes = [place[c] for c in body]
                inside[codes[:-1], codes[1:]] = True
        return inside

    def normal(self, text: str) -> str:
        """NFC, runs of white space to one blank, lower case; special strings are taken out before."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = re.sub(f"[{WHITE}]+", " ", text)
            return "".join(map(_lower, text)) if _odd(text) else text.lower()
        return re.sub("[\t\n\x0b\f\r ]+", " ", text).lower()

    def fragments(self, word: str) -> list[str]:
        """The symbols of a word, cut at its forced boundaries."""
        raw = word.encode()
        cuts, last = [], 0
        for k in range(1, len(raw)):
            if not self.joined[raw[k - 1], raw[k]]:
                cuts.append(raw[last:k])
                last = k
        cuts.append(raw[last:])
        return ["".join([self.sign[b] for b in c]) for c in cuts]

    def word(self, word: str) -> list[int]:
        """Ids of a word: its fragments independently, the last one with the word end."""
        *first, last = self.fragments(word)
        ids = [t.id for f in first for t in self.inner.tokenize(f)]
        return ids + [t.id for t in self.final.tokenize(last)]

    def encode(self, text: str, known: dict[str, bytes]) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. ``known``: the same by word, kept by the caller over many texts."""
        ids: list[bytes] = []
        parts = self.cut_special.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                continue
            rare = _FAR.search(part) and self.disputed.search(part)
            part = self.library.normalizer.normalize_str(part) if rare else self.normal(part)
            cut = self.exact if rare else self.words
            for w in cut.findall(part):
                got = known.get(w)
                if got is None:
                    got = known[w] = np.array(self.word(w), "<u4").tobytes()
                ids.append(got)
        return b"".join(ids)

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks."""
        return " ".join(map(self.text_of.__getitem__, ids))


def _spans(chars: set[str]) -> str:
    """The inside of a pattern class for these characters; one that never occurs stands for none."""
    out, codes = [], sorted(map(ord, chars))
    for k, code in enumerate(codes):
        if k and code == codes[k - 1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) or "\\U0010ffff"


@lru_cache(maxsize=1 << 12)
def _lower(c: str) -> str:
    """Lower case of one character by itself, without rules that look at its neighbours."""
    return c.lower()


def _odd(text: str) -> bool:
    """Holds a character whose lower case depends on its neighbours (the final sigma)."""
    return "Σ" in text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256; with ``outputs`` also ids and decoded."""
    rows = with_text(docs, text, keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    extra = ", ids array<int>, decoded string" if outputs else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = codec(path), {}
        for batch, data, offsets in slices(batches, most=SLICE):
            if len(known) > MEMORY:
                known.clear()
            raw = data.tobytes()
            n, hashes, back, all_ids, decoded = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                coded = machine.encode(raw[a:b].decode("utf-8"), known)
                ids = np.frombuffer(coded, "<u4")
                shown = machine.decode(ids.tolist())
                n.append(len(ids))
                hashes.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(shown.encode()).hexdigest())
                if outputs:
                    all_ids.append(ids.view(np.int32))
                    decoded.append(shown)
            columns = [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names)

    return rows.mapInArrow(run, f"{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
