"""Byte-level byte-pair encoding of one text, and batches of texts by way of their distinct units."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import gather

#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """A byte-level vocabulary with its merges, from the JSON text of a `tokenizers` file."""

    def __init__(self, content: str, most_merged: int = 150_000):
        #: Words merged before; beyond the bound words are merged again, with the same result.
        self.merged: dict[str, list[int]] = {}
        self.most_merged = most_merged
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        #: (left id, right id) -> (rank, id of the two together)
        self.pairs = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """A text cut into special tokens and the words within which merges happen."""
        if self.split_special is None or not self.split_special.search(text):
            return WORDS.findall(text)
        parts = self.split_special.split(text)
        return [w for p in parts for w in ([p] if p in self.special else WORDS.findall(p))]

    def merge(self, word: str) -> list[int]:
        """Merge a word's bytes: the lowest rank first and, within a rank, from left to right.

        Symbols form a doubly linked list. The queue holds (rank, place); an entry is stale, and skipped, when the pair at
        its place is gone or has another rank by now.
        """
        if word in self.special:
            return [self.special[word]]
        ids = [self.first[b] for b in word.encode()]
        pairs, n = self.pairs, len(ids)
        queue = [pair[0] << 32 | i for i in range(n - 1) if (pair := pairs.get(ids[i] << 20 | ids[i + 1]))]
        if queue:
            heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while queue:
                entry = heappop(queue)
                at = entry & 0xFFFFFFFF
                right = after[at]
                if ids[at] < 0 or right >= n:
                    continue
                pair = pairs.get(ids[at] << 20 | ids[right])
                if pair is None or pair[0] != entry >> 32:
                    continue
                ids[at], ids[right] = pair[1], -1
                after[at] = beyond = after[right]
                if beyond < n:
                    before[beyond] = at
                    if new := pairs.get(pair[1] << 20 | ids[beyond]):
                        heappush(queue, new[0] << 32 | at)
                if (left := before[at]) >= 0 and (new := pairs.get(ids[left] << 20 | pair[1])):
                    heappush(queue, new[0] << 32 | left)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words(text):
            ids = self.merged.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(self.merged) < self.most_merged:
                    self.merged[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All vocabulary strings behind each other, where each starts, and how long it is."""
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(lengths) - lengths, lengths


class UnitEncoder:
    """Encodes many texts through their distinct units, strings that are encoded independently of what is around them.

    Natural text repeats its words, so most units of a batch are known from batches before. The memory holds the
    `most_known` units seen first; others are encoded again in each batch they occur in, with the same result.
    """

    def __init__(self, encode_units: Callable[[list[str]], Iterable[list[int] | bytes]], most_known: int = 700_000):
        self.encode_units, self.most_known = encode_units, most_known
        #: unit -> its ids, packed as unsigned 32-bit integers
        self.known: dict[str, bytes] = {}

    def encode(self, units: list[str], codes: np.ndarray, unit_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text starts.

        Text i is made of the units that codes[unit_offsets[i] : unit_offsets[i + 1]] name.
        """
        found = [*map(self.known.get, units)]
        new = [i for i, ids in enumerate(found) if ids is None]
        room = self.most_known - len(self.known)
        for k, (i, ids) in enumerate(zip(new, self.encode_units([units[i] for i in new]))):
            found[i] = ids if isinstance(ids, bytes) else array("I", ids).tobytes()
            if k < room:
                self.known[units[i]] = found[i]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        per_unit = lengths[codes]
        ids = gather(flat, (np.cumsum(lengths) - lengths)[codes], per_unit)
        ends = np.concatenate([[0], np.cumsum(per_unit)])
        return ids, ends[unit_offsets]


def split_at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of all texts between blanks, the code of each part in order, and where each text's parts start."""
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(parts.flatten())
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def spaced_units(texts: pa.Array, words: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Units of a byte-level vocabulary: the text up to its first blank, then each blank with what follows it.

    A blank between two characters that aren't white space always begins a new word, so such units are independent. A
    text with any other blank (double, at the ends, beside a line break) is cut into its words instead.
    """
    parts, codes, offsets = split_at_blanks(texts)
    n, sizes = len(parts), np.diff(offsets)
    odd = pc.or_(pc.equal(parts, ""), pc.not_equal(parts, pc.utf8_trim_whitespace(parts))).to_numpy(zero_copy_only=False)
    bad = (np.add.reduceat(odd[codes].astype(np.int64), offsets[:-1]) > 0) & (sizes > 1)
    # Codes below n are parts as they are, those from n on are parts behind a blank, those from 2n on are words.
    codes = codes.astype(np.int64) + n
    codes[offsets[:-1]] -= n
    names: dict[str, int] = {}
    if bad.any():
        cut = {int(i): [names.setdefault(w, 2 * n + len(names)) for w in words(texts[int(i)].as_py())] for i in np.flatnonzero(bad)}
        codes = np.concatenate([cut[i] if bad[i] else codes[offsets[i] : offsets[i + 1]] for i in range(len(sizes))]).astype(np.int64)
        sizes = np.array([len(cut[i]) if bad[i] else sizes[i] for i in range(len(sizes))], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    used = np.flatnonzero(np.bincount(codes, minlength=2 * n + len(names)))
    place = np.zeros(2 * n + len(names), np.int64)
    place[used] = np.arange(len(used))
    plain, behind = (parts.take(pa.array(u)).to_pylist() for u in (used[used < n], used[(used >= n) & (used < 2 * n)] - n))
    return plain + [" " + p for p in behind] + [*names], place[codes], offsets


class BatchBpe:
    """Encodes Arrow arrays of texts with one vocabulary, and decodes them."""

    def __init__(self, content: str):
        self.bpe = Bpe(content)
        self.units = UnitEncoder(lambda units: map(self.bpe.encode, units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return self.units.encode(*spaced_units(texts, self.bpe.words))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Concatenate the vocabulary strings of the ids of each text."""
        flat, at, lengths = self.bpe.token_bytes
        per_token = lengths[ids]
        joined = gather(flat, at[ids], per_token).tobytes()
        ends = np.concatenate([[0], np.cumsum(per_token)])[starts]
        return [joined[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
