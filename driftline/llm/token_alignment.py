"""How the tokens of two vocabularies go together: a byte-level one (A) and one of pieces with a blank before words (B).

Both tile the same bytes, a blank and the text. Bytes where a token of each ends cut the text into groups. A link joins the
two tokens that end at a cut; a pair of ids counts as often as it is linked anywhere.

Tokens that end together cover the same bytes, so the shorter one ends the longer one. The vocabularies alone thus bound the
number of different pairs, and what is held of all pairs is bounded too, whatever the corpus. Pairs are counted in dense
vectors, at the slots of a minimal perfect hash of the pairs there are; the vectors of all tasks are summed in a tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import WORDS, byte_letters
from .common import slices
from .dense import blocks, count_parts, tree_sum
from .perfect_hash import KeyTable

ALIGNED = "struct<ids_a:binary,ids_b:binary,n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string>"
LINKS = "struct<n_links:bigint,n_best:bigint,count_sum:bigint>"
#: Counts in one block of a vector.
BLOCK = 1 << 15
#: Texts of more characters are encoded in parts, cut where neither vocabulary has a token across.
PART = 1 << 18
_ALIGNERS: dict[Vocabularies, Aligner] = {}


@dataclass(frozen=True)
class Vocabularies:
    """The content of the two vocabulary files, a few megabytes; workers get it by broadcast."""

    a: str
    b: bytes

    @classmethod
    def read(cls, path_a: str, path_b: str) -> "Vocabularies":
        with open(path_a, encoding="utf-8") as file, open(path_b, "rb") as model:
            return cls(file.read(), model.read())

    def token_bytes(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of every id of A and of B."""
        import sentencepiece

        vocab, alphabet = json.loads(self.a)["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            # Added tokens needn't be written in the byte alphabet; as their strings are plain text here, none comes up.
            a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.b)
        as_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
        return a, [as_bytes(i) for i in range(pieces.get_piece_size())]

    def most_pairs(self) -> int:
        """How many pairs of ids can end together: one of the two ends the other."""
        a, b = self.token_bytes()
        total = 0
        for some, others, proper in ((a, b, 0), (b, a, 1)):
            at: dict[bytes, int] = {}
            for t in others:
                at[t] = at.get(t, 0) + 1
            total += sum(at.get(t[i:], 0) for t in some for i in range(proper, len(t)))
        return total


def _cuts(text: str) -> list[str]:
    """The parts of a long text, each with the blank before it left out.

    A blank between two letters or digits begins a word in both vocabularies, so tokens don't reach across it.
    """
    parts, start = [], 0
    while len(text) - start > PART:
        at = start + PART
        while 0 <= (at := text.find(" ", at)) and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at += 1
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


@dataclass(frozen=True)
class Tables:
    """How many bytes the ids of A and of B have: all that is needed to align texts that are encoded."""

    size_a: np.ndarray
    size_b: np.ndarray

    @classmethod
    def of(cls, vocabularies: Vocabularies) -> "Tables":
        return cls(*(np.array([len(t) for t in table], np.int64) for table in vocabularies.token_bytes()))

    def cuts(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the tokens of A and of B that end at each cut. Texts lie behind each other in both.

        No token is without bytes, so one token of each ends at a cut.
        """
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        ends = np.zeros(1 + (end_b[-1] if len(end_b) else 0), bool)
        ends[end_b] = True
        at_a = np.flatnonzero(ends[end_a])
        ends[:] = False
        ends[end_a] = True
        return at_a, np.flatnonzero(ends[end_b])

    def link_codes(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ids of every link as one number, and the place of its token of A."""
        at_a, at_b = self.cuts(ids_a, ids_b)
        return ids_a[at_a].astype(np.int64) * len(self.size_b) + ids_b[at_b], at_a


class Aligner:
    """Both encoders, and the tables that alignment needs."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken

        bytes_a, self.bytes_b = vocabularies.token_bytes()
        self.tables = Tables(*(np.array([len(t) for t in table], np.int64) for table in (bytes_a, self.bytes_b)))
        # The merges of A are in the order of the ids they give, so its ids are ranks. Words are split as in its file, and no
        # token is special: tests compare with the library that reads the file, which takes three times as long.
        added = {t["id"] for t in json.loads(vocabularies.a)["added_tokens"]}
        self.encoder_a = tiktoken.Encoding("a", pat_str=WORDS.pattern, mergeable_ranks={t: i for i, t in enumerate(bytes_a) if t and i not in added}, special_tokens={})
        self.encoder_b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        # A splits at such blanks before it merges; pieces of B with a blank behind something else would reach across them.
        self.may_cut = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        most = max(len(bytes_a), len(self.bytes_b))
        width = len(str(most)) + 1
        self.digits = np.frombuffer(b"".join(str(i).rjust(width - 1, "\0").encode() + b"," for i in range(most)), np.uint8).reshape(-1, width)
        self.written = (self.digits != 0).sum(axis=1)

    @classmethod
    def shared(cls, content) -> "Aligner":
        """One for each worker process and vocabulary, whatever the number of its tasks."""
        if content.value not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[content.value] = cls(content.value)
        return _ALIGNERS[content.value]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of A and of B of each text; none of either where a text is empty or a vocabulary doesn't give its bytes back."""
        parts = [_cuts(t) if self.may_cut and len(t) > PART else [t] for t in texts]
        flat = list(chain.from_iterable(parts))
        found_a = [self.encoder_a.encode_to_numpy(" " + p) for p in flat]
        found_b = self.encoder_b.encode(flat, num_threads=1)
        ids_a, ids_b, at = [], [], 0
        for text, held in zip(texts, map(len, parts)):
            a = found_a[at] if held == 1 else np.concatenate(found_a[at : at + held])
            b = found_b[at] if held == 1 else list(chain.from_iterable(found_b[at : at + held]))
            at += held
            want = b" " + text.encode()
            # Words of A tile the text and tokens tile the words, so their bytes can only be missing, not others.
            same = text and self.tables.size_a[a].sum() == len(want) and b"".join([self.bytes_b[i] for i in b]) == want
            ids_a.append(a if same else a[:0])
            ids_b.append(b if same else [])
        return ids_a, ids_b

    def aligned(self, texts: list[str]) -> pa.Array:
        a, b = self.encode(texts)
        n_a, n_b = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
        ids_a, ids_b = np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        del a, b
        at_a, at_b = self.tables.cuts(ids_a, ids_b)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        groups_at = np.searchsorted(at_a, np.concatenate([[0], ends_a]))
        # Groups in order, the tokens of A before those of B: a token moves up by the other list's tokens before it.
        group_a = np.searchsorted(at_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(at_b, np.arange(len(ids_b)))
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], at_b + 1])[group_a]
        place_b = np.arange(len(ids_b)) + (at_a + 1)[group_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        rows = self.digits[ids]
        rows[place_a[at_a], -1], rows[place_b[at_b], -1] = ord("|"), ord(";")
        text = rows[rows != 0]
        ends = np.concatenate([[0], np.cumsum(self.written[ids])])[np.concatenate([[0], ends_a + ends_b])]
        shas = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
        packed = (_packed(ids_a, n_a, len(self.tables.size_a)), _packed(ids_b, n_b, len(self.tables.size_b)))
        columns = [*packed, pa.array(n_a), pa.array(n_b), pa.array(np.diff(groups_at)), pa.array(shas, pa.string())]
        return pa.StructArray.from_arrays(columns, ["ids_a", "ids_b", "n_a", "n_b", "n_groups", "groups_sha256"])


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _packed(ids: np.ndarray, counts: np.ndarray, n_ids: int) -> pa.Array:
    """The ids of each text as one binary value, in two bytes each where the vocabulary allows."""
    kind = _width(n_ids)
    offsets = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids.astype(kind))])


def _unpacked(packed: pa.Array, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts behind each other, and how many each has."""
    kind = _width(n_ids)
    rows = packed.to_pylist()
    counts = np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), counts


def align(spark: SparkSession, vocabularies: Vocabularies, text: str | Column = "text") -> Column:
    """The alignment of each whole text: both lists of ids, their lengths, the number of groups and the digest of the groups.

    A null or empty text has no tokens, nor has one whose tokens don't give back a blank and the text, byte for byte
    (such as one that holds U+2581); its digest is the empty string. Strings of special tokens are plain text.
    """
    content = spark.sparkContext.broadcast(vocabularies)

    @F.arrow_udf(ALIGNED)
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner.shared(content)
        for texts in slices(batches, 1 << 20):
            yield aligner.aligned(texts.to_pylist())

    return aligned(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _codes_of(tables: Tables, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for a, b in slices((batch.column(0), batch.column(1)) for batch in batches):
        yield tables.link_codes(_unpacked(a, len(tables.size_a))[0], _unpacked(b, len(tables.size_b))[0])[0]


@dataclass(frozen=True)
class PairCounts:
    """Every linked pair of ids, the number of its links, and whether it has the most of its id of B."""

    table: KeyTable
    counts: np.ndarray
    best: np.ndarray


def pair_counts(aligned: DataFrame, vocabularies: Vocabularies) -> PairCounts:
    """Count the links of all rows; `aligned` is a written table with ids_a and ids_b.

    What comes to the driver is one number for each different pair; the vocabularies bound how many there can be.
    """
    spark, ids = aligned.sparkSession, aligned.select("ids_a", "ids_b")
    sizes = spark.sparkContext.broadcast(Tables.of(vocabularies))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for codes in _codes_of(sizes.value, batches):
            known = np.union1d(known, codes)
        yield pa.RecordBatch.from_arrays([pa.array(known)], ["code"])

    most = vocabularies.most_pairs()
    codes = ids.mapInArrow(distinct, "code long").distinct().limit(most + 1).toArrow().column(0).to_numpy()
    if len(codes) > most:
        raise ValueError(f"more than {most} pairs, which these vocabularies can't have")
    table = KeyTable(np.sort(codes))
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        counts = np.zeros(len(shared.value), np.int64)
        for codes in _codes_of(sizes.value, batches):
            slots = shared.value.slots(codes)
            if (slots < 0).any():
                raise ValueError("a pair that wasn't there before: the table has changed meanwhile")
            counts += np.bincount(slots, minlength=len(counts))
        return blocks(counts, BLOCK)

    counts = np.zeros(len(table), np.int64)
    for row in tree_sum(count_parts(ids, count), ids.rdd.getNumPartitions()).collect():  # 8 bytes for each pair
        at = int(row["key"]) * BLOCK
        counts[at : at + BLOCK] = np.frombuffer(row["counts"], "<i8")
    b = (table.keys[:, 0] % np.uint64(len(sizes.value.size_b))).astype(np.int64) if len(table) else np.zeros(0, np.int64)
    most_of = np.zeros(1 + b.max(initial=0), np.int64)
    np.maximum.at(most_of, b, counts)
    return PairCounts(table, counts, counts == most_of[b])


def link_counts(spark: SparkSession, vocabularies: Vocabularies, pairs: PairCounts, ids_a: str = "ids_a", ids_b: str = "ids_b") -> Column:
    """Of each aligned text: its links, those whose pair is the most frequent one of its id of B, and the sum of their pairs' counts.

    All pairs must have been counted; a text without tokens has no links.
    """
    sizes, known = spark.sparkContext.broadcast(Tables.of(vocabularies)), spark.sparkContext.broadcast(pairs)

    @F.arrow_udf(LINKS)
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables, counted = sizes.value, known.value
        for part_a, part_b in slices(batches):
            (a, n_a), (b, _) = _unpacked(part_a, len(tables.size_a)), _unpacked(part_b, len(tables.size_b))
            codes, at = tables.link_codes(a, b)
            slots = counted.table.slots(codes)
            if (slots < 0).any():
                raise ValueError("a pair that was not counted")
            ends = np.searchsorted(at, np.concatenate([[0], np.cumsum(n_a)]))
            sums = [np.concatenate([[0], np.cumsum(x[slots])])[ends] for x in (counted.best.astype(np.int64), counted.counts)]
            yield pa.StructArray.from_arrays([pa.array(np.diff(x)) for x in (ends, *sums)], ["n_links", "n_best", "count_sum"])

    return look_up(F.col(ids_a), F.col(ids_b))
