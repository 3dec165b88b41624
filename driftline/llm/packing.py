"""Packing of tokenised documents into sequences of a fixed length: dominance reduction, then best fit.

Only how many pieces there are of each length decides the plan, and there are at most `capacity` lengths. So the plan is
made on that histogram, on the driver, in a time that depends on the capacity and not on the corpus; equal sequences are
one entry with a count. The pieces then find their places by their rank among the pieces of the same length.

Reduction (Martello and Toth): a set of pieces with piece j in it dominates all others with j if what they hold besides j
also fits into the places this one gives. Such sets are fixed and leave the instance:
* {j} where not even the smallest other piece fits beside j;
* {j, k} that fill a sequence exactly;
* {j, k} with k the largest piece that fits, where no two others fit beside j, or where two at most do and no two that fit
  are together longer than k.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import UnitEncoder, split_at_blanks
from .bpe_codec import vocabulary
from .common import slices, staged, whole

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"
#: Fixed value: what marks the last token of a word in vocabularies of this kind.
WORD_END = "</w>"
#: A rank window holds about so many pieces.
RANKED_TOGETHER = 100_000

#: A sequence: ((length, copies), ...).
Pattern = tuple[tuple[int, int], ...]


class WordTokens:
    """Ids of whole texts from a `tokenizers` vocabulary that drops white space: the text is cut at blanks and line feeds,
    which no token crosses, and each distinct word is encoded by the library."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        ends = {i: token.endswith(WORD_END) for token, i in self.library.get_vocab().items()}
        self.ends_word = np.array([ends.get(i, False) for i in range(1 + max(ends))])
        self.units = UnitEncoder(self.encode_words)

    def encode_words(self, words: list[str], at_once: int = 1000) -> Iterator[bytes]:
        """The ids of each word, as unsigned 32-bit integers. Words are encoded together, with blanks between them.

        A string of letters is one word of the vocabulary and ends with its only token that ends a word. Others are told
        apart by their offsets, which take about as long as the encoding itself.
        """
        plain = [w.isalpha() and w.lower().isalpha() for w in words]
        found = {True: self._split(list(compress(words, plain)), at_once, True), False: self._split([w for w, p in zip(words, plain) if not p], at_once, False)}
        return (next(found[p]) for p in plain)

    def _split(self, words: list[str], at_once: int, by_ends: bool) -> Iterator[bytes]:
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            text = " ".join(some)
            if by_ends:
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
            if not by_ends or len(ends) != len(some):
                whole_text = self.library.encode(text, add_special_tokens=False)
                ids = np.array(whole_text.ids, "<u4")
                ends = np.searchsorted(np.array([a for a, _ in whole_text.offsets], np.int64), np.cumsum([len(w) + 1 for w in some]), "left")
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            yield from (raw[a:b] for a, b in zip(at[:-1], at[1:]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, codes, offsets = split_at_blanks(pc.replace_substring(texts, "\n", " "))
        return self.units.encode(parts.to_pylist(), codes, offsets)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, text_col: str = "text", ids: bool = False) -> DataFrame:
    """Add `pieces`: the ids of each text and the end id, cut every `capacity` tokens. Ids themselves only on request."""
    content = vocabulary(docs.sparkSession, path)

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = WordTokens(content.value)
        for texts in slices(batches):
            out = []
            flat, at = tokens.encode(texts.fill_null(""))
            for x, y in zip(at[:-1], at[1:]):
                raw = np.append(flat[x:y], end_id).astype("<u4")
                cuts = [(i, raw[i : i + capacity]) for i in range(0, len(raw), capacity)]
                out.append(
                    [
                        {"piece": k, "start": i, "length": len(p), "ids_crc32": zlib.crc32(p), "ids": p.tobytes() if ids else None}
                        for k, (i, p) in enumerate(cuts)
                    ]
                )
            yield pa.array(out, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])))

    return docs.withColumn("pieces", cut(whole(text_col)))


def _smallest(counts: Counter, sizes: list[int], n: int) -> list[int]:
    out = []
    for s in sizes:
        out += [s] * min(counts[s], n - len(out))
        if len(out) == n:
            break
    return out


def _largest_pair(sizes: list[int], counts: Counter, room: int) -> int:
    """The largest sum of two pieces within `room`."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room or (i == j and counts[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def reduce_by_dominance(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Take sets that dominate all alternatives out of `counts`."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(n: int, *pieces: int) -> None:
        held = Counter(pieces)
        fixed.append((tuple(sorted(held.items(), reverse=True)), n))
        for s, k in held.items():
            counts[s] -= k * n

    for s in sorted(counts, reverse=True):  # exact pairs
        k = capacity - s
        if n := (counts[s] // 2 if k == s else min(counts[s], counts[k]) if 0 < k < s else 0):
            fix(n, s, k)
    if counts[capacity]:
        fix(counts[capacity], capacity)
    for s in sorted(counts, reverse=True):
        while counts[s]:
            counts[s] -= 1  # one j; the others are its surroundings
            sizes = [x for x in sorted(counts) if counts[x] > 0]
            low, room = _smallest(counts, sizes, 3), capacity - s
            counts[s] += 1
            if not low or low[0] > room:
                fix(counts[s], s)
                continue
            k = sizes[bisect_left(sizes, room + 1) - 1]
            one_more = sum(low[:2]) > room or len(low) < 2
            if not one_more and (sum(low) <= room and len(low) == 3 or _largest_pair(sizes, counts - Counter([s]), room) > k):
                break
            # What is left only gets fewer choices by this, so it holds for all equal pairs at once.
            fix(counts[s] // 2 if k == s else min(counts[s], counts[k]), s, k)
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest pieces first. Sequences with the same room left are kept together, with their number."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if n:
            if not open_by_room[room]:
                insort(rooms, room)
            open_by_room[room].append((pattern, n))

    for s in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                pattern, n, room = (), left, capacity  # as many new ones as may be needed
            else:
                room = rooms[i]
                pattern, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(i)
            # The tightest sequence stays the tightest while another piece fits, so it takes all that fit.
            each = min(room // s, left)
            took = min(n, left // each)
            if pattern:
                put(pattern, n - took, room)
            put((*pattern, (s, each)), took, room - each * s)
            left -= took * each
    return [group for groups in open_by_room.values() for group in groups]


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequences as (pattern, number of such sequences) for pieces counted by length."""
    if bad := [s for s in histogram if not 0 < s <= capacity]:
        raise ValueError(f"no piece of length {bad[0]} fits")
    counts = Counter(histogram)
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


@dataclass(frozen=True)
class Slots:
    """Places by (length, rank): runs of pieces of one length, `each` in a sequence, from `sequence` and `offset` on."""

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(plan: list[tuple[Pattern, int]]) -> Slots:
        used, runs, sequence = Counter(), [], 0
        for pattern, n in plan:
            offset = 0
            for size, each in pattern:
                runs.append(((size << 44) + used[size], each, sequence, offset))
                used[size] += n * each
                offset += size * each
            sequence += n
        runs.sort()
        return Slots(*(np.array([r[i] for r in runs], np.int64) for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        run = np.searchsorted(self.key, key, "right") - 1
        past = key - self.key[run]
        return self.sequence[run] + past // self.each[run], self.offset[run] + past % self.each[run] * length


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    A null text counts as empty and is its end id alone. Texts of more than `capacity` tokens are cut into full pieces and
    a rest; nothing else is cut. Null and repeated identifiers are packed as rows of their own. Other columns of the input
    play no part. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = pieces_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, capacity, end_id, "text", ids)
    # An inner generator would have Catalyst filter on the array's size first, and so tokenise twice. No array is empty.
    pieces = staged(cut.select("id", F.inline_outer("pieces")), "pieces")
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.collect()}  # as many rows as there are lengths: the capacity at most
    slots = spark.sparkContext.broadcast(Slots.of(pack_plan(histogram, capacity)))

    # Ranks among pieces of one length: frequent lengths are dealt over several windows, whose sizes are then added up.
    parts = F.create_map(*(F.lit(x) for s, n in histogram.items() if n > RANKED_TOGETHER for x in (s, -(-n // RANKED_TOGETHER)))) if any(n > RANKED_TOGETHER for n in histogram.values()) else None
    part = F.lit(0).cast("long") if parts is None else F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.coalesce(F.try_element_at(parts, "length"), F.lit(1)).cast("long"))
    dealt = pieces.withColumn("part", part)
    before = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    place_in = W.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(place_in) - 1).join(before, ["length", "part"])

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, rank in batches:
            found = slots.value.find(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    placed = ranked.withColumn("place", place("length", (F.col("rank") + F.col("before")).cast("long")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the sequences themselves, from pieces that carry their ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    ids = F.aggregate("held", F.lit(b"").cast("binary"), lambda so_far, p: F.concat(so_far, p["ids"]))
    return held.select("sequence_id", F.size("held").alias("n_pieces"), ids.alias("ids"))
