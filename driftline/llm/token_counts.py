"""Token counts of the sections of documents, from one encoding of each whole document.

The vocabulary is byte-level: the tokens of a text tile its bytes, so the running sum of their lengths is the offset map.
Sections tile the document too. Both lists are sorted, and the interval join of tokens with sections is one binary search
per token; all documents of a batch are searched at once, as their bytes lie behind each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import BatchBpe
from .bpe_codec import vocabulary
from .common import slices, whole

RULES = ("first", "last", "majority")
SECTIONS = "array<struct<field:int,section:int,char_start:int,char_end:int,n_tokens:int>>"


def owners(starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; bounds are the sections' first bytes, in order."""
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, starts + np.maximum(lengths, 1) - 1, "right") - 1
    if rule == "last":
        return last
    # The section with most of the token's bytes, the earlier one in a tie: look at each section that a crossing token touches.
    best, most = first.copy(), np.minimum(np.append(bounds, np.iinfo(np.int64).max)[first + 1], starts + lengths) - starts
    for i in np.flatnonzero(last > first):
        for s in range(first[i] + 1, last[i] + 1):
            held = min(bounds[s + 1] if s + 1 < len(bounds) else np.iinfo(np.int64).max, starts[i] + lengths[i]) - bounds[s]
            if held > most[i]:
                best[i], most[i] = s, held
    return best


def count_batch(codec: BatchBpe, texts: pa.Array, field_bytes: list[list[int]], rule: str) -> pa.Array:
    """The sections of every text. field_bytes: the lengths of its fields, which are joined by one line feed each."""
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    fields_at = [doc_at[d] + np.concatenate([[0], np.cumsum(np.array(n[:-1], np.int64) + 1)]) for d, n in enumerate(field_bytes)]
    # A section begins where a field begins and after every line feed, but not at a document's end.
    breaks = np.flatnonzero(raw == 10) + 1
    inside = breaks[~np.isin(breaks, doc_at)]
    at = np.concatenate([inside, *fields_at]) if len(fields_at) else inside
    doc = np.concatenate([np.searchsorted(doc_at, inside, "right") - 1, *(np.full(len(f), d) for d, f in enumerate(fields_at))])
    order = np.lexsort((at, doc))
    at, doc = at[order], doc[order]
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
    # Fields that are empty begin where the next one does, one line feed later at the earliest; so only repeats go.
    at, doc = at[~again], doc[~again]
    ids, _ = codec.encode(texts)
    lengths = codec.bpe.token_bytes[2][ids]
    counts = np.bincount(owners(np.cumsum(lengths) - lengths, lengths, at, rule), minlength=len(at))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    start = chars[at] - chars[doc_at[doc]]
    end = np.where(np.append(doc[1:], -1) == doc, np.append(chars[at[1:]], 0), chars[doc_at[doc + 1]]) - chars[doc_at[doc]]
    section = np.arange(len(at)) - np.searchsorted(doc, doc)
    field = np.fromiter((np.searchsorted(fields_at[d], a, "right") - 1 for a, d in zip(at, doc)), np.int32, len(at)) if any(len(f) > 1 for f in fields_at) else np.zeros(len(at), np.int32)
    rows = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in (field, section, start, end, counts)], ["field", "section", "char_start", "char_end", "n_tokens"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), rows)


def section_tokens(
    docs: DataFrame, path: str, fields: Sequence[str] = ("text",), rule: str = "first", into: str = "sections"
) -> DataFrame:
    """Add an array of (field, section, char_start, char_end, n_tokens), one entry per line of each field, in order.

    The fields are joined by line feeds and encoded as one document. A section reaches up to the next one, its line feed
    included; `section` counts within the document. A token that crosses a boundary counts whole for the section that
    holds its first byte ("first"), its last byte ("last") or most of its bytes ("majority", the earlier one in a tie).
    So the sections' counts add up to the document's. A null field counts as empty; an empty document has one empty
    section per field. The number of tokens has no bound but the text's length. Other columns stay.
    """
    if rule not in RULES:
        raise ValueError(f"rule is {rule!r}")
    content = vocabulary(docs.sparkSession, path)

    @F.arrow_udf(SECTIONS)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = BatchBpe(content.value)
        for texts, sizes in slices(batches):
            yield count_batch(codec, texts, sizes.to_pylist(), rule)

    given = [whole(f) for f in fields]
    return docs.withColumn(into, count(F.concat_ws("\n", *given), F.array(*map(F.octet_length, given))))
