"""N-gram Jaccard join of documents: MinHash bands find candidates, the full n-gram sets decide.

1. A document's n-grams give `bands x rows` minima. Documents with the same words are one node from here on.
2. Nodes are shuffled on their band hashes. Each bucket ties its nodes to its smallest one (no pairs are written), and
   the connected components of these ties are the candidate classes. Most documents are in none.
3. Only members of candidate classes bring their n-gram sets, once. Within a class all pairs are verified on the sets, in
   blocks of bounded size; a large class is dealt into chunks, and every two chunks meet in one block.
4. Blocks return one row per member: how many documents it links to and the smallest node it is tied to. Components of
   these ties are the result's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import slices, staged, whole
from .components import components, look_up

#: Members and n-grams that one chunk of a class may have, and n-grams of small classes verified in one call.
CHUNK_MEMBERS, CHUNK_GRAMS, CALL_GRAMS = 512, 250_000, 200_000


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, for which pairs at the threshold meet with this chance."""
    best = None
    for rows in range(1, most_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} takes more than {most_hashes} hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and where each text's words start. Words end at ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    at = parts.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(parts.flatten())
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    codes, held = coded.indices.to_numpy(zero_copy_only=False), np.array([w != "" for w in words], bool)
    real = held[codes] if len(codes) else np.zeros(0, bool)
    return hashes[codes[real]], np.concatenate([[0], np.cumsum(real)])[at - at[0]]


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and where each text's start. A shorter text is one n-gram; one without words has none."""
    lengths = np.diff(at)
    per_text = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(per_text)])
    first = np.repeat(at[:-1] - ends[:-1], per_text) + np.arange(ends[-1])
    size = np.repeat(np.minimum(lengths, n), per_text)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = size.astype(np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < size, padded[first + k], np.uint64(0)))
    return out, ends


def signatures(texts: pa.Array, n: int, bands: int, rows: int) -> pa.Array:
    words, at = word_hashes(texts)
    grams, starts = gram_hashes(words, at, n)
    some = np.diff(starts) > 0
    raw = words.tobytes()
    nodes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
    folded = (grams >> np.uint64(32)).astype(np.uint32)
    random = np.random.default_rng(20_5)
    hashes = np.zeros((int(some.sum()), bands), np.uint64)
    for band in range(bands):
        for _ in range(rows):
            a, b = (int(x) for x in random.integers(1, 1 << 32, 2))
            mixed = folded * np.uint32(a | 1) + np.uint32(b)
            low = np.minimum.reduceat(mixed, starts[:-1][some]) if len(mixed) else np.zeros(0, np.uint32)
            hashes[:, band] = _mixed(hashes[:, band] * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64) + np.uint64(band + 1))
    place = np.cumsum(some) - some
    counts = np.diff(starts)
    rows_ = [
        {"node": node, "bands": hashes[place[i]].view(np.int64) if node is not None else None, "grams": int(counts[i])}
        for i, node in enumerate(nodes)
    ]
    return pa.array(rows_, pa.struct([("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("grams", pa.int64())]))


def gram_sets(texts: pa.Array, n: int) -> pa.Array:
    words, at = word_hashes(texts)
    grams, starts = gram_hashes(words, at, n)
    raw = words.tobytes()
    rows = [
        {"node": xxhash.xxh3_128_digest(raw[8 * a : 8 * b]), "set": np.unique(grams[x:y]).tobytes()}
        for a, b, x, y in zip(at[:-1], at[1:], starts[:-1], starts[1:])
    ]
    return pa.array(rows, pa.struct([("node", pa.binary()), ("set", pa.binary())]))


def linked(sets: list[np.ndarray], threshold: float, split: int = 0) -> np.ndarray:
    """The matrix of pairs whose Jaccard similarity reaches the threshold. split > 0: only pairs across that place."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    column = (np.cumsum(shared) - 1)[number]
    owner, column = owner[shared[number]], column[shared[number]]
    common, width = np.zeros((k, k)), max(256, (2 << 20) // k)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((k, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    joined = sizes[:, None] + sizes[None, :] - common
    links = (common >= threshold * joined - 1e-9) & (joined > 0)
    np.fill_diagonal(links, False)
    if split:
        links[:split, :split] = links[split:, split:] = False
    return links


def smallest_tied(links: np.ndarray) -> np.ndarray:
    """For each member the smallest member (by place) that links lead to."""
    label = np.arange(len(links))
    while True:
        seen = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, seen)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verify_block(block: pa.Table, threshold: float) -> pa.Table:
    """Members of small classes, or two chunks of a large one -> (node, links, tied)."""
    node, candidate = block["node"].to_pylist(), block["candidate"].to_pylist()
    weight, chunk = block["weight"].to_numpy(), block["chunk"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in block["set"].to_pylist()]
    out: dict[str, list] = {"node": [], "links": [], "tied": []}
    at = block["block"][0].as_py()
    across = at["c"] is not None and at["i"] != at["j"]
    order = sorted(range(len(node)), key=lambda i: (candidate[i], chunk[i], node[i]))
    i = 0
    while i < len(order):
        j = i
        members: list[int] = []
        while j < len(order) and candidate[order[j]] == candidate[order[i]]:
            if not members or node[order[j]] != node[members[-1]]:  # a repeated row brings its set again
                members.append(order[j])
            j += 1
        i = j
        split = int((chunk[members] == at["i"]).sum()) if across else 0
        if across and split in (0, len(members)):  # the other chunk got no member; pairs within one count in its own block
            continue
        links = linked([sets[m] for m in members], threshold, split)
        for m, count, t in zip(members, links @ weight[members], smallest_tied(links)):
            if count:
                out["node"].append(node[m])
                out["links"].append(int(count))
                out["tied"].append(node[members[t]])
    return pa.table(out, pa.schema([("node", pa.binary()), ("links", pa.int64()), ("tied", pa.binary())]))


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, class_id, n_links, kept.

    class_id is the smallest identifier of the class (documents tied by links, over however many steps); n_links counts
    the rows whose n-gram set is similar to this one's; kept is whether the row has the class's identifier. A text with
    fewer than n words is one n-gram. A text without words (null, empty, white space) links with nothing and is its own
    class. Null identifiers take part; class_id is null only where the whole class has none, and these rows are kept.
    Repeated rows count as documents. Other columns of the input play no part. An empty table gives an empty result.
    """
    bands, rows = banding(threshold, recall)

    @F.arrow_udf("struct<node:binary,bands:array<bigint>,grams:bigint>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, 2 << 20):
            yield signatures(texts, n, bands, rows)

    @F.arrow_udf("struct<node:binary,set:binary>")
    def grams_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, 2 << 20):
            yield gram_sets(texts, n)

    # Deterministic ones would be computed a second time in the filter on their own result.
    grams_of = grams_of.asNondeterministic()
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    signed = staged(texts.select("id", F.spark_partition_id().alias("run"), sign("text").alias("s")).select("id", "run", "s.*"), "signatures")
    nodes = staged(
        signed.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"), F.first("grams").alias("grams")),
        "nodes",
    )

    # Candidate classes.
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = banded.join(buckets, ["band", "hash"]).filter("node != m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    classes = staged(components(ties).withColumnRenamed("component", "candidate").join(nodes.drop("bands"), "node"), "candidates")
    sizes = classes.groupBy("candidate").agg(F.count(F.lit(1)).alias("members"), F.sum("grams").alias("all_grams"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("all_grams") / CHUNK_GRAMS)).cast("int")
    sized = staged(classes.join(sizes.select("candidate", chunks.alias("chunks")), "candidate"), "sized")
    calls = 1 + (sized.filter("chunks = 1").agg(F.sum("grams")).first()[0] or 0) // CALL_GRAMS

    # The members' n-gram sets, and the blocks in which they meet.
    sets = (
        texts.join(sized.hint("merge"), texts["id"].eqNullSafe(sized["rep"]))  # grows with the input: never broadcast
        .select("node", "candidate", "weight", "chunks", grams_of("text").alias("g"))
        .filter("g.node = node")  # rows that share an identifier may have other texts
        .select("node", "candidate", "weight", "chunks", "g.set", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int").alias("chunk"))
    )
    meets = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    other = sets.select("*", F.explode(meets).alias("other"))
    block = F.when(F.col("chunks") == 1, F.struct(F.lit(None).cast("binary").alias("c"), F.pmod(F.xxhash64("candidate"), F.lit(calls)).alias("i"), F.lit(0).cast("long").alias("j"))).otherwise(F.struct(F.col("candidate").alias("c"), F.least("chunk", "other").cast("long").alias("i"), F.greatest("chunk", "other").cast("long").alias("j")))
    verified = staged(
        other.select("node", "candidate", "weight", "chunk", "set", block.alias("block")).groupBy("block")
        .applyInArrow(lambda t: verify_block(t, threshold), "node binary, links bigint, tied binary"),
        "verified",
    )

    # Classes of the result.
    final = components(verified.select(F.col("node").alias("u"), F.col("tied").alias("v"))).withColumnRenamed("component", "class")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "rep", "weight").join(final, "node", "left").join(links, "node", "left")
    known = known.withColumn("class", F.coalesce("class", "node"))
    ids = known.groupBy("class").agg(F.min("rep").alias("class_id"))
    told = known.join(ids, "class").select("node", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return look_up(signed.select("id", "run", "node"), told, "node").select(
        F.col("id").alias(id_col),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )
