"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Vectors are brought to length one and projected on many random lines. On each line a pair collides if one lies in the
window around the other. Similar pairs collide on nearly all lines, others on few: pairs whose count passes are verified
by their cosine in double precision. Window and count follow from the wanted recall at the threshold.

Counting looks at two vectors only if they share a cell. In each of several tables a cell is made of the sorted places,
in steps, on a few further lines; how many lines and tables, follows from the size of the largest label and the recall.
A small label is one cell. Cells of many members are dealt into chunks, and every two chunks meet in one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .components import components, look_up

#: Members of a chunk; the number that a cell should have by its number of lines; pairs whose counts are held at a time.
CHUNK, CELL, HELD = 1024, 4096, 1 << 20


def _tail(n: int, p: float, least: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


@dataclass(frozen=True)
class Calibration:
    """Lines to count on, half a window, the count that passes; tables, lines in each, and the width of a step."""

    threshold: float
    lines: int
    window: float
    count: int
    tables: int
    depth: int
    step: float

    @staticmethod
    def of(threshold: float, recall: float, largest: int, lines: int = 16) -> Calibration:
        """For a pair just at the threshold, both its count and its meeting in a cell are as likely as the root of the recall."""
        apart = math.sqrt(2 - 2 * threshold)
        window, step, each = 2 * apart, 5 * apart, math.sqrt(recall)
        hit = math.erf(2 / math.sqrt(2))
        count = max(k for k in range(1, lines + 1) if k == 1 or _tail(lines, hit, k) >= each)

        def together(distance: float) -> float:
            """The chance that two vectors at a distance fall into the same step, wherever steps begin."""
            s = step / distance
            return math.erf(s / math.sqrt(2)) - math.sqrt(2 / math.pi) / s * (1 - math.exp(-s * s / 2))

        depth = max(0, math.ceil(math.log(max(1, largest / CELL)) / -math.log(together(math.sqrt(2)))))
        near = together(apart) ** depth
        tables = 1 if depth == 0 else math.ceil(math.log(1 - each) / math.log1p(-near))
        return Calibration(threshold, lines, window, count, tables, depth, step)


def _directions(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, n))


def prepared(vector, how: Calibration, label) -> dict | None:
    """Node, unit vector and cells of one vector; nothing for one that can't be compared."""
    if vector is None or label is None or any(v is None for v in vector):
        return None
    given = np.array(vector, np.float64)
    size = np.sqrt(given @ given) if len(given) and np.isfinite(given).all() else 0.0
    if not (np.isfinite(size) and size > 0):
        scale = np.abs(given).max() if len(given) and np.isfinite(given).all() else 0.0
        if not scale > 0:
            return None
        given = given / scale  # squares that leave the range of doubles
        size = np.sqrt(given @ given)
    unit = given / size
    cells = []
    if how.depth:
        lines = how.tables * how.depth
        shifts = np.random.default_rng(8).random(lines)
        places = np.floor(unit @ _lines_of(len(unit), lines) / how.step + shifts).astype(np.int64).reshape(how.tables, how.depth)
        cells = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=t) - (1 << 63) for t, p in enumerate(places)]
    return {"node": xxhash.xxh3_128_digest(unit.tobytes() + repr(label).encode()), "unit": unit.tobytes(), "cells": cells or [0]}


_KNOWN_LINES: dict[tuple[int, int], np.ndarray] = {}


def _lines_of(dims: int, n: int) -> np.ndarray:
    if (dims, n) not in _KNOWN_LINES:
        _KNOWN_LINES[dims, n] = _directions(dims, n, 80)
    return _KNOWN_LINES[dims, n]


def collisions(x: np.ndarray, how: Calibration) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) whose number of lines with j in the window around i passes; i < j."""
    k = len(x)
    projected = x @ _directions(x.shape[1], how.lines, 81)
    rank, low, high = (np.zeros((how.lines, k), np.int32) for _ in range(3))
    for line in range(how.lines):
        order = np.argsort(projected[:, line], kind="stable")
        sorted_ = projected[order, line]
        rank[line, order] = np.arange(k)
        low[line] = np.searchsorted(sorted_, projected[:, line] - how.window, "left")
        high[line] = np.searchsorted(sorted_, projected[:, line] + how.window, "right")
    first = how.lines // 2
    for a in range(0, k, max(1, HELD // k)):
        b = min(k, a + max(1, HELD // k))
        counts = np.zeros((b - a, k), np.int8)
        for line in range(first):
            # One comparison tells whether low <= rank < high.
            counts += (rank[line][None, :] - low[line, a:b, None]).view(np.uint32) < (high[line] - low[line])[a:b, None].view(np.uint32)
        i, j = np.nonzero(counts >= how.count - (how.lines - first))
        keep = i + a < j
        i, j = i[keep], j[keep]
        total = counts[i, j].astype(np.int32)
        i += a
        for line in range(first, how.lines):
            total += (rank[line, j] >= low[line, i]) & (rank[line, j] < high[line, i])
        yield i[total >= how.count], j[total >= how.count]


def verify_cell(block: pa.Table, how: Calibration) -> pa.Table:
    """Members of one cell, or two of its chunks -> (node, links, tied)."""
    node = np.array(block["node"].to_pylist(), object)
    order = np.argsort(node)
    order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
    node, weight, chunk = node[order], block["weight"].to_numpy()[order], block["chunk"].to_numpy()[order]
    x = np.frombuffer(b"".join(block["unit"].to_pylist()), np.float64).reshape(len(block), -1)[order]
    cells, table = np.array(block["cells"].to_pylist(), np.int64)[order], block["place"][0].as_py()
    counts, tied = np.zeros(len(node), np.int64), np.arange(len(node))
    ones, others = [], []
    for i, j in collisions(x, how):
        if chunk.min() != chunk.max():
            across = chunk[i] != chunk[j]
            i, j = i[across], j[across]
        for earlier in range(table):  # a pair counts in the first table that it shares a cell of
            new = cells[i, earlier] != cells[j, earlier]
            i, j = i[new], j[new]
        for c in range(0, len(i), HELD // 16):
            p, q = i[c : c + HELD // 16], j[c : c + HELD // 16]
            real = np.einsum("ij,ij->i", x[p], x[q]) >= how.threshold
            p, q = p[real], q[real]
            np.add.at(counts, p, weight[q])
            np.add.at(counts, q, weight[p])
            ones.append(p.astype(np.int32))
            others.append(q.astype(np.int32))
    p, q = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (ones, others))
    while True:
        new = tied.copy()
        np.minimum.at(new, p, tied[q])
        np.minimum.at(new, q, tied[p])
        new = np.minimum(new, new[new])
        if (new == tied).all():
            break
        tied = new
    some = counts > 0
    return pa.table(
        {"node": list(node[some]), "links": counts[some], "tied": list(node[tied[some]])},
        pa.schema([("node", pa.binary()), ("links", pa.int64()), ("tied", pa.binary())]),
    )


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows of the same label with a cosine of `threshold` or more; component_id is the smallest
    identifier that links lead to. Vectors of different length don't link. A vector that is null, empty, zero, or holds a
    null or non-finite component, or has a null label, links with nothing and is its own component. Equal vectors of a
    label are one node, however many rows they have. Null identifiers take part and are never a component's name if it has
    another one. Repeated rows count as rows. Other columns play no part. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    largest = rows.filter("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    how = Calibration.of(threshold, recall, largest)

    @F.arrow_udf("struct<node:binary,unit:binary,cells:array<bigint>>")
    def prepare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("node", pa.binary()), ("unit", pa.binary()), ("cells", pa.list_(pa.int64()))])
        for given, labels in batches:
            yield pa.array([prepared(v, how, label) for v, label in zip(given.to_pylist(), labels.to_pylist())], kind)

    ready = staged(
        rows.select("id", "label", F.spark_partition_id().alias("run"), prepare("vector", "label").alias("p"))
        .select("id", "label", "run", "p.*"),
        "vectors",
    )
    nodes = staged(
        ready.filter("node IS NOT NULL").groupBy("node").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("unit").alias("unit"),
            F.first("cells").alias("cells"),
        ),
        "vector-nodes",
    )
    placed = nodes.select("node", "label", F.octet_length("unit").alias("bytes"), F.posexplode("cells").alias("place", "cell"))
    cell = ["label", "bytes", "place", "cell"]
    sizes = placed.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = placed.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
    meets = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    blocks = meets.select("node", "place", "chunk", F.struct(*cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).alias("block"))
    verified = staged(
        blocks.join(nodes.select("node", "weight", "unit", "cells"), "node").groupBy("block")
        .applyInArrow(lambda t: verify_cell(t, how), "node binary, links bigint, tied binary"),
        "verified",
    )
    final = components(verified.select(F.col("node").alias("u"), F.col("tied").alias("v"))).withColumnRenamed("component", "class")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "rep", "weight").join(final, "node", "left").join(links, "node", "left")
    known = known.withColumn("class", F.coalesce("class", "node"))
    ids = known.groupBy("class").agg(F.min("rep").alias("component_id"))
    told = known.join(ids, "class").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return look_up(ready.select("id", "run", "node"), told, "node").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("node").isNull() | F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
