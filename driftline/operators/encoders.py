"""Similarity of two texts in an encoder's space."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import cosine
from ..sources.commits import PartTable
from .portions import join_in_portions


@dataclass(frozen=True)
class ColumnEncoder:
    """A vector as a Spark expression of the text."""

    encode: Callable[[Column], Column]

    def similarity(self, left: Column, right: Column) -> Column:
        return cosine(self.encode(left), self.encode(right))


@dataclass(frozen=True)
class BatchEncoder:
    """``load()`` gives a function from texts to vectors; it is called once per worker.

    Pairs stay in their partition and every Arrow batch encodes its distinct texts once, so a text that
    a third of all rows share ("unknown") costs one encoding per batch and no shuffle on a hot key.
    """

    load: Callable[[], Callable[[list[str]], np.ndarray]]

    def similarity(self, left: Column, right: Column) -> Column:
        load = self.load

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            encode = load()
            for a, b in batches:
                known = a.notna() & b.notna()
                values = np.full(len(a), np.nan)
                if known.any():
                    codes, texts = pd.factorize(pd.concat([a[known], b[known]], ignore_index=True))
                    vectors = np.asarray(encode(list(texts)), dtype=np.float64)
                    norms = np.sqrt((vectors * vectors).sum(axis=1))
                    first, second = codes[: known.sum()], codes[known.sum() :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dots = (vectors[first] * vectors[second]).sum(axis=1)
                        values[known.to_numpy()] = dots / (norms[first] * norms[second])
                yield pd.Series(values)

        return F.nanvl(run(left, right), F.lit(None).cast("double"))


@dataclass(frozen=True)
class KeptEncoder:
    """As BatchEncoder, but every distinct text is encoded once, in this run or an earlier one, and its vector is kept.

    ``load()`` gives a function from texts to vectors. Vectors are kept at ``path`` under the encoder's name and the text's
    SHA-256, in committed parts; texts that are new are encoded by ``parallelism`` tasks. The vector of a text that a third
    of all rows have reaches them portion by portion.
    """

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    path: str
    parallelism: int = 64

    def table(self, spark: SparkSession) -> PartTable:
        return PartTable(spark, self.path, "key string, vector array<double>, encoder string", ("encoder",), id_col="key")

    def encoded(self, texts: DataFrame) -> DataFrame:
        """(key, vector) of the distinct texts (key, text); those without a kept vector are encoded and kept first."""
        table = self.table(texts.sparkSession)
        mine = [p for p in table.parts() if p.labels["encoder"] == self.name]
        kept = table.read(mine) if mine else None
        missing = texts if kept is None else texts.join(kept.select("key"), "key", "left_anti")
        if kept is None or not missing.isEmpty():
            load = self.load

            @F.pandas_udf("array<double>")
            def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                run = load()
                for batch in batches:
                    yield pd.Series(list(np.asarray(run(list(batch)), dtype=np.float64)))

            fresh = missing.repartition(self.parallelism, "key").select("key", encode("text").alias("vector"), F.lit(self.name).alias("encoder"))
            mine.append(table.append(fresh, encoder=self.name))
        return table.read(mine).select("key", "vector").dropDuplicates(["key"])

    def add_similarity(self, df: DataFrame, left: Column, right: Column, out: str) -> DataFrame:
        """Add the cosine of two texts; null where either is null or has a zero vector."""
        sides = {"_left": left, "_right": right}
        keyed = df.withColumns({side: F.sha2(text, 256) for side, text in sides.items()})
        pairs = F.array(*[F.struct(F.sha2(text, 256).alias("key"), text.alias("text")) for text in sides.values()])
        texts = df.select(F.explode_outer(pairs).alias("t")).select("t.*").where("key IS NOT NULL")
        # A key stands for its text, so any of its rows will do.
        vectors = self.encoded(texts.groupBy("key").agg(F.first("text").alias("text")))
        for side in sides:
            keyed = join_in_portions(keyed, vectors.withColumnsRenamed({"key": side, "vector": f"{side}_vector"}), side, *df.columns)
        return keyed.select(*df.columns, cosine(F.col("_left_vector"), F.col("_right_vector")).alias(out))


Encoder = ColumnEncoder | BatchEncoder | KeptEncoder
