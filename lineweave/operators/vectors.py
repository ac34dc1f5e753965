"""Vectors of texts: a growing table of them, and near pairs by random hyperplanes.

A vector table has norm_text and vector. It is asked for texts first; only those that it lacks go to the user's function, so
that a text is embedded once, however many runs have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.sources.scratch import cut

VECTORS = "norm_text string, vector array<double>"
#: Texts that the user's function gets at a time.
BATCH = 256


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The vectors written so far; none if nothing is there. A text that two runs wrote at once counts once."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(VECTORS).parquet(path).dropDuplicates(["norm_text"]) if there else spark.createDataFrame([], VECTORS)


def extended(texts: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], *, batch: int = BATCH) -> DataFrame:
    """The vectors of all texts (norm_text); those that the table at `path` lacks are made by embed() and appended.

    embed gets at most `batch` texts and gives a row of numbers for each. Null and empty texts have no vector.
    """
    spark = texts.sparkSession

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), batch):
                own = part["norm_text"].iloc[k : k + batch].tolist()
                yield pd.DataFrame({"norm_text": own, "vector": [np.asarray(v, np.float64) for v in embed(own)]})

    wanted = cut(texts.where("norm_text <> ''").select("norm_text").distinct(), "texts")
    lacking = wanted.join(stored(spark, path).select("norm_text"), "norm_text", "left_anti")
    lacking.mapInPandas(made, VECTORS).write.mode("append").parquet(path)
    return stored(spark, path).join(wanted, "norm_text", "left_semi")


def planes(dim: int, bits: int, tables: int, seed: int = 1) -> np.ndarray:
    """tables x bits normal vectors, the same on every worker."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def signatures(vectors: DataFrame, dim: int, bits: int, tables: int, seed: int = 1) -> DataFrame:
    """Adds sigs: for each table of hyperplanes on which side of them a vector lies, as one number. Vectors of another length than dim have none."""

    @F.pandas_udf("array<long>")
    def signed(v: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(v)
        at = [k for k, x in enumerate(v) if x is not None and len(x) == dim]
        if at:
            x = np.stack([v.iloc[k] for k in at]).astype(np.float64)
            side = np.einsum("nd,tbd->ntb", x, planes(dim, bits, tables, seed)) > 0
            for k, s in zip(at, (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2), strict=True):
                out[k] = s
        return pd.Series(out)

    return vectors.withColumn("sigs", signed("vector"))


def near(a: DataFrame, b: DataFrame, least: float, *, dim: int, bits: int = 12, tables: int = 24, seed: int = 1, exact: bool = False) -> DataFrame:
    """Pairs of texts with a cosine of `least` or more: a_text, b_text, score. a, b: norm_text, vector.

    Two vectors at an angle t agree on all of a table's hyperplanes with a chance of (1 - t / pi) ** bits, so of pairs at `least`
    one table misses a known share and `tables` of them that share to the power of their number; recall() gives what is
    left. Every pair that is met is scored, each once. `exact` scores all pairs, both sides dealt into square blocks.
    """
    size = lambda df, s: df.where(F.size("vector") == dim).select(F.col("norm_text").alias(f"{s}_text"), F.col("vector").alias(f"{s}_vector"))
    if exact:
        x, y = cut(size(a, "a"), "vectors"), cut(size(b, "b"), "vectors")
        n, m = (max(1, -(-df.count() // 2000)) for df in (x, y))
        left = x.withColumns({"i": F.pmod(F.xxhash64("a_text"), F.lit(n)), "j": F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))})
        right = y.withColumns({"j": F.pmod(F.xxhash64("b_text"), F.lit(m)), "i": F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))})
        met = left.join(right, ["i", "j"])
    else:
        sides = [cut(signatures(df.where(F.size("vector") == dim), dim, bits, tables, seed).select(F.col("norm_text").alias(f"{s}_text"), F.col("vector").alias(f"{s}_vector"), "sigs"), "signed") for df, s in ((a, "a"), (b, "b"))]
        keys = [df.select(f"{s}_text", F.posexplode("sigs").alias("t", "sig")) for df, s in zip(sides, "ab", strict=True)]
        ids = keys[0].join(keys[1], ["t", "sig"]).select("a_text", "b_text").distinct()
        met = ids.join(sides[0].drop("sigs"), "a_text").join(sides[1].drop("sigs"), "b_text")
    scored = met.select("a_text", "b_text", F.round(text.cosine(F.col("a_vector"), F.col("b_vector")), 4).alias("score"))
    return scored.where(F.col("score") >= least)


def recall(cosine: float, bits: int, tables: int) -> float:
    """The chance that near() meets a pair of this cosine."""
    return 1 - (1 - (1 - np.arccos(cosine) / np.pi) ** bits) ** tables
