"""Chemistry helpers on structure texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .molecules import canonical_text

PASSED_ON = ("Unknown", "Negative")


def without_stereo_marks(smiles: Column) -> Column:
    """The text without stereo marks: not canonical, but one text for stereo isomers written alike."""
    plain = F.regexp_replace(F.regexp_replace(smiles, r"[@/\\]", ""), r"\[([BCNOPSFI]|Cl|Br)H?\d?\]", "$1")
    return F.when(smiles.isNull() | smiles.isin(*PASSED_ON), smiles).otherwise(plain)


def canonical(df: DataFrame, column: str, out: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Adds canonical texts without stereo; null and the words in PASSED_ON stay, texts that are no structure become null.

    From ``dictionary`` (text, canonical) if given, else by ``molecules.canonical_text``
    in Arrow batches over the distinct texts.
    """
    if dictionary is None:

        @F.pandas_udf("string")
        def call(texts: pd.Series) -> pd.Series:
            def one(t: str) -> str | None:
                try:
                    return canonical_text(t)
                except ValueError:
                    return None

            return texts.map(one)

        known = df.select(F.col(column).alias("text")).where(F.col(column).isNotNull() & ~F.col(column).isin(*PASSED_ON)).distinct()
        # a second distinct() above would let the optimizer drop this one, and call the function for every row
        names = known.select(F.col("text").alias(column), call("text").alias("_c"))
    else:
        names = dictionary.select(F.col("text").alias(column), F.col("canonical").alias("_c")).distinct()
    joined = df.join(names, column, "left")
    return joined.withColumn(out, F.when(F.col(column).isin(*PASSED_ON), F.col(column)).otherwise(F.col("_c"))).drop("_c")


def carbon_atoms(smiles: Column) -> Column:
    """Aliphatic carbon atoms: letters C that start no other symbol."""
    return F.regexp_count(smiles, F.lit(r"C(?![laroudsemnf])"))
