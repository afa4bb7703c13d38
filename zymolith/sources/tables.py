"""Delimited, JSON, columnar and spreadsheet tables, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import BLACKLIST_COMMENTS
from ..functions.running import in_parts

# Columns of the reaction table and their names here.
REACTION_COLUMNS = {
    "Uniprot ID": "id",
    "Amino acid sequence": "sequence",
    "Type (mono, sesq, di, …)": "type",
    "Substrate (including stereochemistry)": "substrate_name",
    "SMILES of substrate": "substrate",
    "SMILES of product (including stereochemistry)": "product",
    "Fragment": "fragment",
    "Product is major": "product_is_major_raw",
    "Kingdom (plant, fungi, bacteria)": "kingdom_raw",
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, complete: Sequence[str] | None = None) -> DataFrame:
    """A delimited table; quoted fields may span lines.  ``complete``: columns that must be there (empty: all)."""
    reader = spark.read.option("sep", sep).option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df if complete is None else df.na.drop(subset=list(complete) or None)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, "\t", header)


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select(*[F.col(f"`{c}`").alias(REACTION_COLUMNS.get(c, c)) for c in df.columns])


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """First sheet of a workbook, read on the driver; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl; convert the sheet to CSV instead") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path), schema)


def commented_blacklist(comments: DataFrame, id_col: str = "id", text: str = "comment", parts: Sequence[str] = BLACKLIST_COMMENTS) -> DataFrame:
    """Distinct ids whose comment has one of ``parts``."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.coalesce(F.col(text).contains(p), F.lit(False))
    return comments.where(hit).select(id_col).distinct()


def read_json_hits(spark: SparkSession, path: str, classes: Sequence[str]) -> DataFrame:
    """(id, class columns): one JSON object a file, named by its id."""
    schema = ", ".join(f"`{c}` double" for c in classes)
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("id"), *[F.col(f"`{c}`") for c in classes])


def hit_name(id_column: Column) -> Column:
    """An id as a file name: up to its first blank, without slashes."""
    return F.replace(F.split_part(id_column, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(""))


def write_hits(df: DataFrame, path: str, id_col: str = "id") -> None:
    """JSON lines with a safe ``name``; one directory, appended to, not one file a hit."""
    df.withColumn("name", hit_name(F.col(id_col))).write.mode("append").json(path)


def gathered(hits: DataFrame, order: str) -> DataFrame:
    return hits.orderBy(F.desc(order), "id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)


def read_vectors(spark: SparkSession, path: str, id_col: str, vector_col: str, order: str | None = None) -> DataFrame:
    """(id, embedding), the first row of each id in ``order``."""
    from ..operators.relations import first_per_key

    df = spark.read.parquet(path)
    picked = first_per_key(df, [id_col], [order or vector_col])
    return picked.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))


def read_vector_shards(ids: DataFrame, vectors: DataFrame, wanted: DataFrame, shard: str = "shard") -> DataFrame:
    """(id, embedding) of wanted ids from paired shards.

    ``ids``: (shard, ids array); ``vectors``: (shard, position, embedding).  Only
    shards with a wanted id are read further.
    """
    places = ids.select(shard, F.posexplode("ids").alias("position", "id")).join(wanted.select("id").distinct(), "id", "left_semi")
    return vectors.join(places, [shard, "position"]).select("id", "embedding")


def write_folds(df: DataFrame, path: str) -> None:
    """Appends to partitions (split, fold); missing strings are named."""
    texts = [c for c, t in df.dtypes if t == "string" and c not in ("split", "fold")]
    df.na.fill("__*missing*__", texts).write.mode("append").partitionBy("split", "fold").parquet(path)


def read_fold(spark: SparkSession, path: str, split: str, fold: str) -> DataFrame:
    """One fold; only its partition is read."""
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("fold") == fold))


def read_folds(spark: SparkSession, path: str, split: str, unsplittable: str = "unsplittable_targets") -> DataFrame:
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("fold") != unsplittable))


def write_regions(df: DataFrame, path: str) -> None:
    """Partitions by domain, next to all regions under ``domain=all``."""
    both = df.unionByName(df.withColumn("domain", F.lit("all")))
    both.write.mode("append").partitionBy("domain").parquet(path)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def run_count(df: DataFrame, column: str, order: str) -> DataFrame:
    """Runs of equal neighbouring values: what counting unsorted lines gives; a null and what follows it are runs.

    Counted within ranges of ``order``; a range's first row is compared with the
    last one of the range before, a table of one row a range.
    """
    rows = in_parts(df.select(F.col(column).alias("v"), F.col(order).alias("o")), ["o"])
    w = Window.partitionBy("_part").orderBy("o", "_tie")
    new = lambda before: F.coalesce((before != F.col("v")).cast("int"), F.lit(1))
    inner = rows.withColumns({"k": F.row_number().over(w), "new": new(F.lag("v").over(w))})
    place = F.struct("o", "_tie")
    parts = inner.groupBy("_part").agg(F.sum(F.when(F.col("k") > 1, F.col("new")).otherwise(0)).alias("n"), F.min_by("v", place).alias("v"), F.max_by("v", place).alias("last"))
    return parts.withColumn("n", F.col("n") + new(F.lag("last").over(Window.orderBy("_part")))).agg(F.sum("n").alias("n"))
