"""Line-based formats: FASTA, aligned FASTA, hit tables, profiles and trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_file_ordinal(df: DataFrame, name: str = "ordinal", path_col: str = "_path", block_col: str = "_block") -> DataFrame:
    """Dense ordinals in file order from (path, block start) columns, without a global sort.

    Rows are numbered within their file block; a block adds the rows of the blocks
    before it, a table of one row a block.  One task reads a block from its start
    to its end, so row numbers of a task rise with the place in the block.
    """
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    sizes = rows.groupBy(path_col, block_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(path_col, block_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(path_col, block_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(path_col, block_col).orderBy("_at")) - 1
    out = rows.withColumn("_k", within).join(starts, [path_col, block_col])
    return out.withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_at", "_k", "_start", path_col, block_col)


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, header, id, sequence): one row a record, in file order; id is the header up to its first blank."""
    rows = _records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.trim("value") != "")
    header = F.trim(F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), "\r", ""))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    out = with_file_ordinal(rows).select("ordinal", header.alias("header"), body.alias("sequence"))
    return out.select("ordinal", "header", F.split_part("header", F.lit(" "), F.lit(1)).alias("id"), "sequence")


def read_fasta_loose(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, header, sequence): any line with a ``>`` in it opens a record, and its text without ``>`` is the header.

    A line's record is the number of headers up to it: those of the file blocks
    before, a table of one row a block, and those of its own block.
    """
    lines = _records(spark, path, "\n").withColumns({"_at": F.monotonically_increasing_id(), "_opens": F.col("value").contains(">").cast("long")})
    heads = lines.groupBy("_path", "_block").agg(F.sum("_opens").alias("_n"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.select("_path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.sum("_opens").over(Window.partitionBy("_path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("_k", within).join(starts, ["_path", "_block"]).withColumn("ordinal", F.col("_start") + F.col("_k") - 1).where("ordinal >= 0")
    head = F.max(F.when(F.col("_opens") == 1, F.trim(F.replace("value", F.lit(">"), F.lit("")))))
    part = F.when(F.col("_opens") == 0, F.struct("_path", "_block", "_at", F.regexp_replace("value", r"\s+", "").alias("s")))
    out = rows.groupBy("ordinal").agg(head.alias("header"), F.array_sort(F.collect_list(part)).alias("_p"))
    return out.select("ordinal", "header", F.array_join(F.transform("_p", lambda p: p["s"]), "").alias("sequence"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(id, score, profile): lines of a profile search table; comments are skipped; profile is the file's stem."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split(F.trim("value"), r"\s+")
    return lines.select(F.try_element_at(cells, F.lit(1)).alias("id"), F.try_element_at(cells, F.lit(6)).try_cast("double").alias("score"), F.regexp_replace("file", r"\.[^.]*$", "").alias("profile")).where(F.col("score").isNotNull())


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, accession, length, gathering): header fields of profile files."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    get = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}\s+(\S+)", 1), F.lit(""))
    return whole.select("file", get("NAME").alias("name"), get("ACC").alias("accession"), get("LENG").cast("int").alias("length"), get("GA").try_cast("double").alias("gathering"))


def read_profile_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, scores): the match line of each position, as negative logs; ``*`` is null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    cells = F.split(F.trim("value"), r"\s+")
    match = lines.where(F.col("value").rlike(r"^\s+\d+(\s+(\d+\.\d+|\*)){20}\s"))
    return match.select("file", cells[0].cast("int").alias("position"), F.transform(F.slice(cells, 2, 20), lambda x: x.try_cast("double")).alias("scores"))


def parse_newick(text: str) -> list[tuple[str, str | None, float | None]]:
    """(node, parent, length) rows of a tree text; nodes without a name are ``_1``, ``_2``, ... in order of their opening."""
    tokens = re.findall(r"\(|\)|,|;|:[^,();]+|'(?:[^']|'')*'|[^,():;]+", re.sub(r"\[[^\]]*\]", "", text.strip()))
    names, parents, lengths, stack, count = {}, {}, {}, [], 0
    now, fresh = None, 0

    def new(parent):
        nonlocal fresh
        fresh += 1
        parents[fresh], names[fresh], lengths[fresh] = parent, None, None
        return fresh

    now = new(None)
    for t in tokens:
        if t == "(":
            stack.append(now)
            now = new(now)
        elif t == ",":
            if not stack:
                raise ValueError("a comma outside of brackets")
            now = new(stack[-1])
        elif t == ")":
            if not stack:
                raise ValueError("unbalanced brackets")
            now = stack.pop()
        elif t == ";":
            break
        elif t[0] == ":":
            lengths[now] = float(t[1:])
        elif t.strip():
            names[now] = t.strip().strip("'")
    if stack:
        raise ValueError("unbalanced brackets")
    label = {}
    for k in sorted(parents):
        if names[k] is None:
            count += 1
        label[k] = names[k] if names[k] is not None else f"_{count}"
    return [(label[k], label.get(parents[k]), lengths[k]) for k in sorted(parents)]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Edge table (node, parent, length) of one tree file."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_newick(text), "node string, parent string, length double")


def write_fasta(df: DataFrame, path: str, id_col: str | None = "id", sequence_col: str = "sequence", ordinal: str = "ordinal") -> None:
    """One record a row; without ids the ordinal is the header."""
    head = F.col(id_col if id_col else ordinal).cast("string")
    df.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col(sequence_col)).alias("value")).write.text(path)
