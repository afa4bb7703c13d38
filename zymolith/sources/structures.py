"""Protein structures as atom rows, from fixed-width text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of an ATOM line as it is written.
LINE = 66


def hybrid_text(number: str, width: int) -> Column:
    """A whole number in ``width`` places: decimal, or beyond that hybrid-36, from A000... to ZZZZ..., then from a000...; an error past zzzz...."""
    n, decimal, letters = F.col(number).cast("long"), 10**width, 26 * 36 ** (width - 1)
    text = lambda k: F.conv((n - decimal - k * letters + 10 * 36 ** (width - 1)).cast("string"), 10, 36)
    beyond = F.raise_error(F.concat(F.lit(f"no place for {number} "), n.cast("string"))).cast("string")
    far = F.when(n < decimal + letters, text(0)).when(n < decimal + 2 * letters, F.lower(text(1))).otherwise(beyond)
    return F.when((n > -(decimal // 10)) & (n < decimal), n.cast("string")).when(n >= decimal, far).when(n.isNotNull(), beyond).otherwise(F.lit(""))


def hybrid_number(text: Column, width: int) -> Column:
    """The whole number that ``hybrid_text`` wrote; null if it is none, as a blank is."""
    value = F.conv(text, 36, 10).try_cast("long") - 10 * 36 ** (width - 1) + 10**width
    far = F.when(text.rlike(f"^[A-Z][0-9A-Z]{{{width - 1}}}$"), value).when(text.rlike(f"^[a-z][0-9a-z]{{{width - 1}}}$"), value + 26 * 36 ** (width - 1))
    return F.when(text.rlike("^[A-Za-z]"), far).otherwise(text.try_cast("long")).try_cast("int")


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, serial, atom, residue_name, chain, residue, insertion, x, y, z, confidence, model): ATOM records.

    ``serial`` is the place in the record, not in the file, and repeats by model.
    """
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    lines = spark.read.text(path).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.(pdb|ent)$", "").alias("file"))
    atoms = lines.where(F.col("value").startswith("ATOM"))
    number = lambda a, b: cut(a, b).try_cast("double")
    return atoms.select(
        "file",
        hybrid_number(cut(7, 11), 5).alias("serial"),
        cut(13, 16).alias("atom"),
        cut(18, 20).alias("residue_name"),
        F.substring("value", 22, 1).alias("chain"),
        hybrid_number(cut(23, 26), 4).alias("residue"),
        cut(27, 27).alias("insertion"),
        number(31, 38).alias("x"),
        number(39, 46).alias("y"),
        number(47, 54).alias("z"),
        number(61, 66).alias("confidence"),
    )


def secondary_residues(spark: SparkSession, path: str) -> DataFrame:
    """(file, residue): residues of HELIX and SHEET records; files without any have no rows."""
    lines = spark.read.text(path).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.(pdb|ent)$", "").alias("file"))
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1)).try_cast("int")
    helix = lines.where(F.col("value").startswith("HELIX")).select("file", cut(22, 25).alias("lo"), cut(34, 37).alias("hi"))
    sheet = lines.where(F.col("value").startswith("SHEET")).select("file", cut(23, 26).alias("lo"), cut(34, 37).alias("hi"))
    runs = helix.unionByName(sheet).where(F.col("lo") <= F.col("hi"))
    return runs.select("file", F.explode(F.sequence("lo", "hi")).alias("residue")).distinct()


def confident_residues(atoms: DataFrame, threshold: float = 70.0) -> DataFrame:
    """(file, residue) whose first atom has at least ``threshold`` confidence."""
    first = atoms.groupBy("file", "chain", "residue").agg(F.min_by("confidence", "serial").alias("confidence"))
    return first.where(F.col("confidence") >= threshold).select("file", "residue").distinct()


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    """(file, residue, x, y, z): the first alpha carbon of each residue."""
    w = Window.partitionBy("file", "residue").orderBy("chain", "serial")
    return atoms.where(F.col("atom") == "CA").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("file", "residue", "x", "y", "z")


# Files that hold templates, not candidates.
TEMPLATE_FILES = ("1ps1", "5eat", "3p5r", "P48449")


def needed_files(listing: DataFrame, needed: DataFrame, with_structure: DataFrame) -> DataFrame:
    """(file, clean): files with secondary structure whose stem, or stem without brackets and dashes, is a needed id."""
    domains = F.regexp_replace("file", "_object$", "").isin("alpha", "beta", "gamma", "delta", "epsilon")
    files = listing.where(~F.col("file").isin(*TEMPLATE_FILES) & ~domains).join(with_structure.select("file").distinct(), "file", "left_semi")
    files = files.withColumn("clean", F.regexp_replace("file", r"[()\-]", ""))
    ids = needed.select("id").distinct()
    by_name = files.join(ids, files["file"] == ids["id"], "left_semi")
    by_clean = files.join(ids, files["clean"] == ids["id"], "left_semi")
    return by_name.unionByName(by_clean).distinct()


def write_atoms(atoms: DataFrame, path: str, by: str = "module_id") -> None:
    """ATOM lines, partitioned by ``by``; serials and residues too long for their columns are in hybrid-36, other such values an error."""
    line = F.format_string(
        "ATOM  %5s %-4s %3s %s%4s%1s   %8.3f%8.3f%8.3f  1.00%6.2f",
        hybrid_text("serial", 5), F.when(F.length("atom") < 4, F.concat(F.lit(" "), "atom")).otherwise(F.col("atom")), "residue_name", "chain", hybrid_text("residue", 4), "insertion", "x", "y", "z", "confidence",
    )
    fits = F.when(F.length("value") == LINE, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("too wide for its columns: "), "value")).cast("string"))
    atoms.select(by, line.alias("value")).select(by, fits.alias("value")).write.partitionBy(by).text(path)
