"""Cleaning expressions over the reaction table.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sides import small_side
from ..functions.fixed_values import KINGDOMS

MAX_LENGTH = 2000


def mapped(column: Column, mapping: Mapping[str, str], keep_unmatched: bool = False) -> Column:
    """Dictionary lookup; unmatched values become null, or stay."""
    if not mapping:
        return column if keep_unmatched else F.lit(None).cast("string")
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), column)
    return F.coalesce(found, column) if keep_unmatched else found


def kingdom(column: Column) -> Column:
    return mapped(column, KINGDOMS, keep_unmatched=True)


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not listed; a null value is not listed and stays."""
    return df.join(values.select(F.col(value).alias(column)).distinct(), column, "left_anti")


def present_or(column: Column, kind: Column, sentinel: str = "Negative") -> Column:
    return column.isNotNull() | F.coalesce(kind == sentinel, F.lit(False))


def conditional_fixes(target: Column, rules: Sequence[tuple[Column, str]]) -> Column:
    """The value of the last rule that holds, else the target: later assignments overwrite earlier ones."""
    out = target
    for condition, value in rules:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def any_present(*columns: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in columns]).isNotNull()


def complete(substrate: Column, product: Column, fragment: Column) -> Column:
    """Either column is present and the row is no fragment."""
    return any_present(substrate, product) & ~F.coalesce(F.lower(fragment) == "yes", F.lit(False))


def carbon_letters(column: Column) -> Column:
    """Letters c and C; also those of other element symbols, on purpose."""
    return F.length(F.regexp_replace(F.lower(column), "[^c]", ""))


def carbon_balanced(substrate: Column, product: Column) -> Column:
    return F.coalesce(carbon_letters(substrate) == carbon_letters(product), F.lit(False))


def can_be_canonical(product: Column) -> Column:
    """A text without the letters k and t, which words like Unknown have."""
    return F.coalesce(~product.contains("k") & ~product.contains("t"), F.lit(False))


def major_product(products: Column, flag: Column) -> Column:
    """With exactly one product anything but "no" counts, null too; else only "yes" does."""
    single = F.coalesce(F.lower(flag) != "no", F.lit(True))
    several = F.coalesce(F.lower(flag) == "yes", F.lit(False))
    return F.when(products == 1, single).otherwise(several)


def squeezed(sequence: Column) -> Column:
    """The sequence without white space of any kind, asterisks and quotes."""
    return F.regexp_replace(sequence, r"""(?U)[\s*"']+""", "")


def trimmed_id(column: Column, missing: str = "Negative") -> Column:
    return F.coalesce(F.trim(column), F.lit(missing))


def standard_residues(sequence: Column) -> Column:
    return ~sequence.rlike("[UO]")


def short_enough(sequence: Column, most: int = MAX_LENGTH) -> Column:
    return F.length(sequence) <= most


def truncated(sequence: Column, limit: int = 1022, to: int = 1020) -> Column:
    """Sequences longer than ``limit`` are cut to ``to`` residues."""
    return F.when(F.length(sequence) > limit, F.substring(sequence, 1, to)).otherwise(sequence)


def detected(score: Column, threshold: float, precursor: Column | None = None, use_precursor: bool = False) -> Column:
    out = score >= threshold
    return out | F.coalesce(precursor >= threshold, F.lit(False)) if use_precursor and precursor is not None else out


def signature_presence(*columns: Column) -> Column:
    return F.when(any_present(*columns), F.lit("With")).otherwise(F.lit("Without"))


def reaction_type(kind: Column, product_class: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The type of the first rule (kind, class, type) that fits; null if none does.  A rule's class may be ``*``."""
    out = None
    for k, c, value in rules:
        hit = (kind == k) & ((product_class == c) if c != "*" else F.lit(True))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def fold_column(df: DataFrame, folds: DataFrame, unsplittable: DataFrame, id_col: str, target: str) -> DataFrame:
    """Adds ``split`` ("fold_i", else "-1") and ``split_ignore_in_eval`` ("1" for targets that cannot be split, else "")."""
    names = folds.groupBy(id_col).agg(F.min("fold").alias("fold"))
    marks = unsplittable.select(F.col(target), F.lit("1").alias("_ignore")).distinct()
    out = df.join(names, id_col, "left").join(small_side(marks), target, "left")
    split = F.coalesce(F.concat(F.lit("fold_"), F.col("fold").cast("string")), F.lit("-1"))
    return out.withColumns({"split": split, "split_ignore_in_eval": F.coalesce("_ignore", F.lit(""))}).drop("fold", "_ignore")


def parameters_of(params: DataFrame, class_name: str) -> DataFrame:
    """(name, value): parameters named ``class_name``_<name>, over the shared ones without a class."""
    prefix = f"{class_name}_"
    own = params.where(F.col("name").startswith(prefix)).select(F.substring("name", len(prefix) + 1, 1 << 20).alias("name"), "value", F.lit(1).alias("rank"))
    shared = params.select("name", "value", F.lit(0).alias("rank"))
    return shared.unionByName(own).groupBy("name").agg(F.max_by("value", "rank").alias("value"))
