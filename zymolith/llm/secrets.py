"""Secret scanning with multipart credential linking, in built-in functions.

Matches become (kind, start, end) rows: ``split`` by a pattern gives the gaps
between its matches, and running sums of gap and match lengths give positions.
Strong findings are reported as they are.  Weak candidates (login names, short
passwords, endpoints) are parts of a credential: a part is reported only if the
parts that complete it lie within ``scope`` code points in the same document.
That interval join is a sweep over the document's spans in order of start, with
the nearest earlier end and later start of each part; it makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_text

#: Fixed values of the base findings.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # runs [0-9a-f]+ of 16 characters or more
#: Patterns of weak candidates.
LOGIN = r"""((?i:user(?:_?name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
#: The scheme of an endpoint is bounded, so that a long run of letters costs its length, not its square.
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{0,30}://[^\x20\x09-\x0D"'<>]+"""

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "login", "pass", "endpoint")
SCOPE = 300


def _matches(text: Column, kind: str, pattern: str, possible: Column, group: int) -> Column:
    """Array of (kind, gap before, match, size of the value) in order; empty unless ``possible``.

    The gap after the last match comes without one and is left out.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [whole.alias("m"), F.split(text, pattern, -1).alias("g")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x["m"].isNotNull())
    size = lambda x: F.length(x["v"]) if group else F.length(x["m"])
    out = F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), x["m"].alias("match"), size(x).alias("size")))
    return F.when(possible, out).otherwise(F.array().cast("array<struct<kind:string,gap:int,match:string,size:int>>"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found), one row per row of ``docs``; ``found``: array of
    (start, rank, kind, end, base, text) in order of start and kind.

    Positions are code points, end exclusive.  ``base`` is true for ``assign``
    (value of 12 characters or more), ``access`` (18 or more) and ``hex`` (16 or
    more): leftmost matches that do not overlap, each kind by itself.  ``login``,
    ``pass`` (an assigned value of 6 to 11 characters) and ``endpoint`` are weak: a
    login name needs a secret within ``scope``, a short password a login name, an
    access identifier or an endpoint, an endpoint a secret.

    Null or empty text: nothing found.  Null or repeated ids: each row has its
    own result.  Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text")
    sign = text.contains(":") | text.contains("=")
    kinds = [
        _matches(text, "assign", ASSIGN, sign & text.rlike(ASSIGN), 2),
        _matches(text, "access", ACCESS, text.contains("AKIA"), 0),
        _matches(text, "hex", HEX, text.rlike(HEX), 0),
        _matches(text, "login", LOGIN, sign & text.rlike(LOGIN), 2),
        _matches(text, "endpoint", ENDPOINT, text.contains("://"), 0),
    ]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text"))
    lists = rows.select("row", "doc_id", F.array(*kinds).alias("lists"))
    lists = lists.select("row", "doc_id", F.explode_outer("lists").alias("list"))
    # one row a match, and one a document at least
    spans = lists.select("row", "doc_id", F.posexplode_outer("list").alias("nth", "x")).select("row", "doc_id", "nth", "x.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    spans = spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    kind = F.when(F.col("kind") != "assign", F.col("kind")).when(F.col("size") >= 12, "assign").when(F.col("size") >= 6, "pass")
    spans = spans.withColumn("kind", kind)
    part = F.when(F.col("kind").isin("access", "login"), "id").when(F.col("kind").isin("assign", "hex", "pass"), "secret").when(F.col("kind") == "endpoint", "endpoint")
    spans = spans.withColumn("part", part)

    sweep = Window.partitionBy("row").orderBy("start", "end", "kind")
    before, after = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(1, Window.unboundedFollowing)

    def near(name: str) -> Column:
        mine = F.col("part") == name
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before)
        right = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(left <= scope, F.lit(False)) | F.coalesce(right <= scope, F.lit(False))

    spans = spans.withColumns({"by_id": near("id"), "by_secret": near("secret"), "by_endpoint": near("endpoint")})
    base = F.col("kind").isin("assign", "access", "hex")
    linked = F.when(F.col("kind") == "pass", F.col("by_id") | F.col("by_endpoint")).otherwise(F.col("by_secret"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    item = F.struct("start", rank.alias("rank"), "kind", "end", base.alias("base"), F.col("match").alias("text"))
    spans = spans.withColumn("item", F.when(F.col("kind").isNotNull() & (base | linked), item))
    return spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("item")).alias("found")).drop("row")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of ``find_secrets``."""
    base = F.filter("found", lambda x: x["base"])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
        *[count(k) for k in KINDS[3:]],
    )
