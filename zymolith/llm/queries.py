"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .exact_dedup import exact_dedup
from .line_dedup import drop_template_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import fit_on as fit_quality
from .quality import score_quality
from .secrets import find_secrets, secret_digest
from .sentence_pieces import encode_pieces
from .substring_dedup import substring_dedup
from .surrogates import replace_personal_data
from .toxicity import fit_on, score_toxicity
from .vector_codes import vector_codes
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(_table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_template_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model, host=F.col("source"), path=F.col("lang"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_on(docs, _table(spark, sf_dir, "labels")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session; without one, for invented tables only, a public value."""
    key = spark.conf.get("spark.zymolith.surrogates.key", "no secret")
    return replace_personal_data(_table(spark, sf_dir, "documents"), key.encode())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model file of the installed vocabularies is read here and goes to the executors with the job."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return encode_pieces(_table(spark, sf_dir, "documents"), model)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_surrogates": op8_surrogates,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_sentence_pieces": op13_sentence_pieces,
}

_WORDS = "w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_LOGIN = r"""((?i:user(?:_?name)?|login|account|client_?id))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]{3,})"""
_ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{0,30}://[^\x20\x09-\x0D"''<>]+"""


def _found(kind: str, pattern: str, group: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS match, unnest(v) AS val, unnest(g[1:len(m)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d)"""


def _near(part: str) -> str:
    return f"""coalesce(start - max(CASE WHEN part = '{part}' THEN stop END) OVER before <= 300, false) OR coalesce(min(CASE WHEN part = '{part}' THEN start END) OVER after - stop <= 300, false)"""


_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  raw AS ({" UNION ALL ".join([_found("assign", _ASSIGN, 2), _found("access", "AKIA[A-Z0-9]+", 0), _found("hex", "[0-9a-f]+", 0), _found("login", _LOGIN, 2), _found("endpoint", _ENDPOINT, 0)])}),
  placed AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM raw),
  named AS (SELECT doc_id, stop - length(match) AS start, stop, CASE WHEN kind = 'assign' AND length(val) < 12 THEN CASE WHEN length(val) >= 6 THEN 'pass' END
      WHEN kind = 'access' AND length(match) < 18 OR kind = 'hex' AND length(match) < 16 THEN NULL ELSE kind END AS kind FROM placed),
  parts AS (SELECT *, CASE WHEN kind IN ('access', 'login') THEN 'id' WHEN kind IN ('assign', 'hex', 'pass') THEN 'secret' ELSE 'endpoint' END AS part FROM named WHERE kind IS NOT NULL),
  seen AS (SELECT *, {_near("id")} AS by_id, {_near("secret")} AS by_secret, {_near("endpoint")} AS by_endpoint FROM parts
    WINDOW before AS (PARTITION BY doc_id ORDER BY start, stop, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY doc_id ORDER BY start, stop, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  kept AS (SELECT *, kind || ':' || start || ':' || stop AS line, list_position(['assign', 'access', 'hex', 'login', 'pass', 'endpoint'], kind) AS r FROM seen
    WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'pass' AND (by_id OR by_endpoint)) OR (kind IN ('login', 'endpoint') AND by_secret))
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(line, ',' ORDER BY start, r) FILTER (r <= 3), '')) AS base_sha256, coalesce(string_agg(line, ',' ORDER BY start, r), '') AS spans,
    count(*) FILTER (kind = 'login') AS n_login, count(*) FILTER (kind = 'pass') AS n_pass, count(*) FILTER (kind = 'endpoint') AS n_endpoint
  FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""

_LINES = r"""WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> '')),
  r AS (SELECT doc_id, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM l),
  h AS (SELECT *, len(list_filter(raw, lambda x: NOT regexp_matches(x, '[0-9]'))) < 0.6 * len(raw) AS heavy FROM r WHERE len(raw) > 0),
  t AS (SELECT doc_id, k, heavy, CASE WHEN heavy THEN raw ELSE list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) END AS w FROM h),
  deep AS (SELECT doc_id, k, w, len(w) || ' ' || array_to_string(CASE WHEN heavy THEN w ELSE w[1:3] END, ' ') || CASE WHEN heavy THEN ' !' ELSE '' END AS leaf FROM t),
  c AS (SELECT * FROM deep WHERE leaf IN (SELECT leaf FROM deep GROUP BY leaf HAVING count(DISTINCT doc_id) >= 4)),
  tok AS (SELECT doc_id, k, leaf, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM c),
  often AS (SELECT leaf, p, x FROM tok WHERE p > 3 AND x <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4),
  shown AS (SELECT doc_id, k, leaf, p, CASE WHEN x <> '<*>' AND (p <= 3 OR o.x IS NOT NULL) THEN tok.x ELSE '<*>' END AS y FROM tok LEFT JOIN often o USING (leaf, p, x)),
  tpl AS (SELECT doc_id, k, leaf || '|' || string_agg(y, ' ' ORDER BY p) AS tpl FROM shown GROUP BY doc_id, k, leaf HAVING count(*) FILTER (y <> '<*>') >= 0.6 * count(*)),
  gone AS (SELECT doc_id, k FROM tpl WHERE tpl IN (SELECT tpl FROM tpl GROUP BY tpl HAVING count(DISTINCT doc_id) >= 4)),
  kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE {_WORDS},
  sh AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)) GROUP BY ALL),
  n AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY doc_id),
  m AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM m JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE m >= 0.8 * (p.n + q.n - m) - 1e-9
    UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.doc_id <> b.doc_id),
  reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
  cls AS (SELECT w.doc_id, least(w.doc_id, min(y)) AS class_id FROM w LEFT JOIN reach ON x = w.doc_id GROUP BY w.doc_id)
  SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM cls"""

_SUBSTRINGS = f"""WITH {_WORDS},
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
  twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
  gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice CROSS JOIN range(35) r(k)),
  word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
  kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL), '') AS text
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""



def _lloyd(rounds: int) -> str:
    far = "list_sum(list_transform(range(1, len(c) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i])))"
    near = "SELECT p, part, w, arg_min(e, [far, e]) AS e, min(far) AS far FROM (SELECT d.p, part, w, e, {far} AS far FROM d JOIN b{k} b ON b.p = d.p) GROUP BY ALL"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(far=far, k=k)})")
        steps.append(f"""s{k} AS (SELECT p, e, j, sum(part[j]::HUGEINT * w) AS s, sum(w)::HUGEINT AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM a{k}) GROUP BY ALL)""")
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN
          (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return ",\n  ".join([*steps, f"a{rounds} AS MATERIALIZED ({near.format(far=far, k=rounds)})"])


_CODES = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pieces AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS part FROM (SELECT *, unnest(range(0, 8)) AS p FROM kept)),
  d AS MATERIALIZED (SELECT p, part, count(*) AS w FROM pieces GROUP BY ALL),
  b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c FROM pieces QUALIFY e < 16),
  {_lloyd(6)},
  one AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM pieces JOIN a6 USING (p, part) GROUP BY vec_id, label),
  book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(range(1, len(c) + 1)) AS j, unnest(c) AS x FROM b6))
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM one"""

#: DuckDB statements for the queries that SQL expresses, over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": _SECRETS,
    "op2_line_dedup": _LINES,
    "op4_minhash_dedup": _NEAR,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_substring_dedup": _SUBSTRINGS,
    "op11_vector_codes": _CODES,
}
