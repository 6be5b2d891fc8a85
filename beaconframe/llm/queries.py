"""The operators bound to the synthetic tables, one query each, and SQL where it can say the same.

Each query runs over its whole table.  Where there is no SQL the tests compare the operator
with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, licenses, line_dedup, mixing, packing, quality, shard_store, simhash, url_rules
from .common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary())


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), digest=True)


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in small shards in a new store; what its last version holds after compaction."""
    docs = table(spark, sf_dir, "documents")
    kept = compacted(docs, scratch_path(spark, "store")).read()
    return kept.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def compacted(docs: DataFrame, root: str) -> shard_store.ShardStore:
    """A store into which ``docs`` came as shards of 4 MB, or as 64 of them where the table is smaller than that."""
    store = shard_store.ShardStore(docs.sparkSession, root)
    store.ingest(docs, shard_rows=min(shard_store.rows_per_shard(docs, 4 << 20), max(1, docs.count() // 64)))
    return store


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), slim=True)
    return mixed.select("doc_id", *(f"mix.{c}" for c in ("size", "source_size", "target", "taken")))


def vocabulary() -> dict[str, str]:
    """The public byte-level vocabulary, and the same as ranks."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def queries() -> dict[str, Query]:
    found = (op1_licenses, op2_url_rules, op3_quality, op4_packing, op5_nearest, op6_line_dedup, op7_compaction, op8_simhash, op9_html_text, op10_mixing)
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2 = rf"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(no, verdict, rhost, rpath) AS (VALUES {", ".join(f"({i}, '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(url_rules.RULES))}),
f AS (
  SELECT u.*, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC, no) AS n
  FROM u LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""

_OP6 = rf"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP7 = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS n_cells, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source),
w AS (SELECT *, (n - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), n) AS nth FROM w),
v AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM o WINDOW b AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, n_cells,
    CASE WHEN most < level * weight OR x.open_level IS NULL THEN CAST(most AS DOUBLE) ELSE weight * x.open_level END AS target
  FROM v CROSS JOIN (SELECT arg_min(level, nth) FILTER (NOT most < level * weight) AS open_level FROM v) x),
p AS (
  SELECT d.*, source_size, n_cells, target, CASE WHEN source_size > 0 THEN least(target / CAST(source_size AS DOUBLE), CAST(3 AS DOUBLE)) ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS chance FROM p),
k AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM q),
r AS (SELECT *, odds / (1 + odds) AS place, CAST(floor(odds / (1 + odds) * n_cells) AS BIGINT) AS cell FROM k),
c AS (
  SELECT source, cell, target, sum(certain * size) AS fixed, sum(CASE WHEN cell IS NOT NULL THEN size ELSE 0 END) AS words FROM r GROUP BY source, cell, target),
g AS (
  SELECT *, target - sum(fixed) OVER (PARTITION BY source) AS gap, sum(words) OVER (PARTITION BY source ORDER BY cell NULLS FIRST) AS until FROM c),
e AS (SELECT source, min(cell) AS end_cell, arg_min(until - words, cell) AS before, arg_min(gap, cell) AS gap FROM g WHERE cell IS NOT NULL AND until > gap GROUP BY source),
h AS (
  SELECT r.*, end_cell, gap, before,
    CASE WHEN cell = end_cell THEN before + sum(size) OVER (PARTITION BY r.source, cell ORDER BY place, doc_id, size) END AS up_to
  FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source),
i AS (SELECT *, gap - coalesce(max(up_to) FILTER (up_to <= gap) OVER (PARTITION BY source), before) AS miss FROM h),
j AS (
  SELECT *, CASE WHEN up_to > gap AND abs(size - miss) < miss
    THEN row_number() OVER (PARTITION BY source, up_to > gap AND abs(size - miss) < miss ORDER BY abs(size - miss), place, doc_id) END AS fit
  FROM i)
SELECT doc_id, size, source_size, target,
  CAST((certain + CASE WHEN place IS NOT NULL AND (end_cell IS NULL OR cell < end_cell OR up_to <= gap OR fit = 1) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": _OP2, "op6_line_dedup": _OP6, "op7_compaction": _OP7, "op10_mixing": _OP10}
