"""The same queries as SQL, written from their meaning and not from the plans."""

from __future__ import annotations

import re
from string import ascii_lowercase

_UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def _views() -> str:
    return f"""
raw AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS idx, CAST(label AS VARCHAR) AS language, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
views AS (SELECT idx, language, e[1:48] AS i0, e[17:64] AS t0 FROM raw),
unit AS (SELECT idx, language, {_UNIT.format(v='i0')} AS iv, {_UNIT.format(v='t0')} AS tv FROM views),
sims AS (SELECT q.idx AS id, a.idx AS anchor_id, round(list_dot_product(q.iv, a.iv), 9) AS si, round(list_dot_product(q.tv, a.tv), 9) AS st FROM unit q JOIN unit a ON a.idx <> q.idx),
images AS (SELECT id, anchor_id, si AS s, CAST(row_number() OVER (PARTITION BY id ORDER BY si DESC, anchor_id) AS INTEGER) AS rk FROM sims),
texts AS (SELECT id, anchor_id, st AS s, CAST(row_number() OVER (PARTITION BY id ORDER BY st DESC, anchor_id) AS INTEGER) AS rk FROM sims)"""


def _weighted(name: str, top: str, value: str, k: int = 20, norm: bool = True) -> str:
    v = f"(SELECT id, anchor_id, {value} AS v FROM {top} WHERE rk <= {k})"
    w = "v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12)" if norm else "v"
    return f"{name} AS (SELECT id, anchor_id, {w} AS w FROM {v})"


def _scored(value: str = "pow(s, 4)") -> str:
    return f"""{_weighted('wt', 'texts', value)}, {_weighted('wi', 'images', value)},
scored AS (SELECT t.id AS caption_id, i.id AS image_idx, round(sum(t.w * i.w), 9) AS score FROM wt t JOIN wi i ON t.anchor_id = i.anchor_id GROUP BY ALL),
grid AS (SELECT c.idx AS caption_id, c.language, i.idx AS image_idx, coalesce(score, 0) AS score FROM unit c CROSS JOIN unit i LEFT JOIN scored s ON s.caption_id = c.idx AND s.image_idx = i.idx),
ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caption_id ORDER BY score DESC, image_idx) AS rank FROM grid) WHERE image_idx = caption_id)"""


def _rates(mrr: bool = False) -> str:
    out = ", ".join(f"round(CAST(count(*) FILTER (rank <= {k}) AS DOUBLE) / greatest(count(*), 1), 9) AS r_at_{k}" for k in (1, 5, 10))
    return "count(*) AS n, " + out + (", round(avg(CASE WHEN rank <= 10 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END), 9) AS mrr" if mrr else "")


def _recall(of: str = "ranks", mrr: bool = False, keys: str = "") -> str:
    sets = f"(({keys}language), ({keys.rstrip(', ')}))"
    return f"SELECT {keys}CASE WHEN grouping(language) = 1 THEN 'overall' ELSE language END AS language, {_rates(mrr)} FROM {of} GROUP BY GROUPING SETS {sets}"


_DENSE = f"""
raw AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS idx, CAST(label AS VARCHAR) AS language, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
views AS (SELECT idx, language, e[17:48] AS a, sqrt(list_dot_product(e[17:64], e[17:64])) AS nt, sqrt(list_dot_product(e[1:48], e[1:48])) AS ni FROM raw),
sims AS (SELECT c.idx AS id, c.language, i.idx AS anchor_id, round(list_dot_product(list_transform(c.a, lambda x: x / greatest(c.nt, 1e-12)), list_transform(i.a, lambda x: x / greatest(i.ni, 1e-12))), 9) AS s FROM views c CROSS JOIN views i),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, anchor_id) AS INTEGER) AS rk FROM sims),
ranks AS (SELECT id, language, rk AS rank FROM best WHERE anchor_id = id)"""

_CAPS = r"""
lines AS (SELECT doc_id AS image_idx, lang AS language, unnest(string_split(text, E'\n')) AS caption, generate_subscripts(string_split(text, E'\n'), 1) AS at FROM documents),
caps AS (SELECT CAST(row_number() OVER (ORDER BY image_idx, at) - 1 AS BIGINT) AS caption_id, image_idx, language, caption FROM lines WHERE trim(caption) <> '')"""

_LETTERS = "[" + ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in ascii_lowercase) + "]"

_TOKENS = f"""
turns AS (SELECT conv_id, turn, {_LETTERS} AS h, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS m FROM conversations),
cells AS (SELECT conv_id, turn, m, unnest(h) AS x, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS at FROM turns)"""

_SWEEP = f"""
kp AS (SELECT k, p FROM (VALUES (5), (10), (20)) a(k) CROSS JOIN (VALUES (2), (4)) b(p)),
vt AS (SELECT k, p, id, anchor_id, pow(s, p) AS v FROM texts JOIN kp ON rk <= k),
vi AS (SELECT k, p, id, anchor_id, pow(s, p) AS v FROM images JOIN kp ON rk <= k),
wt AS (SELECT *, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY k, p, id)), 1e-12) AS w FROM vt),
wi AS (SELECT *, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY k, p, id)), 1e-12) AS w FROM vi),
scored AS (SELECT t.k, t.p, t.id AS caption_id, i.id AS image_idx, round(sum(t.w * i.w), 9) AS score FROM wt t JOIN wi i ON t.k = i.k AND t.p = i.p AND t.anchor_id = i.anchor_id GROUP BY ALL),
grid AS (SELECT kp.k, kp.p, c.idx AS caption_id, c.language, i.idx AS image_idx, coalesce(score, 0) AS score FROM kp CROSS JOIN unit c CROSS JOIN unit i LEFT JOIN scored s ON s.k = kp.k AND s.p = kp.p AND s.caption_id = c.idx AND s.image_idx = i.idx),
ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, p, caption_id ORDER BY score DESC, image_idx) AS rank FROM grid) WHERE image_idx = caption_id)"""


def _subsets(members: str) -> str:
    """Recall by subset; ``members`` makes subs (subset_id, anchor_id)."""

    def own(name: str, s: str) -> str:
        return f"""{name}r AS (SELECT subset_id, id, anchor_id, {s} AS s, row_number() OVER (PARTITION BY subset_id, id ORDER BY {s} DESC, anchor_id) AS rk FROM sims JOIN subs USING (anchor_id)),
{name}v AS (SELECT subset_id, id, anchor_id, pow(s, 4) AS v FROM {name}r WHERE rk <= 20),
{name} AS (SELECT *, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY subset_id, id)), 1e-12) AS w FROM {name}v)"""

    return f"""WITH {_views()},
{members}, {own('wt', 'st')}, {own('wi', 'si')},
scored AS (SELECT t.subset_id, t.id AS caption_id, i.id AS image_idx, round(sum(t.w * i.w), 9) AS score FROM wt t JOIN wi i ON t.subset_id = i.subset_id AND t.anchor_id = i.anchor_id GROUP BY ALL),
grid AS (SELECT b.subset_id, c.idx AS caption_id, c.language, i.idx AS image_idx, coalesce(score, 0) AS score FROM (SELECT DISTINCT subset_id FROM subs) b CROSS JOIN unit c CROSS JOIN unit i LEFT JOIN scored s ON s.subset_id = b.subset_id AND s.caption_id = c.idx AND s.image_idx = i.idx),
ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subset_id, caption_id ORDER BY score DESC, image_idx) AS rank FROM grid) WHERE image_idx = caption_id)"""


_COUNT = "CAST(greatest(20, round_even((SELECT count(*) FROM embeddings) * (pct / CAST(100 AS DOUBLE)), 0)) AS BIGINT)"
_FIRST_N = f"subs AS (SELECT CAST(CAST(pct AS INTEGER) AS VARCHAR) AS subset_id, idx AS anchor_id FROM unit CROSS JOIN (VALUES (CAST(100 AS DOUBLE)), (75), (50)) v(pct) WHERE idx < {_COUNT})"
_RANDOM = f"""runs AS (SELECT pct, seed, {_COUNT} AS n FROM (VALUES (CAST(100 AS DOUBLE)), (60), (40)) v(pct) CROSS JOIN (VALUES (0), (1), (2)) r(seed) WHERE pct < 100 OR seed = 0),
drawn AS (SELECT pct, seed, n, idx AS anchor_id, row_number() OVER (PARTITION BY pct, seed ORDER BY md5(idx || ':' || seed), idx) AS nth FROM unit CROSS JOIN runs),
subs AS (SELECT CAST(pct AS INTEGER) || '-' || seed AS subset_id, anchor_id FROM drawn WHERE nth <= n)"""
_SAFE = r"coalesce(nullif(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9._\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model')"
_LI = "li AS (SELECT *, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem)"
_MAIN = f"WITH {_views()}"
_PROFILE = f"{_MAIN}, one AS (SELECT q.idx AS id, a.idx AS anchor_id, round(list_dot_product(q.tv, a.tv), 9) AS s FROM unit q CROSS JOIN unit a WHERE q.idx = 0), prof AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, anchor_id) AS INTEGER) AS rk FROM one)"


def _histogram(source: str, key: str, x: str, lo: float, hi: float, bins: int) -> str:
    k, width = (f"{key}, " if key else ""), f"((CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE)) / {bins})"
    grid = f"(SELECT DISTINCT {key} FROM {source}) CROSS JOIN " if key else ""
    return f"""counted AS (SELECT {k}CASE WHEN {x} = {hi} THEN {bins - 1} ELSE CAST(floor(({x} - {lo}) / {width}) AS INTEGER) END AS bin, count(*) AS n FROM {source} WHERE {x} >= {lo} AND {x} <= {hi} GROUP BY ALL)
SELECT {'g.' + k if key else ''}g.bin, round({lo} + g.bin * {width}, 9) AS lo, round({lo} + (g.bin + 1) * {width}, 9) AS hi, coalesce(n, 0) AS n
FROM (SELECT {k}CAST(range AS INTEGER) AS bin FROM {grid}range({bins})) g LEFT JOIN counted c ON c.bin = g.bin{f' AND c.{key} IS NOT DISTINCT FROM g.{key}' if key else ''}"""


def _spread(cells: str) -> str:
    return f"WITH {_TOKENS} {cells}"


ORACLE = {
    "rr_recall_rollup": f"{_MAIN}, {_scored()} {_recall()}",
    "rr_topk_image": f"{_MAIN} SELECT id, anchor_id, s, rk FROM images WHERE rk <= 20",
    "rr_topk_text": f"{_MAIN} SELECT id, anchor_id, s, rk FROM texts WHERE rk <= 20",
    "rr_topk_plan": f"{_MAIN} SELECT id, anchor_id, s, rk FROM images WHERE rk <= 20",
    "rr_weights_none": f"{_MAIN}, {_weighted('w', 'images', 'greatest(s, CAST(0.3 AS DOUBLE))', norm=False)} SELECT id, anchor_id, round(w, 9) AS w FROM w",
    "rr_weights_norm": f"{_MAIN}, {_weighted('w', 'images', 's')} SELECT id, anchor_id, round(w, 9) AS w FROM w",
    "rr_weights_asif": f"{_MAIN}, {_weighted('w', 'images', 'pow(s, 4)')} SELECT id, anchor_id, round(w, 9) AS w FROM w",
    "rr_scores_sparse": f"{_MAIN}, {_scored()} SELECT * FROM scored",
    "rr_scores_zero_filled": f"{_MAIN}, {_scored()} SELECT caption_id, image_idx, score FROM grid",
    "rr_rank_gt": f"{_MAIN}, {_scored()} SELECT caption_id, image_idx AS gt, language, rank FROM ranks",
    "rr_rank_gt_signed": f"{_MAIN}, {_scored('pow(s, 3)')} SELECT caption_id, image_idx AS gt, language, rank FROM ranks",
    "rr_top_images": f"{_MAIN}, {_scored()} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY caption_id ORDER BY score DESC, image_idx) AS INTEGER) AS rank FROM scored) WHERE rank <= 10",
    "rr_selected_queries": f"{_MAIN}, {_scored()} {_recall('(SELECT * FROM ranks WHERE language IN (' + chr(39) + (chr(39) + ', ' + chr(39)).join('1357') + chr(39) + '))')}",
    "posting_index_stats": f"{_MAIN}, c AS (SELECT anchor_id, count(*) AS n FROM images WHERE rk <= 20 GROUP BY anchor_id) SELECT anchor_id, n, CAST(coalesce(sum(n) OVER (ORDER BY anchor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c",
    "dense_recall_mrr": f"WITH {_DENSE} {_recall(mrr=True)}",
    "dense_topk": f"WITH {_DENSE} SELECT id, anchor_id, s, rk FROM best WHERE rk <= 10",
    "l2_normalize": f"{_MAIN}, x AS (SELECT idx, unnest(iv) AS x, CAST(generate_subscripts(iv, 1) - 1 AS INTEGER) AS at FROM unit) SELECT idx, at, round(x, 9) AS x FROM x",
    "l2_normalize_additive": f"{_MAIN}, n AS (SELECT idx, list_transform(t0, lambda x: x / (sqrt(list_dot_product(t0, t0)) + 1e-12)) AS v FROM views), x AS (SELECT idx, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS at FROM n) SELECT idx, at, round(x, 9) AS x FROM x",
    "cosine_pairs": f"{_MAIN} SELECT idx, round(list_dot_product(iv, tv), 9) AS cosine FROM unit",
    "single_query_topk": f"{_PROFILE} SELECT anchor_id, s, rk FROM prof WHERE rk <= 100",
    "similarity_histogram": f"{_PROFILE}, {_histogram('prof', '', 's', -0.2, 1.0, 80)}",
    "similarity_means_topk": f"{_PROFILE} SELECT round(avg(s), 9) AS mean_all, round(avg(s) FILTER (rk <= 100), 9) AS mean_top FROM prof",
    "top_captions": f"""{_PROFILE}, {_CAPS}, f AS (SELECT image_idx, min(caption_id) AS caption_id FROM caps GROUP BY image_idx)
SELECT rk, f.image_idx, f.caption_id, printf('%.6f', s) AS similarity, trim(replace(caption, E'\\n', ' ')) AS caption, CASE WHEN length(caption) > 120 THEN left(caption, 117) || '...' ELSE caption END AS title
FROM prof JOIN f ON f.image_idx = anchor_id JOIN caps c ON c.caption_id = f.caption_id WHERE rk <= 100""",
    "select_languages": f"WITH {_CAPS} SELECT caption_id, image_idx AS gt, language FROM caps WHERE language IN ('de', 'fr')",
    "select_first_per_image_lang": f"WITH {_CAPS} SELECT min(caption_id) AS caption_id, image_idx AS gt, language FROM caps GROUP BY image_idx, language",
    "select_max_queries": f"WITH {_CAPS} SELECT min(caption_id) AS caption_id, image_idx AS gt, language FROM caps WHERE language IN ('en', 'es') GROUP BY image_idx, language ORDER BY 1 LIMIT 100",
    "preferred_caption": f"WITH {_CAPS} SELECT doc_id AS image_idx, coalesce(min(caption_id) FILTER (language = 'fr'), min(caption_id)) AS caption_id FROM documents LEFT JOIN caps ON image_idx = doc_id GROUP BY doc_id",
    "first_caption_per_image": f"WITH {_CAPS} SELECT doc_id AS image_idx, coalesce(min(caption_id), -1) AS caption_id FROM documents LEFT JOIN caps ON image_idx = doc_id GROUP BY doc_id",
    "captions_by_image": f"WITH {_CAPS} SELECT image_idx, string_agg(CAST(caption_id AS VARCHAR), ',' ORDER BY caption_id) AS caption_ids FROM caps GROUP BY image_idx",
    "null_language_literal": f"WITH {_CAPS} SELECT CASE WHEN language = 'es' THEN 'None' ELSE language END AS language, count(*) AS n FROM caps GROUP BY 1",
    "caption_index_build": f"WITH {_CAPS} SELECT caption_id, CAST(dense_rank() OVER (ORDER BY image_idx) - 1 AS BIGINT) AS image_idx, CAST(image_idx AS VARCHAR) AS image_id, language, caption FROM caps",
    "image_index_build": f"WITH {_CAPS} SELECT CAST(row_number() OVER (ORDER BY image_idx) - 1 AS BIGINT) AS image_idx, CAST(image_idx AS VARCHAR) AS image_id, image_idx || '.jpg' AS image_relpath, any_value(language) AS languages, count(*) AS n_captions FROM caps GROUP BY caps.image_idx",
    "samples_index": "SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS sample_id, conv_id || '-' || turn AS key, text AS caption, 'en' AS language FROM conversations WHERE trim(text) <> ''",
    "bank_view_captions": "WITH s AS (SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS n, CAST(item_id AS VARCHAR) AS image_id, text FROM benchmark WHERE trim(text) <> '') SELECT n AS caption_id, n AS image_idx, image_id, 'en' AS language, text AS caption FROM s",
    "normalized_fields": "SELECT doc_id AS image_idx, lang AS language, text AS caption FROM documents",
    "index_dataset_counts": f"WITH {_CAPS}, p AS (SELECT language, count(*) AS n FROM caps GROUP BY language) SELECT (SELECT count(DISTINCT image_idx) FROM caps) AS n_images, (SELECT count(*) FROM caps) AS n_captions, (SELECT string_agg(language, ',' ORDER BY language) FROM p) AS languages, language, n FROM p",
    "language_map_fallback": "SELECT DISTINCT lang AS language, CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE 'eng_Latn' END AS code, lang NOT IN ('en', 'de', 'fr') AS is_fallback FROM documents",
    "translated_records": f"""WITH {_CAPS} SELECT CAST(image_idx AS VARCHAR) AS image_id, language, string_agg(caption, E'\\n' ORDER BY caption_id) AS source_caption, string_agg('nmt:' || caption, E'\\n' ORDER BY caption_id) AS translation_nmt,
coalesce(string_agg(CASE language WHEN 'es' THEN NULL WHEN 'en' THEN caption ELSE 'en:' || caption END, E'\\n' ORDER BY caption_id), '') AS translation_tllm FROM caps GROUP BY image_idx, language""",
    "resume_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "alignment_check": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id AS left_key, b.doc_id AS right_key FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS DISTINCT FROM b.doc_id",
    "fingerprints": "SELECT c_nationkey AS nation, sha1(string_agg(c_name, ',' ORDER BY c_name) || E'\\n') AS sha1 FROM customer GROUP BY c_nationkey",
    "file_names": f"SELECT page_id, {_SAFE.format(c='url')} AS name FROM pages",
    "quantile_bands": "SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 9) AS mean, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.75) AS q75, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY ALL",
    "best_over_p_k": "SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, max(l_extendedprice) AS best FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus, l_suppkey))",
    "argmax_config": f"WITH {_LI} SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM li QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, row_id) = 1",
    "lang_best_config": f"""WITH {_LI}, c AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS m, min(row_id) AS first FROM li GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY m DESC, first) = 1)
SELECT l_returnflag, l_linestatus AS language, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM li JOIN b USING (l_returnflag, l_linenumber) GROUP BY ALL""",
    "pivot_pair_k": "SELECT l_returnflag, " + ", ".join(f"max(l_extendedprice) FILTER (l_linenumber = {i}) AS k{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY l_returnflag",
    "dedupe_first": f"WITH {_LI} SELECT l_orderkey, l_linenumber, l_partkey FROM li QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY row_id) = 1",
    "non_dominated_front": "WITH p AS (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS y, max(CAST(o_custkey AS DOUBLE)) OVER (ORDER BY o_totalprice DESC, o_custkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders) SELECT o_orderkey, o_totalprice, y FROM p WHERE best IS NULL OR y > best + 1e-12",
    "event_histogram": f"WITH {_histogram('events', 'event_type', 'value', 0, 100, 20)}",
    "status_tallies": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "mean_std": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), CASE WHEN count(c_acctbal) = 1 THEN 0 END), 6) AS std FROM customer GROUP BY ALL",
    "coerced_numbers": "SELECT conv_id, turn, try_cast(role AS DOUBLE) AS from_role, try_cast(CAST(turn AS VARCHAR) AS DOUBLE) AS from_turn FROM conversations",
    "inferred_model_types": "SELECT page_id, CASE WHEN url LIKE '%#top%' THEN 'other' WHEN url LIKE '%/en/%' OR lower(url) LIKE '%clip%' AND url NOT LIKE '%/de/%' THEN 'clip_dense_retrieval_baseline' WHEN url LIKE '%/de/%' OR lower(url) LIKE '%qwen%' THEN 'multimodal_multilingual_embedding_baseline' ELSE '' END AS model_type FROM pages",
    "sweep_grid_kp": f"{_MAIN}, {_SWEEP} {_recall(keys='k, p, ')}",
    "first_n_ablation": f"{_subsets(_FIRST_N)} {_recall(keys='subset_id, ')}",
    "random_subset_ids": f"{_MAIN} SELECT idx AS anchor_id FROM unit ORDER BY md5(idx || ':7'), idx LIMIT 50",
    "random_ablation_runs": f"{_subsets(_RANDOM)} {_recall(keys='subset_id, ')}",
    "random_ablation_mean_std": f"""{_subsets(_RANDOM)}, o AS (SELECT subset_id, {_rates()} FROM ranks GROUP BY subset_id), s AS (SELECT CAST(split_part(subset_id, '-', 1) AS DOUBLE) AS pct, * FROM o)
SELECT pct AS percentage, {_COUNT} AS anchor_n, count(*) AS executed_runs, count(*) AS ok_runs, CAST(0 AS BIGINT) AS failed_runs, CASE WHEN pct = 100 AND count(*) = 1 THEN 'deterministic: run once' ELSE '' END AS note, """
    + ", ".join(f"round(avg(r_at_{k}), 6) AS mean_r_at_{k}, round(coalesce(stddev_samp(r_at_{k}), 0), 6) AS std_r_at_{k}" for k in (1, 5, 10)) + " FROM s GROUP BY pct",
    "pct_to_anchor_n": "SELECT o_orderkey, CASE WHEN pct = floor(pct) THEN CAST(CAST(pct AS INTEGER) AS VARCHAR) ELSE replace(CAST(pct AS VARCHAR), '.', 'p') END AS label, CAST(greatest(2, round_even(CAST(o_custkey AS DOUBLE) * (pct / CAST(100 AS DOUBLE)), 0)) AS BIGINT) AS anchor_n FROM orders CROSS JOIN (SELECT CAST(x AS DOUBLE) AS pct FROM (VALUES (0.25), (0.35), (0.75), (2.5), (50), (100)) v(x))",
    "rr_summary_wide": f"""{_MAIN}, {_SWEEP} SELECT 'runs/k' || k || '-p' || p AS run_dir, 'k' || k || '-p' || p AS run_name, 'ok' AS status, CAST(k AS VARCHAR) AS k, CAST(p AS VARCHAR) AS p, 'asif' AS proc, {', '.join(f'round(CAST(count(*) FILTER (rank <= {x}) AS DOUBLE) / count(*), 9) AS overall_r_at_{x}' for x in (1, 5, 10))}, count(*) AS n_queries FROM ranks GROUP BY k, p
UNION ALL SELECT 'runs/lost', 'lost', 'missing', '7', '1', 'norm', NULL, NULL, NULL, NULL""",
    "rr_per_language_long": f"{_MAIN}, {_SWEEP} SELECT 'runs/k' || k || '-p' || p AS run_dir, 'k' || k || '-p' || p AS run_name, CAST(k AS VARCHAR) AS k, CAST(p AS VARCHAR) AS p, 'asif' AS proc, language, {_rates().partition(', ')[2]} FROM ranks GROUP BY ranks.k, ranks.p, language",
    "baseline_rows": f"WITH {_DENSE} SELECT 'dense' AS run_name, 'ok' AS status, language, {_rates(mrr=True)} FROM ranks GROUP BY language",
    "letterfreq_embed": f"WITH l AS (SELECT doc_id, {_LETTERS} AS v FROM documents) SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS at, CAST(unnest(v) AS BIGINT) AS n FROM l",
    "masked_mean_pool": _spread("SELECT conv_id, at, round(sum(x * m) / greatest(sum(m), 1e-6), 6) AS x FROM cells GROUP BY conv_id, at"),
    "last_token_pool": _spread("SELECT conv_id, at, round(arg_max(x, CASE WHEN m = 1 THEN turn ELSE -1e9 - turn END), 6) AS x FROM cells GROUP BY conv_id, at"),
    "cls_pool": _spread("SELECT conv_id, at, round(arg_min(x, turn), 6) AS x FROM cells GROUP BY conv_id, at"),
    "rr_from_documents": f"""WITH d AS (SELECT doc_id AS id, {_LETTERS} AS v FROM documents), b AS (SELECT item_id AS anchor_id, {_LETTERS} AS v FROM benchmark),
du AS (SELECT id, {_UNIT.format(v='v')} AS v FROM d), bu AS (SELECT anchor_id, {_UNIT.format(v='v')} AS v FROM b),
s AS (SELECT id, anchor_id, round(list_dot_product(du.v, bu.v), 9) AS s FROM du CROSS JOIN bu),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, anchor_id) AS INTEGER) AS rk FROM s),
w AS (SELECT id, anchor_id, rk, pow(s, 4) AS v FROM t WHERE rk <= 5)
SELECT id, anchor_id, rk, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12), 6) AS w FROM w""",
}

ORACLE |= {
    "jsonl_captions": ORACLE["caption_index_build"],
    "jsonl_value_kinds": "SELECT CAST(doc_id AS VARCHAR) AS image_id, language, '[x] {y} ' || lang AS caption FROM documents CROSS JOIN (VALUES ('a'), ('b'), ('e')) v(language)",
    "tar_pairs": "SELECT printf('%08d-%04d', conv_id, turn) AS key, (conv_id % 7) || '.tar' AS shard, text AS caption, 'en' AS language, role FROM conversations WHERE trim(text) <> ''",
    "run_folders": "SELECT * EXCLUDE (run_dir) FROM (" + ORACLE["rr_summary_wide"] + ") UNION ALL SELECT 'broken', 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    "report_csv": "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier",
    "anchor_list": "SELECT n AS anchor_id FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) WHERE n % 3 <> 1",
    "subset_retrieval": f"{_subsets('subs AS (SELECT 1 AS subset_id, idx AS anchor_id FROM unit WHERE idx % 3 <> 1)')} {_recall()}",
    "subset_checks": "SELECT CAST(0 AS BIGINT) AS empty, CAST(1 AS BIGINT) AS negative, CAST(1 AS BIGINT) AS repeated, CAST(2 AS BIGINT) AS unknown",
    "random_query": f"{_MAIN} SELECT idx AS anchor_id FROM unit ORDER BY md5(idx || ':11'), idx LIMIT 1",
    "stored_anchors": f"{_MAIN} SELECT idx AS anchor_id, round(list_dot_product(iv, tv), 9) AS cosine FROM unit WHERE idx % 7 <> 0 AND idx < 900",
    "stored_vectors": f"{_MAIN} SELECT idx AS id, unnest(t0) AS x, CAST(generate_subscripts(t0, 1) - 1 AS INTEGER) AS at FROM views WHERE idx % 7 <> 0",
    "stored_evaluation": f"{_MAIN} SELECT idx AS caption_id, idx + 5 AS image_idx, language, round(list_dot_product(iv, tv), 9) AS cosine FROM unit",
    "bank_from_samples": "WITH s AS (SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS n, CAST(item_id AS VARCHAR) AS key, text FROM benchmark WHERE trim(text) <> '') SELECT n AS caption_id, n AS image_idx, key AS at_id, 'en' AS language, text AS caption FROM s",
    "catalog_tables": "SELECT n_nationkey, 1 AS made FROM nation",
    "image_files": "SELECT page_id AS image_idx, CASE page_id % 4 WHEN 0 THEN '/root/a/p' || page_id || '.jpg' WHEN 1 THEN '/root/a/p' || page_id || '.png' WHEN 2 THEN '/root/p' || page_id || '.webp' END AS path FROM pages",
    "report_order": "SELECT p_partkey, nullif(p_size, 7) AS size, row_number() OVER (ORDER BY nullif(p_size, 7) NULLS LAST, p_retailprice, p_partkey) - 1 AS place FROM part",
    "union_of_lists": "SELECT id, count(*) AS n FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT page_id FROM pages) GROUP BY id",
    "last_token_pool_right": _spread("SELECT conv_id, at, round(max(x) FILTER (nth = place), 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, at ORDER BY turn) AS nth, greatest(1, sum(m) OVER (PARTITION BY conv_id, at)) AS place FROM cells) GROUP BY conv_id, at"),
    "model_inputs": "SELECT conv_id, turn, 'Describe.' AS instruction, 1 AS parts, CASE WHEN turn % 3 <> 0 THEN trim(text) ELSE '' END AS text FROM conversations",
    "column_choice": "SELECT o_orderkey, o_totalprice AS value FROM orders",
    "appended_translations": f"WITH {_CAPS} SELECT caption_id, image_idx, language, CASE language WHEN 'es' THEN NULL WHEN 'en' THEN caption ELSE 'en:' || caption END AS translation FROM caps",
    "encoded_by_language": "SELECT doc_id, length(text) AS n_chars, length(lang) AS n_language FROM documents",
}

# The column name "at" is a keyword of the dialect.
ORACLE = {name: re.sub(r"\bat\b", '"at"', sql) for name, sql in ORACLE.items()}
