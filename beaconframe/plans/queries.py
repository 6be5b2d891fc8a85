"""The library's queries on the synthetic tables, each over its whole tables.

Every vector is an item and an anchor: its components 1 to 48 are its image view, 17 to 64
its text view, and its label is the language.  An item's own anchor doesn't count.  The
lines of a document are the captions of an image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconframe.functions import vectors
from beaconframe.functions.ids import dense_ids
from beaconframe.functions.names import file_safe, first_present, flat_list, infer_model_type, numeric, one_line, percent_label, percent_to_count, short_title
from beaconframe.functions.scratch import materialize, scratch_path
from beaconframe.operators import analysis, evaluate, relrep, select, topk
from beaconframe.sources import captions as cap
from beaconframe.sources import loaders, shards

from . import catalog, encoders, retrieve, translate

K, P, KS = 20, 4, (1, 5, 10)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config(**options) -> retrieve.RetrievalConfig:
    return retrieve.RetrievalConfig(**({"k": K, "p": P, "ks": KS, "anchor_n": None} | options))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ids are given once; the parts of a plan all read the numbered table.
    numbered = materialize(dense_ids(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "idx", "vec_id"), "items")
    e = numbered.withColumn("e", vectors.doubles("embedding"))
    return e.select("idx", F.col("label").cast("string").alias("language"), "e", F.slice("e", 1, 48).alias("iv"), F.slice("e", 17, 48).alias("tv"))


def evaluation(spark: SparkSession, sf_dir: str) -> retrieve.EvaluationSet:
    rows = items(spark, sf_dir)
    return retrieve.EvaluationSet(
        captions=rows.select(F.col("idx").alias("caption_id"), F.col("idx").alias("image_idx"), "language", F.col("tv").alias("vec")),
        images=rows.select(F.col("idx").alias("image_idx"), F.col("iv").alias("vec")),
        anchors=rows.select(F.col("idx").alias("anchor_id"), F.col("iv").alias("img_vec"), F.col("tv").alias("txt_vec")),
        leave_one_out=True,
    )


def caption_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_idx"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("at", "caption"))
    return dense_ids(lines.where(F.trim("caption") != ""), "caption_id", "image_idx", "at").select("caption_id", "image_idx", "language", "caption")


def image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_idx"))


# --- retrieval ------------------------------------------------------------------------------


@query
def rr_recall_rollup(spark, sf_dir):
    return retrieve.retrieve(evaluation(spark, sf_dir), config())


@query
def rr_topk_image(spark, sf_dir):
    return retrieve.image_neighbours(evaluation(spark, sf_dir), config())


@query
def rr_topk_text(spark, sf_dir):
    return retrieve.caption_neighbours(evaluation(spark, sf_dir), config())


@query
def rr_topk_plan(spark, sf_dir):
    return retrieve.image_neighbours(evaluation(spark, sf_dir), config(method="plan"))


def _weights(spark, sf_dir, **how):
    found = retrieve.image_neighbours(evaluation(spark, sf_dir), config())
    return relrep.weights(found, **how).select("id", "anchor_id", F.round("w", 9).alias("w"))


@query
def rr_weights_none(spark, sf_dir):
    return _weights(spark, sf_dir, proc="none", clamp_min=0.3)


@query
def rr_weights_norm(spark, sf_dir):
    return _weights(spark, sf_dir, proc="norm")


@query
def rr_weights_asif(spark, sf_dir):
    return _weights(spark, sf_dir, proc="asif", p=P)


def _represented(data, c):
    how = {"proc": c.proc, "p": c.p}
    return relrep.weights(retrieve.caption_neighbours(data, c), **how), relrep.weights(retrieve.image_neighbours(data, c), **how)


def _scores(data, c):
    return relrep.scores(*_represented(data, c))


@query
def rr_scores_sparse(spark, sf_dir):
    return _scores(evaluation(spark, sf_dir), config())


@query
def rr_scores_zero_filled(spark, sf_dir):
    data = evaluation(spark, sf_dir)
    return relrep.dense_scores(*_represented(data, config()), data.captions, data.images)


@query
def rr_rank_gt(spark, sf_dir):
    return retrieve.ranks(evaluation(spark, sf_dir), config())


@query
def rr_rank_gt_signed(spark, sf_dir):
    """Unprocessed similarities can be negative, and so can scores."""
    return retrieve.ranks(evaluation(spark, sf_dir), config(proc="asif", p=3, clamp_min=None))


@query
def rr_top_images(spark, sf_dir):
    found = _scores(evaluation(spark, sf_dir), config())
    return topk.ranked(found, 10, group="caption_id", item="image_idx", score="score", rank="rank")


@query
def rr_selected_queries(spark, sf_dir):
    return retrieve.retrieve(evaluation(spark, sf_dir), config(languages=("1", "3", "5", "7")))


@query
def posting_index_stats(spark, sf_dir):
    return relrep.posting_counts(retrieve.image_neighbours(evaluation(spark, sf_dir), config()))


def _dense(spark, sf_dir):
    rows = items(spark, sf_dir)
    zero = lambda v, a, b: F.concat(F.array_repeat(F.lit(0.0), a), v, F.array_repeat(F.lit(0.0), b))
    return retrieve.EvaluationSet(
        captions=rows.select(F.col("idx").alias("caption_id"), F.col("idx").alias("image_idx"), "language", zero(F.col("tv"), 16, 0).alias("vec")),
        images=rows.select(F.col("idx").alias("image_idx"), zero(F.col("iv"), 0, 16).alias("vec")),
        anchors=rows,
    )


@query
def dense_recall_mrr(spark, sf_dir):
    return retrieve.retrieve_dense(_dense(spark, sf_dir), config())


@query
def dense_topk(spark, sf_dir):
    data = _dense(spark, sf_dir)
    unit = lambda df, c, n: df.select(F.col(c).alias(n), vectors.l2_normalize("vec").alias("vec"))
    return topk.top_k(unit(data.captions, "caption_id", "id"), unit(data.images, "image_idx", "anchor_id"), 10)


@query
def l2_normalize(spark, sf_dir):
    return items(spark, sf_dir).select("idx", F.posexplode(vectors.l2_normalize("iv")).alias("at", "x")).select("idx", "at", F.round("x", 9).alias("x"))


@query
def l2_normalize_additive(spark, sf_dir):
    return items(spark, sf_dir).select("idx", F.posexplode(vectors.l2_normalize_additive("tv")).alias("at", "x")).select("idx", "at", F.round("x", 9).alias("x"))


@query
def cosine_pairs(spark, sf_dir):
    """The cosine of each item's two views."""
    return items(spark, sf_dir).select("idx", F.round(vectors.dot(vectors.l2_normalize("iv"), vectors.l2_normalize("tv")), 9).alias("cosine"))


def _profile(spark, sf_dir):
    return retrieve.similarity_profile(evaluation(spark, sf_dir), 0, top=100)


@query
def single_query_topk(spark, sf_dir):
    return _profile(spark, sf_dir)[2].select("anchor_id", "s", "rk")


@query
def similarity_histogram(spark, sf_dir):
    return _profile(spark, sf_dir)[0].select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@query
def similarity_means_topk(spark, sf_dir):
    return _profile(spark, sf_dir)[1].select(F.round("mean_all", 9).alias("mean_all"), F.round("mean_top", 9).alias("mean_top"))


@query
def top_captions(spark, sf_dir):
    """The first captions of the best anchors, as a report has them."""
    best = _profile(spark, sf_dir)[2]
    first = select.first_caption(caption_table(spark, sf_dir), image_table(spark, sf_dir)).where("caption_id >= 0")
    texts = caption_table(spark, sf_dir).select("caption_id", "caption")
    joined = best.join(first, best["anchor_id"] == first["image_idx"]).join(texts, "caption_id")
    return joined.select("rk", "image_idx", "caption_id", F.format_string("%.6f", "s").alias("similarity"), one_line("caption").alias("caption"), short_title("caption").alias("title"))


# --- selection and captions -----------------------------------------------------------------


@query
def select_languages(spark, sf_dir):
    return select.select_queries(caption_table(spark, sf_dir), languages=["de", "fr"])


@query
def select_first_per_image_lang(spark, sf_dir):
    return select.select_queries(caption_table(spark, sf_dir), first_per_image_language=True)


@query
def select_max_queries(spark, sf_dir):
    return select.select_queries(caption_table(spark, sf_dir), languages=["en", "es"], first_per_image_language=True, max_queries=100)


@query
def preferred_caption(spark, sf_dir):
    return select.preferred_caption(caption_table(spark, sf_dir), image_table(spark, sf_dir), "fr")


@query
def first_caption_per_image(spark, sf_dir):
    return select.first_caption(caption_table(spark, sf_dir), image_table(spark, sf_dir))


@query
def captions_by_image(spark, sf_dir):
    lists = select.captions_by_image(caption_table(spark, sf_dir))
    return lists.select("image_idx", F.array_join(F.transform("caption_ids", lambda x: x.cast("string")), ",").alias("caption_ids"))


@query
def null_language_literal(spark, sf_dir):
    some = caption_table(spark, sf_dir).withColumn("language", F.nullif("language", F.lit("es")))
    return select.select_queries(some).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def _record_lines(spark, sf_dir):
    """Documents as caption records, one JSON object each."""
    d = table(spark, sf_dir, "documents")
    head = F.to_json(F.struct(F.col("doc_id").cast("string").alias("image/key"), F.lit("x").alias("image/source")))
    body = F.to_json(F.create_map("lang", F.struct(F.split("text", "\n").alias("caption"))))
    return d.withColumn("h", head).withColumn("b", body).select(F.col("doc_id").alias("line_no"), F.expr("concat(left(h, length(h) - 1), ',', substring(b, 2))").alias("value"))


@query
def caption_index_build(spark, sf_dir):
    return cap.build_captions(cap.build_images(cap.parse_records(_record_lines(spark, sf_dir), drop_blank=True)))


@query
def image_index_build(spark, sf_dir):
    images = cap.build_images(cap.parse_records(_record_lines(spark, sf_dir), drop_blank=True))
    return images.select("image_idx", "image_id", "image_relpath", F.array_join("languages", ",").alias("languages"), F.aggregate(F.map_values("num_captions_per_lang"), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_captions"))


@query
def samples_index(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("caption"), F.lit("en").alias("language"))
    return cap.build_samples(pairs, "conv_id", "turn").select("sample_id", "key", "caption", "language")


@query
def bank_view_captions(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("key"), F.col("text").alias("caption"), F.lit("en").alias("language"))
    return cap.bank_view(cap.build_samples(pairs, "item_id"))[1]


@query
def normalized_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    renamed = d.select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    images = d.select(F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").alias("image_idx"))
    return cap.normalize_fields(renamed, images).select("image_idx", "language", "caption")


@query
def index_dataset_counts(spark, sf_dir):
    counts = cap.dataset_counts(caption_table(spark, sf_dir))
    return counts.select("n_images", "n_captions", F.array_join("languages", ",").alias("languages"), F.explode("num_captions_per_lang").alias("language", "n"))


@query
def language_map_fallback(spark, sf_dir):
    mapping = spark.createDataFrame([("en", 0, "eng_Latn"), ("de", 0, "deu_Latn"), ("fr", 0, "fra_Xxxx"), ("fr", 1, "fra_Latn")], "language string, priority int, code string")
    available = spark.createDataFrame([("eng_Latn",), ("deu_Latn",), ("fra_Latn",)], "code string")
    return cap.map_languages(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")).distinct(), mapping, available)


def _client():
    def call(texts, source, target):
        if source == "es":
            raise translate.Rejected(source)
        return [f"{target}:{x}" for x in texts]

    return call


@query
def translated_records(spark, sf_dir):
    rows = caption_table(spark, sf_dir).withColumn("image_id", F.col("image_idx").cast("string"))
    both = translate.translate(rows.withColumn("translation_nmt", F.concat(F.lit("nmt:"), "caption")), _client, out="translation_tllm")
    records = translate.translated_records(both, ["translation_nmt", "translation_tllm"]).select("image_id", F.explode("languages").alias("language", "x"))
    return records.select("image_id", "language", *(F.array_join(f"x.{c}", "\n").alias(c) for c in ("source_caption", "translation_nmt", "translation_tllm")))


@query
def resume_antijoin(spark, sf_dir):
    return select.resume(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query
def alignment_check(spark, sf_dir):
    named = lambda t: table(spark, sf_dir, t).select("doc_id", F.col("doc_id").alias("key"))
    return select.misaligned(named("documents"), named("labels"), "doc_id", "key")


@query
def fingerprints(spark, sf_dir):
    """Digests of files: each shard of the customers as text, named by its nation."""
    path = scratch_path(spark, "files")
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("value"))
    lines.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = shards.content_fingerprints(spark, path)
    return found.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "sha1")


@query
def file_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", file_safe("url").alias("name"))


# --- analysis -------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query
def quantile_bands(spark, sf_dir):
    return analysis.quantile_bands(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity").withColumn("mean", F.round("mean", 9))


@query
def best_over_p_k(spark, sf_dir):
    return analysis.best_over(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_linenumber", "l_suppkey", "l_extendedprice")


@query
def argmax_config(spark, sf_dir):
    return analysis.argmax(_lines(spark, sf_dir), ["l_suppkey", "l_returnflag"], "l_extendedprice", "row_id").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def lang_best_config(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("language", F.col("l_linestatus"))
    best = analysis.best_config_by_language(rows, ["l_returnflag"], ["l_linenumber"], "l_quantity", ["l_discount"], "row_id")
    return best.select("l_returnflag", "language", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query
def pivot_pair_k(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("k", F.concat(F.lit("k"), "l_linenumber"))
    return analysis.pivot_best(rows, "l_returnflag", "k", [f"k{i}" for i in range(1, 8)], "l_extendedprice")


@query
def dedupe_first(spark, sf_dir):
    """Rows of the same order and number are told apart by their place in the table's files."""
    placed = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "row_id", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return analysis.drop_duplicates_keep_first(placed, ["l_orderkey"], "row_id", "_file", "_at").select("l_orderkey", "l_linenumber", "l_partkey")


@query
def non_dominated_front(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") * 1.0).alias("y"))
    return analysis.non_dominated(points, "o_totalprice", "y")


@query
def event_histogram(spark, sf_dir):
    return analysis.histogram(table(spark, sf_dir, "events"), "value", lo=0, hi=100, bins=20, keys=("event_type",)).select("event_type", "bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@query
def status_tallies(spark, sf_dir):
    return analysis.status_tallies(table(spark, sf_dir, "events"), "event_type")


@query
def mean_std(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(analysis.sample_std(F.col("c_acctbal")), 6).alias("std"))


@query
def coerced_numbers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", numeric("role").alias("from_role"), numeric(F.col("turn").cast("string")).alias("from_turn"))


@query
def inferred_model_types(spark, sf_dir):
    runs = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").contains("/en/"), F.concat(F.lit("run-CLIP-"), "page_id")).when(F.col("url").contains("/de/"), F.concat(F.lit("qwen-"), "page_id")).otherwise(F.col("url")).alias("run_name"), F.when(F.col("url").contains("#top"), F.lit("other")).otherwise("").alias("model_type"))
    return runs.select("page_id", infer_model_type(F.col("run_name"), F.col("model_type")).alias("model_type"))


# --- sweeps and ablations ---------------------------------------------------------------------


def _grid(spark):
    return spark.createDataFrame([(k, p) for k in (5, 10, 20) for p in (2, 4)], "k int, p int")


@query
def sweep_grid_kp(spark, sf_dir):
    return retrieve.sweep(evaluation(spark, sf_dir), config(), _grid(spark))


def _percentages(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "percentage double")


def _ids(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("idx").alias("anchor_id"))


@query
def first_n_ablation(spark, sf_dir):
    data = evaluation(spark, sf_dir)
    subsets = retrieve.first_n_subsets(data.anchors, _percentages(spark, 100, 75, 50), table(spark, sf_dir, "embeddings").count(), K)
    return retrieve.subset_ablation(data, config(), subsets.select(percent_label("percentage").alias("subset_id"), "anchor_id"))


@query
def random_subset_ids(spark, sf_dir):
    return select.random_subset(_ids(spark, sf_dir), 50, 7)


@query
def random_ablation_runs(spark, sf_dir):
    """Recall of each run of a random-subset ablation."""
    data = evaluation(spark, sf_dir)
    runs = retrieve.random_grid(_percentages(spark, 100, 60, 40), 3)
    subsets = retrieve.random_subsets(_ids(spark, sf_dir), runs, table(spark, sf_dir, "embeddings").count(), K)
    named = subsets.select(F.concat_ws("-", percent_label("percentage"), F.col("seed").cast("string")).alias("subset_id"), "anchor_id")
    return retrieve.subset_ablation(data, config(), named)


@query
def random_ablation_mean_std(spark, sf_dir):
    overall = random_ablation_runs(spark, sf_dir).where(F.col("language") == evaluate.OVERALL)
    parts = F.split("subset_id", "-")
    size = table(spark, sf_dir, "embeddings").count()
    runs = overall.select(
        parts[0].cast("double").alias("percentage"), parts[1].cast("int").alias("repeat_idx"), parts[1].cast("int").alias("seed"), F.lit("ok").alias("status"), percent_to_count(F.lit(size), parts[0].cast("double"), K).alias("anchor_n"), "r_at_1", "r_at_5", "r_at_10"
    )
    out = analysis.aggregate_runs(runs, ["r_at_1", "r_at_5", "r_at_10"], requested=3)
    return out.select("percentage", "anchor_n", "executed_runs", "ok_runs", "failed_runs", "note", *(F.round(f"{a}_r_at_{k}", 6).alias(f"{a}_r_at_{k}") for a in ("mean", "std") for k in KS))


@query
def pct_to_anchor_n(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("base"))
    pct = _percentages(spark, 0.25, 0.35, 0.75, 2.5, 50, 100)
    return base.crossJoin(pct).select("o_orderkey", percent_label("percentage").alias("label"), percent_to_count(F.col("base"), F.col("percentage"), 2).alias("anchor_n"))


def _runs(spark, sf_dir):
    """The runs of the sweep as run folders with configuration and results, and one without results."""
    table_ = sweep_grid_kp(spark, sf_dir)
    rates = F.map_from_arrays(F.array(*(F.lit(f"R@{k}") for k in KS)), F.array(*(F.col(f"r_at_{k}") for k in KS)))
    rated = table_.select("k", "p", "language", "n", rates.alias("rates"))
    own = F.col("language") == evaluate.OVERALL
    runs = rated.groupBy("k", "p").agg(
        F.struct(
            F.any_value(F.when(own, F.col("rates")), F.lit(True)).alias("overall"), F.map_from_entries(F.collect_list(F.when(~own, F.struct("language", "rates")))).alias("per_language"), F.max(F.when(own, F.col("n"))).alias("n_queries"),
            F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("p"), F.col("p").cast("string"), F.lit("proc"), F.lit("asif")).alias("run_config"), F.lit("").alias("timestamp"),
        ).alias("results")
    )
    done = runs.select(F.format_string("runs/k%d-p%d", "k", "p").alias("run_dir"), F.when(F.col("k") > 5, F.col("results.run_config")).alias("config"), "results")
    lost = done.limit(1).select(F.lit("runs/lost").alias("run_dir"), F.create_map(F.lit("k"), F.lit("7"), F.lit("p"), F.lit("1"), F.lit("proc"), F.lit("norm")).alias("config"), F.lit(None).cast(done.schema["results"].dataType).alias("results"))
    return done.union(lost)


@query
def rr_summary_wide(spark, sf_dir):
    return analysis.summary_tables(_runs(spark, sf_dir), ["k", "p", "proc"], list(KS))[0]


@query
def rr_per_language_long(spark, sf_dir):
    return analysis.summary_tables(_runs(spark, sf_dir), ["k", "p", "proc"], list(KS))[1]


@query
def baseline_rows(spark, sf_dir):
    """The dense run as long rows, MRR included."""
    out = dense_recall_mrr(spark, sf_dir).where(F.col("language") != evaluate.OVERALL)
    return out.select(F.lit("dense").alias("run_name"), F.lit("ok").alias("status"), "language", "n", *(f"r_at_{k}" for k in KS), "mrr")


# --- encoders ---------------------------------------------------------------------------------


@query
def letterfreq_embed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(encoders.letter_frequencies("text")).alias("at", "n")).select("doc_id", "at", F.col("n").cast("long").alias("n"))


def _tokens(spark, sf_dir):
    """Each conversation as a sequence of vectors, its turns, with the user's turns unmasked."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", encoders.letter_frequencies("text").alias("h"), F.when(F.col("role") == "user", 1).otherwise(0).alias("m")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.transform("ts", lambda t: t["h"]).alias("h"), F.transform("ts", lambda t: t["m"]).alias("m"))


def _pooled(rows, pool):
    return rows.select("conv_id", F.posexplode(pool).alias("at", "x")).select("conv_id", "at", F.round("x", 6).alias("x"))


@query
def masked_mean_pool(spark, sf_dir):
    return _pooled(_tokens(spark, sf_dir), vectors.masked_mean_pool("h", "m"))


@query
def last_token_pool(spark, sf_dir):
    return _pooled(_tokens(spark, sf_dir), vectors.last_token_pool("h", "m"))


@query
def cls_pool(spark, sf_dir):
    return _pooled(_tokens(spark, sf_dir), vectors.cls_pool("h"))


@query
def rr_from_documents(spark, sf_dir):
    """From texts to representations: documents against the benchmark's passages as anchors."""
    def embedded(name: str, id_col: str, out: str) -> DataFrame:
        counted = materialize(table(spark, sf_dir, name).select(F.col(id_col).alias(out), encoders.letter_frequencies("text").alias("v")), "letters")
        return counted.select(out, vectors.l2_normalize("v").alias("vec"))

    docs, bank = embedded("documents", "doc_id", "id"), embedded("benchmark", "item_id", "anchor_id")
    return relrep.weights(topk.top_k(docs, bank, 5), proc="asif", p=P).select("id", "anchor_id", "rk", F.round("w", 6).alias("w"))


# --- files: what is written by a query is read again by the library's readers -------------------


@query
def jsonl_captions(spark, sf_dir):
    """Caption records as lines of several files, read in the order of files and lines."""
    path = scratch_path(spark, "records")
    _record_lines(spark, sf_dir).repartitionByRange(5, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return cap.build_captions(cap.build_images(cap.parse_records(cap.read_lines(spark, path), drop_blank=True)))


@query
def jsonl_value_kinds(spark, sf_dir):
    """Captions that look like lists or objects, lists with other elements, and keys that are no languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[x] {y} "), "lang").alias("t"), "n_chars")
    text, number = F.to_json(F.array("t")), F.col("n_chars").cast("string")
    one = F.expr("substring(to_json(array(t)), 2, length(to_json(array(t))) - 2)")
    value = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"image/x":{"caption":"no"},"a":{"caption":'), one, F.lit('},"b":{"captions":['), number, F.lit(","), one, F.lit(',null]},"c":{"caption":'), number, F.lit('},"d":"{no}","e":{"caption":"","captions":'), text, F.lit("}}"))
    records = cap.parse_records(docs.select(F.col("doc_id").alias("line_no"), value.alias("value")))
    return records.select("image_id", F.explode("entries").alias("e")).select("image_id", "e.language", F.explode("e.captions").alias("caption"))


@query
def tar_pairs(spark, sf_dir):
    """Conversations as tar shards with captions and metadata, read back."""
    turns = table(spark, sf_dir, "conversations").select(F.pmod("conv_id", F.lit(7)).alias("shard"), F.format_string("%08d-%04d", "conv_id", "turn").alias("key"), "text", "role")

    def packed(key, rows):
        import io
        import json
        import tarfile

        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, text, role in zip(rows["key"], rows["text"], rows["role"], strict=True):
                for kind, content in (("txt", text or ""), ("json", json.dumps({"role": role}))):
                    member = tarfile.TarInfo(f"{name}.{kind}")
                    member.size = len(content.encode())
                    tar.addfile(member, io.BytesIO(content.encode()))
        return pd.DataFrame({"path": [f"shards/{key[0]}.tar"], "content": [out.getvalue()]})

    files = turns.groupBy("shard").applyInPandas(packed, "path string, content binary")
    return shards.tar_pairs(files).select("key", "shard", "caption", "language", F.col("meta")["role"].alias("role"))


@query
def run_folders(spark, sf_dir):
    """The sweep's runs as folders with configuration and results, found and read again, and one that has only its configuration."""
    root, found = scratch_path(spark, "runs"), materialize(sweep_grid_kp(spark, sf_dir), "sweep")
    for k, p in [tuple(r) for r in _grid(spark).collect()]:
        catalog.write_results(found.where((F.col("k") == k) & (F.col("p") == p)), f"{root}/k{k}-p{p}", {"k": k, "p": p, "proc": "asif"}, list(KS), "")
    catalog.put_text(spark, f"{root}/lost/run_config.json", '{"k": "7", "p": "1", "proc": "norm"}')
    catalog.put_text(spark, f"{root}/broken/run_config.json", "{no")
    wide = analysis.summary_tables(shards.read_runs(spark, root), ["k", "p", "proc"], list(KS))[0]
    return wide.drop("run_dir")


@query
def report_csv(spark, sf_dir):
    """A report table written as CSV and read again with its types."""
    path = scratch_path(spark, "report")
    catalog.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return loaders.read_report(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def _listed(spark, sf_dir):
    """Every third anchor, as a file of lines."""
    path = scratch_path(spark, "anchors")
    _ids(spark, sf_dir).where("anchor_id % 3 != 1").select(F.col("anchor_id").cast("string")).write.text(path)
    return shards.read_anchor_ids(spark, path)


@query
def anchor_list(spark, sf_dir):
    return _listed(spark, sf_dir)


@query
def subset_retrieval(spark, sf_dir):
    """Recall with the anchors of a list only."""
    from dataclasses import replace

    return retrieve.retrieve(replace(evaluation(spark, sf_dir), anchor_subset=_listed(spark, sf_dir)), config())


@query
def subset_checks(spark, sf_dir):
    """A list with an anchor twice, one below zero and one that isn't in the bank."""
    listed = _listed(spark, sf_dir)
    more = spark.createDataFrame([(0,), (-5,), (1 << 40,)], "anchor_id long")
    return select.subset_problems(listed.union(more), _ids(spark, sf_dir))


@query
def random_query(spark, sf_dir):
    """One query, drawn by a seed."""
    return select.random_subset(_ids(spark, sf_dir), 1, 11)


def _stored(spark, sf_dir):
    """A bank's folder: both kinds of embeddings in several files; every seventh text is missing."""
    root, rows = scratch_path(spark, "bank"), items(spark, sf_dir)
    rows.select(F.col("idx").alias("id"), F.col("iv").alias("vec")).repartition(3).write.parquet(f"{root}/embeddings/image")
    rows.where("idx % 7 != 0").select(F.col("idx").alias("id"), F.col("tv").alias("vec")).repartition(2).write.parquet(f"{root}/text_embs")
    return root


@query
def stored_anchors(spark, sf_dir):
    """Anchors that have both vectors, from two layouts of files, normalized."""
    both = loaders.load_anchors(spark, _stored(spark, sf_dir), below=900)
    return both.select("anchor_id", F.round(vectors.dot("img_vec", "txt_vec"), 9).alias("cosine"))


@query
def stored_vectors(spark, sf_dir):
    """All files of one modality, as they were stored."""
    rows = loaders.load_vectors(spark, _stored(spark, sf_dir), "text", normalize=False, dim=48)
    return rows.select("id", F.posexplode("vec").alias("at", "x"))


@query
def stored_evaluation(spark, sf_dir):
    """An evaluation set from its folder, whose captions have other column names."""
    root, rows = scratch_path(spark, "evaluation"), items(spark, sf_dir)
    name = F.concat(F.lit("img-"), F.col("idx").cast("string"))
    rows.select(F.col("idx").alias("caption_id"), name.alias("key"), F.col("language").alias("lang"), F.lit("x").alias("text")).write.parquet(f"{root}/captions")
    rows.select((F.col("idx") + 5).alias("image_idx"), name.alias("image_id")).write.parquet(f"{root}/images")
    rows.select(F.col("idx").alias("id"), F.col("tv").alias("vec")).write.parquet(f"{root}/embeddings/text")
    rows.select((F.col("idx") + 5).alias("id"), F.col("iv").alias("vec")).write.parquet(f"{root}/embeddings/image")
    captions, images = loaders.load_evaluation(spark, root)
    first = images.select(F.col("image_idx").alias("of"), F.col("vec").alias("image_vec"))
    return captions.join(first, F.col("image_idx") == F.col("of")).select("caption_id", "image_idx", "language", F.round(vectors.dot("vec", "image_vec"), 9).alias("cosine"))


@query
def bank_from_samples(spark, sf_dir):
    """A bank's folder that has samples only: both views come from them."""
    root = scratch_path(spark, "samples")
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("key"), F.col("text").alias("caption"), F.lit("en").alias("language"))
    cap.build_samples(pairs, "item_id").write.parquet(f"{root}/samples")
    images, captions = loaders.load_bank(spark, root)
    return captions.join(images.select(F.col("image_idx").alias("at_image"), F.col("image_id").alias("at_id")), F.col("image_idx") == F.col("at_image")).select("caption_id", "image_idx", "at_id", "language", "caption")


@query
def catalog_tables(spark, sf_dir):
    """Tables stored under their options: made once, found by an alias of their model."""
    store = catalog.Catalog(spark, scratch_path(spark, "catalog"))
    for n in (1, 2):  # the second time the stored table is used
        store.build("embeddings", {"dataset": "d", "modality": "text", "model": "bge-m3"}, lambda n=n: table(spark, sf_dir, "nation").select("n_nationkey", F.lit(n).alias("made")))
    return store.find("embeddings", "d", "text", "BGE")


@query
def image_files(spark, sf_dir):
    """Which file an image is in: by its relative path, by its stem with another extension, or by its id."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_idx"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("image_id"))
    images = pages.withColumn("image_relpath", F.concat(F.lit("a/"), "image_id", F.lit(".jpg")))
    kind = F.pmod("image_idx", F.lit(4))
    names = F.when(kind == 0, F.col("image_relpath")).when(kind == 1, F.concat(F.lit("a/"), "image_id", F.lit(".png"))).when(kind == 2, F.concat("image_id", F.lit(".webp")))
    files = images.select(names.alias("relpath")).where("relpath IS NOT NULL").select(F.concat(F.lit("/root/"), "relpath").alias("path"), "relpath")
    return shards.resolve_image_paths(images, files).select("image_idx", "path")


@query
def report_order(spark, sf_dir):
    """Rows by several columns, missing ones last, and their places."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"), "p_retailprice")
    return dense_ids(analysis.in_report_order(rows, ["size", "p_retailprice"], "p_partkey").withColumn("_last", F.col("size").isNull()), "place", "_last", "size", "p_retailprice", "p_partkey").select("p_partkey", "size", "place")


@query
def union_of_lists(spark, sf_dir):
    """Ids of several lists, each once, and how many rows the lists have together."""
    lists = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))]
    whole = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return whole.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def last_token_pool_right(spark, sf_dir):
    """The vector at the place that the mask sums up to."""
    return _pooled(_tokens(spark, sf_dir), vectors.last_token_pool_right("h", "m"))


@query
def model_inputs(spark, sf_dir):
    """What an encoder of conversations is asked: an instruction, and the text, which may be blank."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", encoders.conversation(F.lit("Describe."), F.when(F.col("turn") % 3 != 0, F.col("text"))).alias("c"))
    return turns.select("conv_id", "turn", F.col("c")[0]["content"][0]["text"].alias("instruction"), F.size(F.col("c")[1]["content"]).alias("parts"), F.col("c")[1]["content"][0]["text"].alias("text"))


@query
def column_choice(spark, sf_dir):
    """The first of several column names that is there, and names split from lists."""
    rows = table(spark, sf_dir, "orders")
    chosen = first_present(rows.columns, flat_list(["price o_price", "o_totalprice,o_custkey"]))
    return rows.select("o_orderkey", F.col(chosen).alias("value"))


@query
def appended_translations(spark, sf_dir):
    """Translations in two goes: what is there after the first isn't made again."""
    path, rows = scratch_path(spark, "translations"), caption_table(spark, sf_dir).withColumn("image_id", F.col("image_idx").cast("string"))
    translate.append_translations(rows.where("image_idx % 2 = 0"), path, _client, batch=7)
    translate.append_translations(rows, path, _client, batch=3)
    return spark.read.parquet(path).select("caption_id", "image_idx", "language", "translation")


@query
def encoded_by_language(spark, sf_dir):
    """An encoder that is called with runs of one language, through the registry and its default."""
    load = encoders.make_encoder("unknown-model", default=_lengths_name())
    if encoders.check_dimension(load, "abc") != 2:
        raise ValueError("the encoder has two components")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), "text")
    return encoders.encode(rows, "text", load, by_language=True, batch_rows=9).select("doc_id", F.col("vec")[0].cast("long").alias("n_chars"), F.col("vec")[1].cast("long").alias("n_language"))


def _lengths_name() -> str:
    def load():
        def lengths(texts, language=""):
            return [[len(t), len(language)] for t in texts]

        return lengths

    encoders.register("lengths", load)
    return "lengths"
