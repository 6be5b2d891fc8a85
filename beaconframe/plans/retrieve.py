"""Whole retrieval runs: relative representations, dense cosine, sweeps and ablations."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.functions.ids import dense_ids
from beaconframe.functions.names import percent_label, percent_to_count
from beaconframe.functions.scratch import materialize
from beaconframe.functions.vectors import dot, l2_normalize
from beaconframe.operators import analysis, evaluate, relrep, select, topk


@dataclass(frozen=True)
class RetrievalConfig:
    """The options of a run, with their usual values."""

    text_model: str = "nllb-200-3.3B"
    image_model: str = "dinov3-vit7b16"
    dtype: str = "float64"
    anchor_n: int | None = 1_600_000
    k: int = 800
    proc: str = "asif"
    p: int = 8
    clamp_min: float | None = None
    ks: tuple[int, ...] = (1, 5, 10, 25, 50)
    languages: tuple[str, ...] | None = None
    first_per_image_language: bool = False
    max_queries: int | None = None
    method: str = "blocks"

    def fingerprint(self, *, index_only: bool = False) -> str:
        """Equal for equal options; with ``index_only`` only those count that the images' postings depend on."""
        options = asdict(self)
        if index_only:
            options = {n: options[n] for n in ("image_model", "dtype", "anchor_n", "k", "proc", "p", "clamp_min")}
        return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class EvaluationSet:
    """captions (caption_id, image_idx, language, vec), images (image_idx, vec), anchors (anchor_id, img_vec, txt_vec)."""

    captions: DataFrame
    images: DataFrame
    anchors: DataFrame
    anchor_subset: DataFrame | None = field(default=None)
    #: Items are anchors too, under the same id, and an item's own anchor doesn't count.
    leave_one_out: bool = False

    def neighbours(self, rows: DataFrame, vec: str, config: "RetrievalConfig") -> DataFrame:
        found = topk.top_k(rows, self.bank(vec, config), config.k + self.leave_one_out, method=config.method)
        return topk.without_self(found, config.k) if self.leave_one_out else found

    def bank(self, vec: str, config: RetrievalConfig) -> DataFrame:
        rows = self.anchors
        if self.anchor_subset is not None:
            rows = rows.join(self.anchor_subset.select("anchor_id"), "anchor_id", "left_semi")
        elif config.anchor_n is not None:
            rows = select.first_n(rows, config.anchor_n)
        return rows.select("anchor_id", l2_normalize(F.col(vec).cast("array<double>")).alias("vec"))


def check(data: EvaluationSet, config: RetrievalConfig) -> None:
    """Raise for what would give wrong results: too few anchors, other dimensions, no queries."""
    n = data.bank("img_vec", config).count()
    if n < config.k:
        raise ValueError(f"{n} anchors, but k is {config.k}")
    sizes = lambda df, c: {r[0] for r in df.select(F.size(c)).distinct().limit(3).collect()}
    for df, c, bank in ((data.images, "vec", "img_vec"), (data.captions, "vec", "txt_vec")):
        if len(found := sizes(df, c) | sizes(data.anchors, bank)) > 1:
            raise ValueError(f"vectors of {sorted(found)} components")
    if not queries_of(data, config).limit(1).count():
        raise ValueError("no queries are left")


def queries_of(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    return select.select_queries(data.captions, languages=list(config.languages) if config.languages else None, first_per_image_language=config.first_per_image_language, max_queries=config.max_queries)


def chosen_captions(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    """The captions of the queries with their vectors; all of them if nothing is selected."""
    if not config.languages and not config.first_per_image_language and config.max_queries is None:
        return data.captions
    return data.captions.join(queries_of(data, config).select("caption_id"), "caption_id", "left_semi")


def _unit(rows: DataFrame, id_col: str, *more: Column) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), l2_normalize(F.col("vec").cast("array<double>")).alias("vec"), *more)


def image_neighbours(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    return data.neighbours(_unit(data.images, "image_idx"), "img_vec", config)


def caption_neighbours(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    return data.neighbours(_unit(chosen_captions(data, config), "caption_id"), "txt_vec", config)


def ranks(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    """(caption_id, gt, language, rank) of each query, without a grid of captions and images."""
    how = {"proc": config.proc, "p": config.p, "clamp_min": config.clamp_min}
    found = relrep.scores(relrep.weights(caption_neighbours(data, config), **how), relrep.weights(image_neighbours(data, config), **how))
    n_images = data.images.agg(F.count(F.lit(1)).alias("n_images"))
    truth = queries_of(data, config).crossJoin(n_images)
    return relrep.ground_truth_rank(found, truth, F.col("n_images")).drop("n_images")


def retrieve(data: EvaluationSet, config: RetrievalConfig, *, mrr: bool = False) -> DataFrame:
    return evaluate.recall_table(ranks(data, config), list(config.ks), mrr=mrr)


def retrieve_dense(data: EvaluationSet, config: RetrievalConfig) -> DataFrame:
    """Recall and MRR of plain cosine in one shared space."""
    most = max(config.ks)
    images = _unit(data.images, "image_idx").withColumnRenamed("id", "anchor_id")
    best = topk.top_k(_unit(chosen_captions(data, config), "caption_id"), images, most, method=config.method)
    truth = queries_of(data, config)
    hit = best.select(F.col("id").alias("caption_id"), F.col("anchor_id").alias("gt"), F.col("rk").alias("rank"))
    return evaluate.recall_table(truth.join(hit, ["caption_id", "gt"], "left"), list(config.ks), mrr=True)


def _small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` marked for a broadcast if there are few of them, else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def sweep(data: EvaluationSet, config: RetrievalConfig, grid: DataFrame) -> DataFrame:
    """Recall for each (k, p) of ``grid`` from one similarity pass for each modality.

    The best k of a total order are a prefix of the best k_max, and p only changes values,
    so the neighbours for the largest k serve all runs.
    """
    largest = RetrievalConfig(**{**asdict(config), "k": grid.agg(F.max("k")).first()[0]})

    def represented(neighbours: DataFrame) -> DataFrame:
        run = neighbours.join(_small(grid), F.col("rk") <= F.col("k"))
        v = relrep.process_weight(F.col("s"), "norm", 1, config.clamp_min)
        powered = run.withColumn("s", F.pow(v, F.col("p").cast("double"))) if config.proc == "asif" else run
        return relrep.weights(powered, proc="none" if config.proc == "none" else "norm", clamp_min=config.clamp_min if config.proc == "none" else None, keys=("k", "p", "id"))

    found = relrep.scores(represented(caption_neighbours(data, largest)), represented(image_neighbours(data, largest)), keys=("k", "p"))
    truth = queries_of(data, config).crossJoin(grid).crossJoin(data.images.agg(F.count(F.lit(1)).alias("n_images")))
    ranked = relrep.ground_truth_rank(found, truth, F.col("n_images"), keys=("k", "p"))
    return evaluate.recall_table(ranked, list(config.ks), keys=("k", "p"))


def subset_ablation(data: EvaluationSet, config: RetrievalConfig, subsets: DataFrame) -> DataFrame:
    """Recall for each ``subset_id`` of ``subsets`` (subset_id, anchor_id), all in one job.

    Products of vectors are shared by all subsets; each has its own best k.
    """
    subsets = materialize(subsets.select(F.col("subset_id").cast("string").alias("subset_id"), "anchor_id"), "subsets")
    members = subsets.groupBy("anchor_id").agg(F.collect_set("subset_id").alias("subsets"))

    def represented(rows: DataFrame, bank: DataFrame, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
        pairs, lists = topk.top_k_lists(rows, bank.join(members, "anchor_id"), config.k, leave_own=data.leave_one_out, extra=extra)
        return relrep.weighted_blocks(pairs, lists, name, proc=config.proc, p=config.p, clamp_min=config.clamp_min, extra=extra)

    whole = RetrievalConfig(**{**asdict(config), "anchor_n": None})
    captions = chosen_captions(data, config)
    texts = represented(_unit(captions, "caption_id", F.col("image_idx").alias("gt")), data.bank("txt_vec", whole), "c", ("gt",))
    images = represented(_unit(data.images, "image_idx"), data.bank("img_vec", whole), "i")
    truth = queries_of(data, config).crossJoin(subsets.select("subset_id").distinct()).crossJoin(data.images.agg(F.count(F.lit(1)).alias("n_images")))
    return evaluate.recall_table(relrep.rank_of_blocks(texts, images, truth, F.col("n_images"), "subset_id"), list(config.ks), keys=("subset_id",))


def random_grid(percentages: DataFrame, repeats: int, seed_start: int = 0, repeat_full: bool = False) -> DataFrame:
    """(percentage, percentage_label, repeat_idx, seed): one run for 100 %, which all seeds would repeat."""
    runs = percentages.crossJoin(percentages.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat_idx")))
    if not repeat_full:
        runs = runs.where((F.col("percentage") < 100) | (F.col("repeat_idx") == 0))
    return runs.select("percentage", percent_label("percentage").alias("percentage_label"), "repeat_idx", (F.col("repeat_idx") + seed_start).alias("seed"))


def random_subsets(anchors: DataFrame, runs: DataFrame, base_n: int, k: int) -> DataFrame:
    """(percentage, seed, anchor_n, anchor_id) of each run: the first anchor_n in the seed's order of the first ``base_n``."""
    sized = runs.withColumn("anchor_n", percent_to_count(F.lit(base_n), F.col("percentage"), k))
    all_drawn = select.first_n(anchors, base_n).select("anchor_id").crossJoin(_small(sized)).withColumn("_key", select.shuffle_key("anchor_id", F.col("seed")))
    # One numbering of all runs, which begin where the smallest number of the run is.
    drawn = dense_ids(all_drawn, "_n", "percentage", "seed", "_key", "anchor_id")
    begins = drawn.groupBy(F.col("percentage").alias("_percentage"), F.col("seed").alias("_seed")).agg(F.min("_n").alias("_begin"))
    drawn = drawn.join(_small(begins), (F.col("percentage") == F.col("_percentage")) & (F.col("seed") == F.col("_seed")))
    return drawn.where(F.col("_n") - F.col("_begin") < F.col("anchor_n")).select("percentage", "seed", "anchor_n", "anchor_id")


def first_n_subsets(anchors: DataFrame, percentages: DataFrame, base_n: int, k: int) -> DataFrame:
    """(percentage, anchor_n, anchor_id): the first anchors of each percentage."""
    sized = percentages.withColumn("anchor_n", percent_to_count(F.lit(base_n), F.col("percentage"), k))
    return anchors.select("anchor_id").join(_small(sized), F.col("anchor_id") < F.col("anchor_n")).select("percentage", "anchor_n", "anchor_id")


def similarity_profile(data: EvaluationSet, caption_id: int, *, top: int = 1000, bins: int = 80, lo: float = -0.2, hi: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For one caption: (histogram, means of all and of the best, the best anchors with rank)."""
    one = _unit(data.captions.where(F.col("caption_id") == caption_id), "caption_id")
    bank = data.bank("txt_vec", RetrievalConfig(anchor_n=None))
    pairs = bank.crossJoin(F.broadcast(one.select("id", F.col("vec").alias("q"))))
    scored = materialize(pairs.select("id", "anchor_id", F.round(dot("q", "vec"), topk.PLACES).alias("s")), "profile")
    best = topk.single_query_top_k(scored, top).withColumnRenamed("rank", "rk")
    means = scored.agg(F.avg("s").alias("mean_all")).crossJoin(best.agg(F.avg("s").alias("mean_top")))
    return analysis.histogram(scored, "s", lo=lo, hi=hi, bins=bins), means, best
