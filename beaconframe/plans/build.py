"""From raw records to tables of results: the steps of a whole study, in order.

Each step stores its table in the catalog under its options and is skipped if it is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.operators import relrep
from beaconframe.sources import captions as cap

from . import encoders, retrieve
from .catalog import Catalog, same_rows, write_results


def build_index(store: Catalog, dataset: str, lines: DataFrame, *, max_images: int | None = None, files: DataFrame | None = None, overwrite: bool = False, **parsing) -> tuple[DataFrame, DataFrame]:
    """(images, captions) of the caption records in ``lines``; an empty dataset is an error."""
    options = {"dataset": dataset, "modality": "index", "max_images": max_images, "parsing": {k: str(v) for k, v in parsing.items()}}

    def records() -> DataFrame:
        found = cap.parse_records(lines, **parsing)
        return found if files is None else cap.with_images(found, files)

    images = store.build("images", options, lambda: cap.build_images(records(), max_images), overwrite=overwrite)
    if not images.limit(1).count():
        raise ValueError(f"no record of {dataset} has an image and a caption")
    return images, store.build("captions", options, lambda: cap.build_captions(images), overwrite=overwrite)


def build_embeddings(
    store: Catalog, dataset: str, modality: str, model: str, rows: DataFrame, id_col: str, item: str, load: Callable[[], encoders.Encoder], *, rows_per_file: int = 1_000_000, overwrite: bool = False, **how: Any
) -> DataFrame:
    """(id, vec) of each row's item, stored under dataset, modality and model."""
    options = {"dataset": dataset, "modality": modality, "model": model, "how": {k: str(v) for k, v in how.items()}}
    columns = [F.col(id_col).alias("id"), F.col(item).alias("item"), *(["language"] if how.get("by_language") else [])]
    return store.build("embeddings", options, lambda: encoders.encode(rows.select(*columns), "item", load, **how).select("id", "vec"), overwrite=overwrite, rows_per_file=rows_per_file)


def reuse_images(stored_index: DataFrame, wanted_index: DataFrame) -> None:
    """Raise unless two image indexes number the same images alike, so that their vectors can be shared."""
    columns = ["image_idx", "image_id"]
    differs = same_rows(stored_index.select(*columns), wanted_index.select(*columns)).limit(3).collect()
    if differs:
        raise ValueError(f"the image sets differ: {', '.join(str(r['image_id']) for r in differs)}")


def evaluation_set(captions: DataFrame, caption_vectors: DataFrame, image_vectors: DataFrame, anchors: DataFrame) -> retrieve.EvaluationSet:
    """Index and embeddings joined by id; anchors have (anchor_id, img_vec, txt_vec)."""
    texts = caption_vectors.select(F.col("id").alias("caption_id"), "vec")
    return retrieve.EvaluationSet(captions.select("caption_id", "image_idx", "language").join(texts, "caption_id"), image_vectors.select(F.col("id").alias("image_idx"), "vec"), anchors)


def stored_postings(store: Catalog, data: retrieve.EvaluationSet, config: retrieve.RetrievalConfig, *, overwrite: bool = False) -> DataFrame:
    """(id, anchor_id, w) of all images, computed once for the options that they depend on.

    Options of the queries (languages, cut-offs, limits) don't count, so runs that differ
    only in those share the postings.
    """
    options = {"model": config.image_model, "modality": "image", "postings": config.fingerprint(index_only=True)}

    def make() -> DataFrame:
        near = retrieve.image_neighbours(data, config)
        return relrep.weights(near, proc=config.proc, p=config.p, clamp_min=config.clamp_min).select("id", "anchor_id", "w")

    return store.build("postings", options, make, overwrite=overwrite)


def run_grid(
    store: Catalog,
    data: dict[tuple[str, str], retrieve.EvaluationSet],
    ks: Iterable[int],
    ps: Iterable[int],
    config: retrieve.RetrievalConfig,
    *,
    timestamp: str,
    skip_existing: bool = True,
    continue_on_error: bool = True,
    dry_run: bool = False,
) -> DataFrame:
    """Run all (text model, image model, k, p) and return (run_dir, status, error).

    ``data`` has an evaluation set for each pair of models; the runs of a pair share one
    pass over its similarities.  Each run writes its own folder with results.json.  A run
    whose results are there is skipped; one that failed before isn't.
    """
    spark, out = store.spark, []
    for (text, image), own in data.items():
        runs = []
        for k in ks:
            for p in ps:
                one = replace(config, text_model=text, image_model=image, k=k, p=p)
                run_dir = f"{store.root}/runs/{text}__{image}__k{k}__p{p}__{one.fingerprint()[:8]}"
                if skip_existing and store._exists(f"{run_dir}/results.json"):
                    out.append((run_dir, "skipped", None))
                elif dry_run:
                    out.append((run_dir, "dry_run", None))
                else:
                    runs.append((run_dir, one))
        if not runs:
            continue
        try:
            grid = spark.createDataFrame(sorted({(c.k, c.p) for _, c in runs}), "k int, p int")
            # A few rows for each run and language: kept, as each run's file is a job of its own.
            found = retrieve.sweep(own, config, grid).persist()
            for run_dir, one in runs:
                write_results(found.where((F.col("k") == one.k) & (F.col("p") == one.p)), run_dir, asdict(one), list(one.ks), timestamp)
                out.append((run_dir, "ok", None))
            found.unpersist()
        except Exception as error:
            if not continue_on_error:
                raise
            done = {r for r, _, _ in out}
            out += [(r, "failed", str(error)[:500]) for r, _ in runs if r not in done]
    return spark.createDataFrame(out, "run_dir string, status string, error string")
