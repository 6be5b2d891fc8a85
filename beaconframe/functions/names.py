"""Small text and number expressions: names for files, labels, percentages, models."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# The model types of the two kinds of baseline runs.
CLIP_RUNS = "clip_dense_retrieval_baseline"
QWEN_RUNS = "multimodal_multilingual_embedding_baseline"


def file_safe(name: Column | str, keep: str = r"A-Za-z0-9._\-", default: str = "model") -> Column:
    """Runs of other characters become one ``_``, none stand at the ends, and nothing becomes ``default``."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, f"[^{keep}]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def one_line(caption: Column | str) -> Column:
    c = F.col(caption) if isinstance(caption, str) else caption
    return F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))


def short_title(text: Column | str, most: int = 120) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def percent_label(pct: Column | str) -> Column:
    """2.5 -> 2p5, 50.0 -> 50."""
    c = F.col(pct) if isinstance(pct, str) else pct
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.replace(c.cast("string"), F.lit("."), F.lit("p")))


def percent_to_count(base: Column, pct: Column, k: Column | int) -> Column:
    """max(k, base * (pct / 100)) with halves rounded to even, in double precision."""
    least = F.lit(k) if isinstance(k, int) else k
    return F.greatest(least.cast("long"), F.bround(base.cast("double") * (pct / F.lit(100.0))).cast("long"))


def percents(text: str) -> list[float]:
    """Numbers separated by commas or white space; each must be over 0 and at most 100."""
    found = [float(x) for x in re.split(r"[,\s]+", text.strip()) if x]
    if not found or any(not 0 < x <= 100 for x in found):
        raise ValueError("percentages lie in (0, 100]")
    return found


def flat_list(values: list[str]) -> list[str]:
    """``["a b", "c,d"]`` -> ``["a", "b", "c", "d"]``."""
    return [x for v in values for x in re.split(r"[,\s]+", v) if x]


def numeric(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def first_present(columns: list[str], names: list[str]) -> str:
    """The first of ``names`` among ``columns``."""
    for n in names:
        if n in columns:
            return n
    raise KeyError(f"none of {names} among {columns}")


def infer_model_type(run_name: Column, model_type: Column) -> Column:
    """An empty model type follows from the run's name; what is set stays."""
    low, given = F.lower(run_name), F.coalesce(model_type, F.lit(""))
    return F.when(given != "", given).when(low.contains("clip"), CLIP_RUNS).when(low.contains("qwen"), QWEN_RUNS).otherwise(F.lit(""))
