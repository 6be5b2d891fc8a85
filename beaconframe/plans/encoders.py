"""Encoders as vectorised functions, and the builders that fill embedding tables with them.

A model is anything that turns a list of texts (or images as bytes) into a matrix.  It is
loaded once for each Python worker.  ``letter_frequencies`` is an encoder without a model
that SQL can express as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.functions.vectors import l2_normalize


class Encoder(Protocol):
    def __call__(self, items: list) -> np.ndarray: ...


#: name -> a function that loads the encoder, on the worker that uses it.
_REGISTRY: dict[str, Callable[[], Encoder]] = {}


def register(name: str, load: Callable[[], Encoder]) -> None:
    _REGISTRY[name] = load


def make_encoder(name: str, default: str | None = None) -> Callable[[], Encoder]:
    if name in _REGISTRY:
        return _REGISTRY[name]
    if default is not None and default in _REGISTRY:
        return _REGISTRY[default]
    raise KeyError(f"no encoder {name!r}; there are {', '.join(sorted(_REGISTRY)) or 'none'}")


@dataclass(frozen=True)
class Preset:
    """How a kind of model is used: its pooling (None: the model pools), and what is normalized.

    ``bank`` and ``evaluation`` say whether vectors of an anchor bank and of an evaluation set
    are normalized; ``by_language`` holds for evaluation sets.  What happens to images before
    a model sees them is up to the model.
    """

    modality: str
    pooling: str | None
    bank: bool
    evaluation: bool
    by_language: bool = False


PRESETS = {
    "dinov3": Preset("image", None, False, False),
    "clip": Preset("image", None, False, True),
    "radio": Preset("image", None, False, True),
    "nllb": Preset("text", "mean", False, True, by_language=True),
    "bge": Preset("text", "cls", False, True),
    "qwen3": Preset("text", "last", False, True),
}


def preset(name: str, modality: str, *, evaluation: bool) -> Preset:
    """The preset that a model's name begins with; for other names bge for texts, and dinov3 (bank) or radio (evaluation) for images."""
    for key, found in PRESETS.items():
        if name.lower().startswith(key) and found.modality == modality:
            return found
    return PRESETS["bge" if modality == "text" else "radio" if evaluation else "dinov3"]


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """One vector of each item's token vectors (items x tokens x size), padded on either side: ``mean``, ``cls`` or ``last``."""
    hidden, mask = np.asarray(hidden, np.float32), np.asarray(mask) > 0
    if how == "mean":
        return (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-6)[:, None]
    if how == "cls":
        return hidden[:, 0]
    if how == "last":
        last = np.where(mask.any(axis=1), mask.shape[1] - 1 - mask[:, ::-1].argmax(axis=1), 0)
        return hidden[np.arange(len(hidden)), last]
    raise ValueError(f"unknown pooling {how!r}")


def pooled(load: Callable[[], Callable], how: str) -> Callable[[], Encoder]:
    """An encoder from a model that gives (hidden, mask) of its items."""

    def loaded() -> Encoder:
        model = load()
        return lambda items, **more: pool(*model(items, **more), how)

    return loaded


def encode_preset(rows: DataFrame, item: str, name: str, load: Callable[[], Callable], modality: str, *, evaluation: bool, normalize: bool | None = None, **options) -> DataFrame:
    """``encode`` as the preset of a model says, or normalized or not as told; ``load`` gives (hidden, mask) where the preset pools, else vectors."""
    how = preset(name, modality, evaluation=evaluation)
    load = pooled(load, how.pooling) if how.pooling else load
    if normalize is None:
        normalize = how.evaluation if evaluation else how.bank
    return encode(rows, item, load, normalize=normalize, by_language=how.by_language and evaluation, **options)


def letter_frequencies(text: Column | str) -> Column:
    """How often each letter a to z is in the lower-cased text, as 26 numbers."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    # The letters are single bytes, so bytes are counted and not characters.
    return F.array(*((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in ascii_lowercase))


def encode(rows: DataFrame, item: str, load: Callable[[], Encoder], *, out: str = "vec", batch_rows: int = 64, normalize: bool = False, by_language: bool = False) -> DataFrame:
    """``rows`` with a vector of each item; null items get null.

    With ``by_language`` the rows of a language come together in each partition, and the
    encoder is called with ``language=`` for each run of one language.
    """
    columns = rows.columns
    if by_language:
        rows = rows.sortWithinPartitions("language")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        model = load()
        for frame in frames:
            vectors: list = [None] * len(frame)
            groups = frame.groupby("language", sort=False, dropna=False).indices.items() if by_language else [(None, np.arange(len(frame)))]
            for language, places in groups:
                places = [i for i in places if not pd.isna(frame[item].iloc[i])]
                for at in range(0, len(places), batch_rows):
                    part = places[at : at + batch_rows]
                    items = [frame[item].iloc[i] for i in part]
                    m = np.asarray(model(items, language=language) if by_language else model(items), np.float32)
                    if m.ndim != 2 or len(m) != len(items):
                        raise ValueError(f"the encoder made {m.shape} of {len(items)} items")
                    for i, v in zip(part, m, strict=True):
                        vectors[i] = v.tolist()
            yield frame.assign(**{out: vectors})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<float>"])
    made = rows.mapInPandas(run, schema)
    return made.select(*columns, l2_normalize(F.col(out).cast("array<double>")).cast("array<float>").alias(out)) if normalize else made


def check_dimension(load: Callable[[], Encoder], item) -> int:
    """The length of an encoder's vectors, from one item; an error for another shape."""
    m = np.asarray(load()([item]))
    if m.ndim != 2 or m.shape[0] != 1:
        raise ValueError(f"expected one vector, got shape {m.shape}")
    return int(m.shape[1])


def conversation(instruction: Column, text: Column | None = None, image: Column | None = None) -> Column:
    """A system instruction and a user turn with image and text; without content the text is empty."""
    part = "struct<type:string,text:string,image:string>"
    as_text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image")).cast(part)
    words = F.lit(None).cast("string") if text is None else F.nullif(F.trim(text), F.lit(""))
    picture = F.lit(None).cast("string") if image is None else image
    content = F.filter(
        F.array(F.when(picture.isNotNull(), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), picture.alias("image")).cast(part)), F.when(words.isNotNull(), as_text(words))),
        lambda x: x.isNotNull(),
    )
    content = F.when(F.size(content) == 0, F.array(as_text(F.lit("")))).otherwise(content)
    return F.array(F.struct(F.lit("system").alias("role"), F.array(as_text(instruction)).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))
