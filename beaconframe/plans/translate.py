"""Translating captions with a pluggable client, resumable and in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.select import resume

Client = Callable[[Sequence[str], str, str], Sequence[str]]


class Rejected(ValueError):
    """The client will never take this request (for instance an unknown language)."""


def with_retries(client: Client, *, tries: int = 5, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Client:
    """Calls again after waits that double; a rejected request isn't tried again."""

    def call(texts: Sequence[str], source: str, target: str) -> Sequence[str]:
        for n in range(tries):
            try:
                return client(texts, source, target)
            except Rejected:
                raise
            except Exception:
                if n + 1 == tries:
                    raise
                sleep(first_wait * 2**n)
        raise AssertionError

    return call


def translate(captions: DataFrame, load: Callable[[], Client], *, target: str = "en", batch: int = 16, out: str = "translation") -> DataFrame:
    """``captions`` (..., language, caption) with a translation; the target language is copied.

    A language that the client rejects isn't asked for again by the same worker; its
    translations are null.  Requests hold up to ``batch`` captions of one language.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in captions.schema), f"`{out}` string"])

    def run(frames: Iterator) -> Iterator:
        client, unsupported = load(), set()
        for frame in frames:
            done: list = [None] * len(frame)
            for language, places in frame.groupby("language", sort=False).indices.items():
                for at in range(0, len(places), batch):
                    part = places[at : at + batch]
                    texts = [frame["caption"].iloc[i] for i in part]
                    if language == target:
                        made = texts
                    elif language in unsupported:
                        continue
                    else:
                        try:
                            made = client(texts, language, target)
                        except Rejected:
                            unsupported.add(language)
                            continue
                    for i, x in zip(part, made, strict=True):
                        done[i] = x
            yield frame.assign(**{out: done})

    return captions.mapInPandas(run, schema)


def translated_records(translated: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(image_id, languages): for each image a map of language -> source captions and translations in order.

    A field whose translations are all null is an empty list.  Blank captions are left out.
    """
    kept = translated.where(F.trim("caption") != "")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("caption_id", F.col(c).alias("x")))), lambda s: s["x"])
    lists = kept.groupBy("image_id", "language").agg(
        in_order("caption").alias("source_caption"), *(F.when(F.count(f) == 0, F.array().cast("array<string>")).otherwise(in_order(f)).alias(f) for f in fields), F.min("caption_id").alias("_first")
    )
    body = F.struct("source_caption", *fields)
    return lists.groupBy("image_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_first", "language", body.alias("body")))), lambda e: F.struct(e["language"], e["body"]))).alias("languages"))


def append_translations(captions: DataFrame, path: str, load: Callable[[], Client], **options) -> int:
    """Translate the captions whose image isn't in the output yet, and append them; the number of new rows.

    What is done is read once at the start, so rows that repeat a new id are all written.
    """
    spark = captions.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        before = spark.read.parquet(path)
        n, captions = before.count(), resume(captions, before, "image_id")
    else:
        n, captions = 0, captions.where(F.col("image_id").isNotNull())
    translate(captions, load, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - n
