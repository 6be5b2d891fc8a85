"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source has a target number of words, which gives each of its documents an expected
number of copies.  The whole part of that is certain.  The rest is an inclusion probability:
each document gets a random number, and the documents of a source are ranked by random odds
over inclusion odds (Pareto order).  The ranking is followed until the sample has its fixed
size, counted in words.  As whole documents seldom add up to that, one more document of the
ranking's last cell is taken, the one nearest to what is still missing, if that brings the
sum nearer to the target.

Scale: no source is ever sorted in one task.  The ranking is cut into cells of about
``cell_rows`` documents, summed with map-side combine, and cells into blocks; running sums
over a source's blocks and then over one block's cells find the cell where the sample ends,
and only that cell is ordered.  What comes out is one row for each source with the last
place of the ranking that is taken, so that documents are decided one by one in a join with
that small table.  Random numbers are hashes of seed and id: reruns and retried tasks agree.
Places are written once, so that the later steps read plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, materialize

_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
_CELLS_PER_BLOCK = 4096


def _once(value: Column) -> Column:
    """``value``, behind a condition that is true for every row and that Spark moves no filter past.

    The filter that an explode implies would else repeat the whole decision below the join.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _is(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def word_count(text: Column) -> Column:
    """Words of the whole text as long; 0 for null.  Words become one letter each, without a list of them."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), ASCII_SPACE, "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, ...) with a column target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum
    of all sizes.  A target stops at ``most`` times its source's size; what is above goes to
    the others by weight until none is above.  In order of that limit per weight, the
    sources that stop are a prefix, so a running sum settles them all.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(n - 1, F.lit(len(weights))) + 1).cast("long")
    ranked = Window.orderBy(F.col("limit") / F.col("weight"), F.col("n"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda of, spent: F.sum(of).over(ranked.rowsBetween(*_WHOLE)) - F.coalesce(F.sum(spent).over(before), F.lit(0))
    shared = (
        sizes.withColumn("n", n).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
        # The share of each weight, were this source and those after it to share what is left.
        .withColumn("level", rest("source_size", "limit").cast("double") / rest("weight", "weight").cast("double"))
        .withColumn("stops", F.col("limit").cast("double") < F.col("level") * F.col("weight"))
        .withColumn("level", F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(ranked.rowsBetween(*_WHOLE)))
    )
    target = F.when(F.col("stops") | F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return shared.withColumn("target", target).drop("n", "weight", "limit", "level", "stops")


def _draw(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / 4503599627370496.0


def _placed(docs: DataFrame, per_source: DataFrame, most: int) -> DataFrame:
    """``docs`` (id, source, size, weight, u, ...) with certain copies and the place in the ranking.

    place runs over (0, 1) and is null for documents that have no part in the sample.
    """
    copies = F.least(F.when(F.col("weighed") > 0, F.col("target") * F.col("weight") / F.col("weighed")).otherwise(0.0), F.lit(float(most)))
    odds = F.when(F.col("chance") > 0, (F.col("u") / (1.0 - F.col("u"))) / (F.col("chance") / (1.0 - F.col("chance"))))
    return (
        docs.join(per_source.withColumnRenamed("source", "_source"), _is("source", "_source")).drop("_source")
        .withColumn("copies", copies).withColumn("certain", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("certain"))
        .withColumn("odds", odds).withColumn("place", F.col("odds") / (1.0 + F.col("odds")))
        .drop("copies", "chance", "odds")
    )


def _end_cells(cells: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, end_cell, before, gap) of sources whose sample ends within the ranking.

    ``cells`` has (source, cell, fixed, words); gap is what the sample may take, before what
    the cells before the end take.  Blocks of cells are gone through first, then one block.
    """
    gaps = (
        cells.groupBy("source").agg(F.sum("fixed").alias("fixed"))
        .join(per_source.select(F.col("source").alias("_source"), "target"), _is("source", "_source"))
        .select("_source", (F.col("target") - F.col("fixed")).alias("gap"))
    )
    ranked = cells.where("cell IS NOT NULL").withColumn("block", F.floor(F.col("cell") / _CELLS_PER_BLOCK))
    until = lambda by: F.sum("words").over(Window.partitionBy("source").orderBy(by))
    blocks = ranked.groupBy("source", "block").agg(F.sum("words").alias("words")).withColumn("until", until("block"))
    block = (
        blocks.join(gaps, _is("source", "_source")).where("until > gap")
        .groupBy("source").agg(F.min(F.struct("block", (F.col("until") - F.col("words")).alias("before"), "gap")).alias("end"))
        .select(F.col("source").alias("_source"), F.col("end.block").alias("end_block"), F.col("end.before").alias("block_before"), "end.gap")
    )
    return (
        ranked.join(block, _is("source", "_source") & (F.col("block") == F.col("end_block")))
        .withColumn("until", F.col("block_before") + until("cell")).where("until > gap")
        .groupBy("source").agg(F.min(F.struct("cell", (F.col("until") - F.col("words")).alias("before"), "gap")).alias("end"))
        .select("source", F.col("end.cell").alias("end_cell"), "end.before", "end.gap")
    )


def plan_mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, cell_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Where each source's sample ends, and the documents with their places.

    ``docs`` has (id, source, size, weight, u).  The plan has a row for each source: source,
    source_size, weighed, target, n_cells, ends, last and extra.  Where ``ends`` holds, the
    documents up to ``last`` in the order of (place, id, size) are in the sample, and so is
    ``extra``; elsewhere all are that have a place.
    """
    sizes = docs.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).cast("double").alias("weighed"),
        F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("long").alias("n_cells"),
    )
    per_source = materialize(source_targets(sizes, weights, most), "mix-sources")
    rank = F.struct("place", "id", "size")
    placed = _placed(docs, per_source, most).select("id", "source", "size", "source_size", "target", "certain", "place", F.floor(F.col("place") * F.col("n_cells")).alias("cell"))
    placed = materialize(placed, "mix-places")
    cells = placed.groupBy("source", "cell").agg(
        F.sum(F.col("certain") * F.col("size")).alias("fixed"), F.sum(F.when(F.col("cell").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.max(F.when(F.col("cell").isNotNull(), rank)).alias("top"),
    )
    cells = materialize(cells, "mix-cells")
    ends = materialize(_end_cells(cells, per_source), "mix-ends").withColumnRenamed("source", "_source")

    # Rows that are equal in place, id and size share their fate.
    same = placed.join(ends, _is("source", "_source") & (F.col("cell") == F.col("end_cell"))).groupBy("source", "place", "id", "size", "gap", "before").agg(F.sum("size").alias("mine"))
    in_order = Window.partitionBy("source").orderBy("place", "id", "size")
    miss = F.col("gap") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("gap"), F.col("sum"))).over(in_order.rowsBetween(*_WHOLE)), F.col("before"))
    off = F.abs(F.col("mine") - F.col("miss"))
    last = (
        same.withColumn("sum", F.col("before") + F.sum("mine").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("miss", miss)
        .groupBy("source").agg(
            F.max(F.when(F.col("sum") <= F.col("gap"), rank)).alias("in_cell"),
            F.min(F.when((F.col("sum") > F.col("gap")) & (off < F.col("miss")), F.struct(off.alias("off"), rank.alias("rank")))).alias("extra"),
        ).select(F.col("source").alias("_last_source"), "in_cell", "extra.rank")
    )
    earlier = (
        cells.join(ends, _is("source", "_source") & (F.col("cell") < F.col("end_cell")))
        .groupBy("source").agg(F.max("top").alias("top")).select(F.col("source").alias("_top_source"), "top")
    )
    plan = (
        per_source.join(ends, _is("source", "_source"), "left").join(last, _is("source", "_last_source"), "left").join(earlier, _is("source", "_top_source"), "left")
        .select("source", "source_size", "weighed", "target", "n_cells", F.col("end_cell").isNotNull().alias("ends"), F.coalesce("in_cell", "top").alias("last"), F.col("rank").alias("extra"))
    )
    return materialize(plan, "mix-plan"), placed


def _copies() -> Column:
    """How often the mix takes a document, of the columns of its place and its source's plan."""
    rank = F.struct("place", "id", "size")
    sampled = F.col("place").isNotNull() & (~F.col("ends") | F.coalesce(rank <= F.col("last"), F.lit(False)) | rank.eqNullSafe(F.col("extra")))
    return F.col("certain") + F.when(sampled, 1).otherwise(0)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 42,
    cell_rows: int = 1000,
    slim: bool = False,
) -> DataFrame:
    """``docs`` with the struct column ``mix``: size, source_size, target, copies and taken.

    size counts the words of the whole text, copies says how often the mix takes the
    document (0 to ``most``), and taken is their product.  ``weight_col`` makes documents of
    a source more or less likely in proportion; null and negative weights count as 0.
    With ``slim`` only the id is kept beside ``mix``, and texts are read once.

    Null texts have size 0.  Null sources are a source of their own, the last one.  Rows
    that are equal in id and size share their random number and so their fate, and null ids
    count as equal.  An empty table gives no rows.  Other columns pass through, whatever
    their names; only one called ``mix`` is replaced.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    drawn = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("weight"), _draw(F.col(id_col), seed).alias("u")]
    plan, placed = plan_mix(materialize(docs.select(*drawn), "mix-sizes"), weights=weights, most=most, cell_rows=cell_rows)
    if slim:
        ends = plan.select(F.col("source").alias("_source"), "ends", "last", "extra")
        decided = placed.join(ends, _is("source", "_source")).withColumn("copies", _copies())
    else:
        decided = _placed(docs.select(*drawn, F.struct("*").alias("row")), plan, most).withColumn("copies", _once(_copies()))
    mixed = F.struct("size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken")).alias("mix")
    return decided.select(F.col("id").alias(id_col), mixed) if slim else decided.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "mix"), mixed)


def repeat_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; its columns stay the same."""
    tagged = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mixed = mix(tagged, id_col="id", text_col="text", source_col="source", **options)
    again = mixed.where("mix.copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies"))).alias("copy_no"))
    return again.select("row.*")
