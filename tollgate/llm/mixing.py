"""Mixing sources to target weights: hash-random order within each source, prefix sums, and one exact cut per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.sources.artifacts import materialize

#: Hex digits of the random key that make a range: 4,096 ranges of equal expected size per source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds ``target`` to a table ``source, source_size``.

    Sources weigh ``weights`` in code-point order, null last, repeating. Together they get ``share`` of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again by weight. That ends at
    one level per unit of weight: with sources in order of size per weight, the highest level that the rest would get
    once those before are at their limit.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    first = sources.select("source", "source_size", pick.alias("w")).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    level = (F.lit(share) * F.sum("source_size").over(everything).cast("double")
             - (F.sum("limit").over(order) - F.col("limit")).cast("double")) / (
        F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w"))
    levels = first.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levels.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``size, source_size, target, taken``.

    A document's place within its source is the md5 of its id. A source takes whole rounds over all its documents while
    they fit its target, then documents in this order up to the exact word; the document at the cut is taken in part.
    Sizes are counted per range of the key, so the cut is found in one range of 1/4096 of a source, and taking is a
    comparison per row: no text is shuffled, and a source with a third of all rows is no larger task than others.

    A null source is a source of its own and a null id is the empty text. Documents that share id and size share what
    is left at the cut equally (rounded down). Size 0 (null, empty or blank texts) takes 0. An empty table gives none.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    narrow = materialize(keyed.select("source", "size", "key", F.substring("key", 1, RANGE_DIGITS).alias("range")), "mix")
    ranges = materialize(narrow.groupBy("source", "range").agg(F.sum("size").alias("bytes")), "ranges")
    sources = targets(ranges.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    sources = sources.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long"))
    sources = materialize(sources.withColumn("rest", budget - F.col("rounds") * F.col("source_size")), "sources")

    upto = F.sum("bytes").over(Window.partitionBy("source").orderBy("range"))
    spans = ranges.withColumn("before", upto - F.col("bytes")).toDF("of", "range", "bytes", "before")
    edge = sources.join(spans, F.col("source").eqNullSafe(F.col("of"))).where("before <= rest and rest < before + bytes")
    edge = edge.select("of", F.col("range").alias("at"), "before", "rest")
    inside = narrow.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    ties = inside.groupBy("source", "key", "size", "before", "rest").agg(F.count("*").alias("n"))
    all_of = F.col("n") * F.col("size")
    start = F.col("before") + F.sum(all_of).over(Window.partitionBy("source").orderBy("key", "size")) - all_of
    cut = ties.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + all_of))
    cut = cut.select(F.col("source").alias("of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
                     F.expr("(rest - start) div n").alias("part"))
    plan = sources.join(cut, F.col("source").eqNullSafe(F.col("of")), "left")
    plan = materialize(plan.select(F.col("source").alias("of"), "source_size", "target", "rounds", "cut_key", "cut_size", "part"), "plan")

    here, there = F.struct("key", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    more = F.when(here < there, F.col("size")).when(here == there, F.col("part")).otherwise(F.lit(0))
    return keyed.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + more).cast("long").alias("taken"))


def copies(mixed: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself: each document as often as it was taken, a partly taken one cut after its last whole word taken."""
    times = F.col("taken") / F.greatest("size", F.lit(1))
    many = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(times).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col("row")[text_col]
    # Cut before each word: the pieces are words with the space that follows, the first may be leading space alone.
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    short = F.array_join(F.slice(pieces, F.lit(1), (left + lead).cast("int")), "")
    cut = many.withColumn("cut", F.when(left < F.col("size"), short).otherwise(text))
    names = [f for f in mixed.schema["row"].dataType.fieldNames()]
    kept = {text_col: F.col("cut"), chars_col: F.when(left < F.col("size"), F.char_length("cut")).otherwise(F.col("row")[chars_col])} if chars_col in names else {text_col: F.col("cut")}
    return cut.select(*[kept.get(n, F.col("row")[n]).cast(mixed.schema["row"].dataType[n].dataType).alias(n) for n in names])
