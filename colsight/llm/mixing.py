"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Each document draws an exponential key, divided by its quality weight; the smallest keys come first. Within
a source the documents stand in key order, and their sizes are summed up to the token budget. Whole
epochs of a source come before the sample of its last, partial one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import boxed, broadcast_if_small, quoted, running_totals, stored, unboxed, words

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 42
_SOURCE_BYTES = 128  # of a source's name and numbers
_DIGITS = 13  # of a hexadecimal digest: 52 bits, exact in a double


def exponential_key(identity: Column, weight: Column, seed: int = SEED) -> Column:
    """A reproducible draw from an exponential distribution with rate ``weight``, rounded to 12 digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * _DIGITS)
    return F.round(-F.log(uniform) / weight, 12)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """``origin, source_size`` gets ``target``. Sources weigh as listed, in order of ``origin``.

    The targets share ``share`` times all sizes by weight, and a target stops at ``most`` times its source;
    its excess goes to the others. Sorted by ``most * size / weight`` the sources that stop come first: the level
    of the rest is what is left divided by their weights, and the first level below the next stop holds.
    There is one row for each source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(Window.orderBy("origin")) - 1) % len(weights)))
    stop = F.col("source_size") * F.lit(float(most))
    by_stop = Window.orderBy(stop / F.col("weight"), "origin")
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = ranked.withColumns({"stop": stop, "level": level})
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), "origin", "level"))).over(everything)
    target = F.coalesce(F.least(held["level"] * F.col("weight"), F.col("stop")), F.col("stop"))
    return tried.select("origin", "source_size", F.round(target, 6).alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column | None = None,
    id_column: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``epochs`` (whole passes) and ``copies`` (times a document is taken).

    ``size`` and ``quality`` (above zero; a null or smaller one counts as 1) are expressions over ``docs``. A null
    source is a source of its own, the last; a null size is 0. In the partial epoch documents are taken in key
    order while they fit, then one more document of the source, the one that comes closest to what is left, if
    it lessens the distance. Rows with the same id have the same key and follow each other. Reruns agree.
    """
    quality = F.lit(1.0) if quality is None else quality.cast("double")
    origin = F.when(F.col(quoted(source)).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(quoted(source)).cast("string")))
    weight = F.when(quality > 0, quality).otherwise(1.0)
    sized = boxed(
        docs,
        origin=origin,
        size=F.coalesce(size.cast("long"), F.lit(0)),
        id=F.col(quoted(id_column)),
        key=exponential_key(F.col(quoted(id_column)), weight, seed),
    )
    ordered = stored(running_totals(sized, "origin", ["key", "id", "size"], before=F.col("size")))
    aims = targets(ordered.groupBy("origin").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = stored(aims.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))
    # Beside a broadcast of the sources, sums by source combine before the shuffle, and a hot source stays spread.
    lined = ordered.join(broadcast_if_small(aims, _SOURCE_BYTES), "origin").withColumn("fits", fits)
    left = lined.groupBy("origin").agg((F.first("rest") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("left"))
    left = broadcast_if_small(stored(left), _SOURCE_BYTES)
    open_rows = lined.where(~F.col("fits")).select("origin", "place", "size").join(left, "origin")
    distance = F.abs(F.col("size") - F.col("left"))
    closest = open_rows.where(distance < F.col("left")).groupBy("origin").agg(F.min(F.struct(distance.alias("off"), "place"))["place"].alias("one_more"))
    chosen = lined.join(broadcast_if_small(stored(closest), _SOURCE_BYTES), "origin", "left")
    copies = F.col("epochs") + (F.col("fits") | F.coalesce(F.col("place") == F.col("one_more"), F.lit(False))).cast("int")
    return unboxed(
        chosen,
        docs.columns,
        size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        epochs=F.col("epochs"),
        copies=copies,
    )


def mixed_documents(docs: DataFrame, size: Column, quality: Column | None = None, id_column: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Rows are numbered and stored first, so that only ids, sources and sizes go through the sort.
    """
    quality = F.lit(1.0) if quality is None else quality.cast("double")
    sized = boxed(docs, item=F.monotonically_increasing_id(), id=F.col(quoted(id_column)), origin=F.col(quoted(source)), size=size, quality=quality)
    numbered = stored(sized)
    plan = mix(numbered.drop("row"), F.col("size"), F.col("quality"), "id", "origin")
    taken = stored(plan.where("copies > 0").select("item", "copies"))
    joined = numbered.drop("size").join(broadcast_if_small(taken, 16), "item")
    return unboxed(joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def symbol_quality(text: Column, size: Column) -> Column:
    """A quality weight in (0, 1]: 1 without symbols of markup and tables, less the more there are for each word."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return 1.0 / (1.0 + 10.0 * symbols / F.greatest(size, F.lit(1)))
