"""Line dedup: lines found in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import WHITE, ascii_lower, boxed, broadcast_if_small, let, quoted, stored, unboxed

LEAST_DOCUMENTS, LEAST_LENGTH = 10, 1


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _digest(column: Column) -> Column:
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def _keep(lines: Column, dropped: Column) -> Column:
    """The lines without those at the sorted places ``dropped``: the stretches between them, one after the other."""

    def stretches(places: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
        between = lambda k: F.slice(lines, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), between))

    return let(dropped, stretches)


def drop_common_lines(
    docs: DataFrame, text: str = "text", least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH
) -> DataFrame:
    """All rows with ``text`` rebuilt, ``n_lines`` (before) and ``n_dropped``.

    Lines end at ``\\n``; a null or empty text is one empty line. A key of at least ``least_length`` characters that
    is found in at least ``least_documents`` rows loses all its lines; the others stay in their order. Each row
    counts once for a key, so repeated rows count as often as they are there. A text that keeps no line is empty.

    Keys are counted by digest, combined before the shuffle. What each distinct text loses goes back to its rows
    by the text's digest; texts themselves move only where that table is too large to broadcast.
    """
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    rows = boxed(docs, body=whole, sha=_digest(whole))
    keyed = F.transform(F.split("body", "\n"), lambda line, at: F.struct(line_key(line).alias("key"), at.alias("at")))
    long_enough = F.filter(keyed, lambda x: F.char_length(x["key"]) >= least_length)
    hashed = F.transform(long_enough, lambda x: F.struct(_digest(x["key"]).alias("key"), x["at"].alias("at")))
    lines = stored(rows.select("sha", hashed.alias("lines")))
    once = lines.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    common = stored(once.groupBy("key").count().where(F.col("count") >= least_documents).select("key"))
    places = lines.dropDuplicates(["sha"]).select("sha", F.inline("lines"))
    lost = places.join(broadcast_if_small(common, 32), "key").groupBy("sha").agg(F.sort_array(F.collect_list("at")).alias("dropped"))
    lost = stored(lost)
    width = 48 + 4 * (lost.agg(F.avg(F.size("dropped"))).first()[0] or 0)
    found = rows.join(broadcast_if_small(lost, width), "sha", "left")
    split = F.split("body", "\n")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.when(F.col("dropped").isNull(), F.col("body")).otherwise(let(split, lambda all_lines: F.array_join(_keep(all_lines, gone), "\n")))
    counted = found.withColumns({"n": F.size(split).cast("long"), "gone": F.size(gone).cast("long"), "kept": kept})
    return unboxed(counted, docs.columns, **{text: F.col("kept"), "n_lines": F.col("n"), "n_dropped": F.col("gone")})
