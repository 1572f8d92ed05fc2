"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight (its share of the mix) and a schedule (how its
intensity runs over training time 0 to 1). A source's documents, in an order
drawn by hash, form a line of words. The share asks for a length of that line,
in whole passes and a last part; the schedule's integral, inverted, says when
each document's words are due.

Cases: a null text has size 0; a null source is a source, last in order; ties
in the hash order are broken by id and size, so that equal rows alone can
trade places; repeated rows are documents of their own; an empty input gives
an empty mix; a mix without words takes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import BLANKS, Workspace, shuffle_parts

#: Hash ranges that the sources' lines are cut into at least, and rows of a range at which there are more: no task holds a whole source.
LINE_PARTS, PART_ROWS = 4096, 1 << 16
#: Intensities at evenly spaced times for the 1st, 2nd, 3rd, 4th, ... source in turn.
SCHEDULES: tuple[tuple[float, ...], ...] = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """From a row a source (key, source, source_size): its weight, rank and target.

    Targets share the total by weight, none above ``cap`` times its source.
    Sources whose cap is soonest reached come first; the first count of capped
    sources at which the rest stay under theirs gives the common level. All
    windows are over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn("fits", F.col("left") * F.col("weight") <= cap * F.col("source_size") * F.col("left_weight"))
    level = F.max(F.when(F.col("fits"), F.struct("left_weight", "left"))).over(every)
    share = level["left"].cast("double") * F.col("weight") / level["left_weight"]
    return levels.withColumn(
        "target", F.when(F.col("fits") & level.isNotNull(), share).otherwise((cap * F.col("source_size")).cast("double"))
    ).drop("left", "left_weight", "fits")


def due_time(u: Column, intensities: Sequence[float]) -> Column:
    """The time by which a part ``u`` (0 to 1) of a source's words is due.

    Intensity is linear between its values at evenly spaced times; the integral
    is inverted piece by piece (a quadratic each).
    """
    n = len(intensities) - 1
    areas = [(a + b) / 2 / n for a, b in zip(intensities, intensities[1:])]
    total, out, done = sum(areas), None, 0.0
    for k, (a, b, area) in enumerate(zip(intensities, intensities[1:], areas)):
        part = F.greatest(u * total - done, F.lit(0.0))  # area wanted within this piece
        slope = (b - a) * n
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * part, F.lit(0.0)))
        step = part / a if slope == 0 else (root - a) / slope
        here = F.lit(k / n) + F.least(step, F.lit(1 / n))
        done += area
        out = F.when(u * total < done, here) if out is None else out.when(u * total < done, here)
    return out.otherwise(F.lit(1.0))


def scheduled(u: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """``due_time`` by the schedule of the row's source (its ``rank``, in turn)."""
    out = None
    for k, schedule in enumerate(schedules):
        mine = F.col("rank") % len(schedules) == k
        out = F.when(mine, due_time(u, schedule)) if out is None else out.when(mine, due_time(u, schedule))
    return out


def curriculum_mix(
    docs: DataFrame,
    ws: Workspace,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    whole_documents: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """A row a document: ``row`` (struct of the columns in ``keep``; all, if None), size, source_size, target, taken, position, and rank, at, drawn, id.

    ``taken`` counts the words that the mix takes, repeats included: the whole
    passes over the source, and this document's words within the last part. The
    document at the end of the part gives its first words only, so that a
    source's words equal its target to rounding; with ``whole_documents`` it is
    taken whole if half of it or more is due, else not.
    ``position`` is the time at which the source's demand, integrated over its
    schedule, first reaches the document's middle; null if that is never.

    Only one small row a document moves besides ``keep``; the sources' lines are
    cut into ranges of the hash, whose sums give each range its place.
    """
    kept = docs.columns if keep is None else list(keep)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = ws.save(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            F.col(id_col).alias("id"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), text).cast("binary")).alias("drawn"),  # rows without an id are drawn by their text
        ),
        "sized",
    )
    bits = max(LINE_PARTS.bit_length() - 1, (sized.count() // PART_ROWS).bit_length())
    sized = sized.withColumn("part", F.shiftright(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = sized.groupBy("key", "part").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sums = ws.save(sums, "sums")
    sources = sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    aims = ws.save(targets(sources, weights, cap), "targets").drop("source")
    upto = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("key", "part", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("begin"))
    places = begins.join(aims, "key")

    in_part = Window.partitionBy("key", "part").orderBy("drawn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = sized.withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    joined = lined.join(places, ["key", "part"]).withColumn("at", F.col("begin") + F.col("before"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    joined = joined.withColumn("passes", passes.cast("long"))
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    part = F.least(F.greatest(rest - F.col("at"), F.lit(0)), F.col("size"))
    if whole_documents:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    joined = joined.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    return joined.select(
        "row", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, scheduled(demanded(F.lit(0)), schedules)).alias("position"), "rank", "at", "drawn", "id",
    )


def demanded(copy: Column) -> Column:
    """The share of its source's demand that stands before the middle of a document's copy."""
    before = copy * F.col("source_size") + F.col("at")
    return F.least((before.cast("double") + F.col("size") / 2) / F.col("target"), F.lit(1.0))


def with_places(mixed: DataFrame, ws: Workspace) -> DataFrame:
    """Adds ``place``: a document's rank (from 1) by its first position in training, null if it isn't taken.

    Documents are range-sorted by position and written; the counts of the
    ranges, one row each, give every range its first place.
    """
    order = ["position", "drawn", "id", "size"]
    spread = mixed.where("taken > 0").repartitionByRange(shuffle_parts(ws.spark), *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = ws.save(spread.withColumn("range", F.spark_partition_id()).withColumn("within", within), "spread")
    counts = spread.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    taken = spread.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("within") + 1)
    left = mixed.where("taken = 0").withColumn("place", F.lit(None).cast("long"))
    return taken.select(*mixed.columns, "place").unionByName(left)


def training_order(mixed: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, partitions: int | None = None) -> DataFrame:
    """A row each time a document is due, range-sorted by position: row, copy, words, position.

    Every copy but the last is whole; ``words`` says how many words of the last
    are taken. The sort is by position and splits on its quantiles, so no
    source or copy count makes one partition larger than another.
    """
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = mixed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)))).withColumn(
        "words", F.least(F.col("taken") - F.col("copy") * F.col("size"), F.col("size"))
    )
    rows = rows.withColumn("position", scheduled(demanded(F.col("copy")), schedules))
    spread = rows.repartitionByRange(partitions, "position") if partitions else rows.repartitionByRange("position")
    return spread.sortWithinPartitions("position").select("row", "copy", "words", "position")


def due_time_sql(u: str, intensities: Sequence[float]) -> str:
    """``due_time`` in SQL."""

    def d(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    n = len(intensities) - 1
    areas = [(a + b) / 2 / n for a, b in zip(intensities, intensities[1:])]
    total, whens, done = sum(areas), [], 0.0
    for k, (a, b, area) in enumerate(zip(intensities, intensities[1:], areas)):
        part, slope = f"greatest({u} * {d(total)} - {d(done)}, {d(0.0)})", (b - a) * n
        root = f"sqrt(greatest({d(a * a)} + {d(2 * slope)} * {part}, {d(0.0)}))"
        step = f"{part} / {d(a)}" if slope == 0 else f"({root} - {d(a)}) / {d(slope)}"
        done += area
        whens.append(f"WHEN {u} * {d(total)} < {d(done)} THEN {d(k / n)} + least({step}, {d(1 / n)})")
    return f"CASE {' '.join(whens)} ELSE {d(1.0)} END"


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS drawn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), levels AS (
  SELECT *,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS left_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM weighed
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fitting AS (
  SELECT *, left_words * weight <= 3 * source_size * left_weight AS fits FROM levels
), level AS (
  SELECT arg_max(left_words, left_weight) AS lw, max(left_weight) AS ww FROM fitting WHERE fits
), aims AS (
  SELECT source, source_size, rank,
         CASE WHEN fits THEN CAST(lw AS DOUBLE) * weight / ww ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM fitting, level
), lined AS (
  SELECT s.doc_id, s.size, s.drawn, a.source_size, a.target, a.rank,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.drawn, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), told AS (
  SELECT doc_id, size, drawn, source_size, target, rank,
         CAST(passes * size + least(greatest(CAST(round(target - passes * source_size) AS BIGINT) - begins, 0), size) AS BIGINT) AS taken,
         least((CAST(begins AS DOUBLE) + CAST(size AS DOUBLE) / 2) / target, CAST(1 AS DOUBLE)) AS u
  FROM lined
), timed AS (
  SELECT *, CASE WHEN taken > 0 THEN CASE rank % 3 {schedules} END END AS position FROM told
)
SELECT doc_id, size, source_size, target, taken, position,
       CASE WHEN taken > 0 THEN row_number() OVER (ORDER BY position NULLS LAST, drawn, doc_id, size) END AS place
FROM timed
""".replace("{schedules}", " ".join(f"WHEN {k} THEN {due_time_sql('u', schedule)}" for k, schedule in enumerate(SCHEDULES)))
