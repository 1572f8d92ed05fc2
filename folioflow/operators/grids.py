"""Tables and lists: shapes, headers, labels and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_key", "scope", "ord"]
ROW_LABELS_CAP = 20


def table_shape(cells: DataFrame) -> DataFrame:
    """(key, n_rows, n_cols) with spans counted; tables without cells have no row."""
    return cells.groupBy(*KEY).agg(
        F.max(F.col("row") + F.greatest("rowspan", F.lit(1))).alias("n_rows"), F.max(F.col("col") + F.greatest("colspan", F.lit(1))).alias("n_cols")
    )


def header_rows(cells: DataFrame) -> DataFrame:
    """(key, row) of rows whose every cell is a header; row 0 of a table without any header cell."""
    rows = cells.groupBy(*KEY, "row").agg(F.bool_and("is_header").alias("all"), F.bool_or("is_header").alias("any"))
    none = rows.groupBy(*KEY).agg(F.bool_or("any").alias("any")).where("not any").select(*KEY, F.lit(0).alias("row"))
    return rows.where("all").select(*KEY, "row").unionByName(none)


def header_row_text(cells: DataFrame) -> DataFrame:
    """(key, header): cells of the lowest row with any header cell (else row 0), by column, joined by ' | '; null if all are empty."""
    table = Window.partitionBy(*KEY)
    target = F.coalesce(F.min(F.when(F.col("is_header"), F.col("row"))).over(table), F.lit(0))
    mine = cells.withColumn("_target", target).withColumn("_text", F.when((F.col("row") == F.col("_target")) & (F.col("plain") != ""), F.struct("col", "entry", "plain")))
    out = mine.groupBy(*KEY).agg(F.array_sort(F.collect_list("_text")).alias("t"))
    return out.select(*KEY, F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: x["plain"]), " | ")).alias("header"))


def row_labels(cells: DataFrame, cap: int = ROW_LABELS_CAP) -> DataFrame:
    """(key, labels): the first column below the header, ' | ' between, at most ``cap`` and then how many more; null for one column."""
    below = cells.where("col = 0 and plain <> ''").join(header_rows(cells), [*KEY, "row"], "left_anti")
    listed = below.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "entry", "plain"))), lambda x: x["plain"]).alias("t"))
    text = F.when(F.size("t") > cap, F.concat(F.array_join(F.slice("t", 1, cap), " | "), F.lit(" | … (+"), (F.size("t") - cap).cast("string"), F.lit(")"))).otherwise(F.array_join("t", " | "))
    wide = table_shape(cells).where("n_cols >= 2")
    return table_shape(cells).select(*KEY).join(listed.join(wide, KEY).select(*KEY, text.alias("labels")), KEY, "left")


def is_inline_cell(n_children: Column, first_type: Column) -> Column:
    return (n_children == 0) | ((n_children == 1) & first_type.isin("paragraph", "image"))


def wants_inline(kind: Column, mode: str) -> Column:
    return F.lit(mode == "inline") | (F.lit(mode == "auto") & F.coalesce(kind == "content", F.lit(False)))


def holds_several(blocks: DataFrame, group: list[str]) -> DataFrame:
    """(group, several): more than one block that isn't a list, or a list with something after it. Needs ``seq`` and ``type``."""
    last = F.max("seq").over(Window.partitionBy(*group))
    told = blocks.withColumn("_last", last)
    return told.groupBy(*group).agg(((F.count_if(F.col("type") != "list") > 1) | F.bool_or((F.col("type") == "list") & (F.col("seq") < F.col("_last")))).alias("several"))


def checked_ratio(items: DataFrame) -> DataFrame:
    """(key, n_checked, n_items) of lists with any checkbox."""
    g = items.groupBy(*KEY).agg(F.count_if(F.coalesce("checked", F.lit(False))).alias("n_checked"), F.count("*").alias("n_items"), F.bool_or(F.col("checked").isNotNull()).alias("any"))
    return g.where("any").drop("any")


def list_ordinals(items: DataFrame, group: list[str], order: str, number: str, ordered: str) -> DataFrame:
    """Adds ``ordinal``: an override is taken and the count goes on from it; unordered lists have none."""
    w = Window.partitionBy(*group).orderBy(order)
    n = F.row_number().over(w)
    told = items.withColumn("_n", n)
    told = told.withColumn("_base", F.last(F.col(number), ignorenulls=True).over(w)).withColumn("_at", F.last(F.when(F.col(number).isNotNull(), F.col("_n")), ignorenulls=True).over(w))
    return told.withColumn("ordinal", F.when(F.col(ordered), F.coalesce(F.col("_base") + F.col("_n") - F.col("_at"), F.col("_n")))).drop("_n", "_base", "_at")


def heading_numbers(headings: DataFrame, order: list[str], max_level: int) -> DataFrame:
    """Adds ``number``: a counter a level, each heading resetting the deeper ones, joined by dots; a skipped level shows 0.

    A level's counter is how many of its headings came since the last of a lower
    level: for each level a running count within a running count.
    """
    doc = Window.partitionBy("doc_key").orderBy(*order)
    out, parts = headings, []
    for k in range(1, max_level + 1):
        out = out.withColumn(f"_g{k}", F.count_if(F.col("level") < k).over(doc))
        out = out.withColumn(f"_c{k}", F.count_if(F.col("level") == k).over(Window.partitionBy("doc_key", f"_g{k}").orderBy(*order)))
        parts.append(F.col(f"_c{k}").cast("string"))
    number = F.array_join(F.slice(F.array(*parts), 1, F.col("level")), ".")
    return out.withColumn("number", number).drop(*[f"_{x}{k}" for k in range(1, max_level + 1) for x in "gc"])


def figure_kind(kind: Column, first_child: Column) -> Column:
    return F.coalesce(F.when(kind != "", kind), first_child, F.lit("figure"))


def running_number(rows: DataFrame, group: list[str], order: list[str], pattern: str = "%d") -> DataFrame:
    """Adds ``number``: the rank in the group, formatted (figures by kind; formulas as '(%d)')."""
    return rows.withColumn("number", F.format_string(pattern, F.row_number().over(Window.partitionBy(*group).orderBy(*order))))


def grid_markdown(cells: DataFrame) -> DataFrame:
    """(key, grid): a pipe table; of two cells at one place the last wins, spans leave blanks.

    The dense rows and columns are generated inside each table's row, so no grid
    of all tables is ever joined.
    """
    flat = F.regexp_replace(F.regexp_replace(F.replace("plain", F.lit("|"), F.lit("\\|")), "\r\n|\r", "\n"), "\n", "<br>")
    t = cells.groupBy(*KEY).agg(
        F.max(F.col("row") + F.col("rowspan") - 1).alias("r"), F.max(F.col("col") + F.col("colspan") - 1).alias("c"),
        F.coalesce(F.min(F.when(F.col("is_header"), F.col("row"))), F.lit(0)).alias("h"),
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "entry", flat.alias("t")))), lambda x: F.struct(F.struct(x["row"], x["col"], x["entry"]), x["t"]))).alias("m"),
        F.collect_list(F.struct("row", "col", "entry")).alias("at"),
    )
    last = lambda i, j: F.array_max(F.filter("at", lambda x: (x["row"] == i) & (x["col"] == j)))
    text = lambda i, j: F.coalesce(F.element_at("m", last(i, j)), F.lit(""))
    line = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: text(i, j)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("c") + 1), " | "), F.lit(" |"))
    rows = F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: F.when(i == F.col("h"), F.concat(line(i), F.lit("\n"), rule)).otherwise(line(i)))
    return t.select(*KEY, F.array_join(rows, "\n").alias("grid"))
