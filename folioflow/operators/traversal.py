"""Reading order, positions and pruning over the ``nodes`` table.

``(scope, ord)`` is the full walk's order: scope 0 is the body, 1 + i the i-th
footnote, and comparing ``ord`` arrays is pre-order. Positions are windows in
one document; all share the partitioning by ``doc_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = ("doc_key", "scope")


def walk_full(nodes: DataFrame) -> DataFrame:
    """The body, then each footnote's content in pool order, numbered from 1 in a document."""
    return nodes.withColumn("walk_order", F.row_number().over(Window.partitionBy("doc_key").orderBy("scope", "ord")))


def walk_body(nodes: DataFrame) -> DataFrame:
    return walk_full(nodes.where("scope = 0"))


# The field that holds the nodes within each type of node.
FIELD_OF = {"heading": "children", "quote": "children", "figure": "children", "admonition": "children", "list": "items", "terms": "items", "table": "cells", "layout": "cells"}


def with_parent(nodes: DataFrame) -> DataFrame:
    """Adds parent_id, null at the top."""
    # a file of arrays is far smaller than its rows, so that the planner would broadcast millions of them: here and in slots they are merged
    up = nodes.select(*DOC, F.col("ord").alias("parent_ord"), F.col("node_id").alias("parent_id"))
    return nodes.join(up.hint("merge"), [*DOC, "parent_ord"], "left")


def slots(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_key, scope, ord, node_id, field, entry, n_nodes): every place that holds nodes, empty ones too; entry is null for children."""
    field = F.element_at(F.create_map(*[F.lit(x) for item in FIELD_OF.items() for x in item]), F.col("type"))
    holders = nodes.select(*DOC, "ord", "node_id", field.alias("field")).where("field is not null")
    many = holders.where("field <> 'children'").join(entries.select(*DOC, "ord", "entry").hint("merge"), [*DOC, "ord"])
    one = holders.where("field = 'children'").withColumn("entry", F.lit(None).cast("int"))
    held = nodes.where("parent_ord is not null").groupBy(*DOC, F.col("parent_ord").alias("ord"), F.coalesce("slot_index", F.lit(-1)).alias("at")).agg(F.count("*").alias("n"))
    places = one.unionByName(many).withColumn("at", F.coalesce("entry", F.lit(-1)))
    return places.join(held.hint("merge"), [*DOC, "ord", "at"], "left").select(*DOC, "ord", "node_id", "field", "entry", F.coalesce("n", F.lit(0)).alias("n_nodes"))


def prefixes(nodes: DataFrame, name: str) -> DataFrame:
    """A row for each proper prefix of a node's ``ord``: as many as the node is deep."""
    inner = nodes.where(F.size("ord") > 1)
    return inner.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.size("ord") - 1), lambda n: F.slice("ord", 1, n))))


def walk_subtree(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """The nodes under each row of ``root`` (doc_key, scope, ord): their order and depth counted from it.

    A node's prefixes, as many as it is deep, meet the roots in a join on equal keys.
    """
    r = root.select(*DOC, F.col("ord").alias("root_ord"))
    keyed = prefixes(nodes, "root_ord").join(r, [*DOC, "root_ord"], "left_semi")
    base = Window.partitionBy(*DOC, "root_ord")
    return keyed.withColumn("walk_order", F.row_number().over(base.orderBy("ord"))).withColumn("rel_depth", F.col("depth") - F.min("depth").over(base))


def positions(nodes: DataFrame) -> DataFrame:
    """Adds doc_, sibling_ and page_ index and count; page positions are null without a page."""
    doc, page = Window.partitionBy(*DOC), Window.partitionBy(*DOC, "page")
    sib = Window.partitionBy(*DOC, "parent_ord", "slot", "slot_index")
    paged = F.col("page").isNotNull()
    count = F.count(F.lit(1))
    return nodes.select(
        "*",
        F.row_number().over(doc.orderBy("ord")).alias("doc_index"), count.over(doc).alias("doc_count"),
        F.row_number().over(sib.orderBy("ord")).alias("sibling_index"), count.over(sib).alias("sibling_count"),
        F.when(paged, F.row_number().over(page.orderBy("ord"))).alias("page_index"), F.when(paged, count.over(page)).alias("page_count"),
    )


def prune_depth(placed: DataFrame, max_depth: int) -> DataFrame:
    """Drops deeper nodes; positions were counted before and stay."""
    return placed.where(F.col("depth") <= max_depth)


def prune_below(placed: DataFrame, stop: Column) -> DataFrame:
    """Keeps nodes where ``stop`` holds and drops their descendants; positions stay.

    A node goes if a proper prefix of its ``ord`` is a stop: its prefixes (as many
    as it is deep) meet the stops in a join on equal keys.
    """
    key = [*DOC, "ord"]
    stops = placed.where(F.coalesce(stop, F.lit(False))).select(*DOC, F.col("ord").alias("prefix"))
    inner = prefixes(placed.select(*key), "prefix")
    below = inner.join(stops, [*DOC, "prefix"], "left_semi").select(*key).distinct()
    return placed.join(below, key, "left_anti")


def paginated(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_key, paginated): whether the first node of the full walk has a page; false for an empty document."""
    first = nodes.groupBy("doc_key").agg(F.min_by(F.col("page").isNotNull(), F.struct("scope", "ord")).alias("first"))
    return documents.select("doc_key").join(first, "doc_key", "left").select("doc_key", F.coalesce("first", F.lit(False)).alias("paginated"))


def position_totals(nodes: DataFrame) -> DataFrame:
    """(doc_key, scope, page, n): nodes of each page and, with a null page, of the whole scope."""
    pages = nodes.where("page is not null").groupBy(*DOC, "page").agg(F.count("*").alias("n"))
    return pages.unionByName(nodes.groupBy(*DOC).agg(F.count("*").alias("n")).withColumn("page", F.lit(None).cast("int")))


def expand_headings(nodes: DataFrame) -> DataFrame:
    """Nodes reached from the top through headings only: a converter's blocks, in order.

    A node is one if no proper prefix of its ``ord`` is a node of another type than heading.
    """
    return prune_below(nodes, F.col("type") != "heading")


def plain_parts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_key, scope, ord, plain): each node's own plain text: its texts, a code's or formula's source, an image's alt."""
    own = texts.where("scope is not null").groupBy(*DOC, "ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_index", "value"))), lambda x: F.when(x["value"] != "", x["value"])), " ").alias("own")
    )
    extra = F.coalesce(F.col("plain"), F.when(F.col("type") == "image", F.col("alt")))
    joined = nodes.select(*DOC, "ord", extra.alias("extra")).join(own, [*DOC, "ord"], "left")
    return joined.select(*DOC, "ord", F.array_join(F.transform(F.array("own", "extra"), lambda s: F.when(s != "", s)), " ").alias("plain"))


def blocks_plain(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_key, scope, ord, plain): a node with all below it, in reading order, empties skipped, joined by a blank.

    Each node's text goes to every ancestor (its depth many), then one ordered aggregation.
    """
    parts = plain_parts(nodes, texts).where("plain <> ''")
    spread = parts.select(*DOC, F.col("ord").alias("at"), "plain", F.explode(F.transform(F.sequence(F.lit(1), F.size("ord")), lambda n: F.slice("ord", 1, n))).alias("ord"))
    joined = nodes.select(*DOC, "ord").join(spread, [*DOC, "ord"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("plain").isNotNull(), F.struct("at", "plain"))))
    return joined.groupBy(*DOC, "ord").agg(F.array_join(F.transform(ordered, lambda x: x["plain"]), " ").alias("plain"))
