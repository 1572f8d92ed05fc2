"""Labels, edges and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILY_RANK = {"refs": 0, "cites": 1, "footnotes": 2, "links": 3}
DOMAINS = {"refs": "node", "cites": "bibliography", "footnotes": "footnote"}


def family_rank(family: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in FAMILY_RANK.items() for x in item]), family)


def claims(nodes: DataFrame, bibliography: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Everything with an id, in the order of claiming: nodes in walk order, bibliography, footnotes."""
    node = nodes.select("doc_key", F.lit(0).alias("rank"), "scope", "ord", F.col("node_id").alias("id"), "label", F.col("type").alias("owner_type"), F.lit("node").alias("domain"))
    pool = lambda df, rank, name: df.select(
        "doc_key", F.lit(rank).alias("rank"), F.lit(0).alias("scope"), F.array("pool_index").alias("ord"), "id", "label", F.lit(f"{name} entry" if rank == 1 else name).alias("owner_type"), F.lit(name).alias("domain")
    )
    return node.unionByName(pool(bibliography, 1, "bibliography")).unionByName(pool(footnotes, 2, "footnote"))


def label_index(claimed: DataFrame) -> DataFrame:
    """(doc_key, label, target...): the first claimant of each label. An aggregate: sums before it moves."""
    first = F.min_by(F.struct("id", "owner_type", "domain"), F.struct("rank", "scope", "ord"))
    return claimed.where("label is not null").groupBy("doc_key", "label").agg(first.alias("t")).select(
        "doc_key", "label", F.col("t.id").alias("target_id"), F.col("t.owner_type").alias("target_type"), F.col("t.domain").alias("target_domain")
    )


def resolve(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Every edge with its target, or nulls; links have none."""
    return edges.join(index, ["doc_key", "label"], "left")


def incoming(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_key, label, owner, seen): distinct nodes whose own texts point at a label, in order of first sight."""
    from_nodes = edges.where("scope is not null and family <> 'links'").withColumn("family_rank", family_rank(F.col("family")))
    first = from_nodes.groupBy("doc_key", "label", "owner").agg(F.min(F.struct("scope", "ord", "text_index", "family_rank", "edge_index")).alias("at"))
    found = first.join(index.select("doc_key", "label"), ["doc_key", "label"], "left_semi")
    order = Window.partitionBy("doc_key", "label").orderBy("at")
    return found.select("doc_key", "label", "owner", F.row_number().over(order).alias("seen"))


def unresolved(edges: DataFrame, index: DataFrame) -> DataFrame:
    return edges.where("family <> 'links'").join(index, ["doc_key", "label"], "left_anti")


def wrong_domain(edges: DataFrame, index: DataFrame) -> DataFrame:
    want = F.element_at(F.create_map(*[F.lit(x) for item in DOMAINS.items() for x in item]), F.col("family"))
    return edges.where("family <> 'links'").join(index, ["doc_key", "label"]).where(F.col("target_domain") != want)


def resolve_markers(edges: DataFrame, index: DataFrame, block: list[str]) -> DataFrame:
    """The edges of each block with their targets, in marker order: by text, span start (spanless last), family."""
    place = F.struct(
        F.coalesce("scope", F.lit(0)), "ord", "text_index", F.col("span").isNull(), F.coalesce(F.get("span", 0), F.lit(0)), family_rank(F.col("family")), "edge_index"
    )
    found = resolve(edges, index)
    return found.withColumn("marker_index", F.row_number().over(Window.partitionBy(*block).orderBy(place))).withColumn(
        "warned", (F.col("family") != "links") & (F.col("target_id").isNull() | (F.col("target_domain") != F.element_at(F.create_map(*[F.lit(x) for i in DOMAINS.items() for x in i]), F.col("family"))))
    )


def cited_by(index: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_key, label, n_sources): distinct nodes that point at each pool entry; entries without any have 0."""
    used = edges.where("scope is not null and family <> 'links'").select("doc_key", "label", "owner")
    pool = index.where("target_domain <> 'node'").select("doc_key", "label")
    return pool.join(used, ["doc_key", "label"], "left").groupBy("doc_key", "label").agg(F.countDistinct("owner").alias("n_sources"))
