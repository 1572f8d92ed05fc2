"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.cli import content_hashes, json_lines
from folioflow.functions import scalars as S
from folioflow.operators import grids, links, match, traversal, validate
from folioflow.plans import adapters as A
from folioflow.plans.model import VERSION_RULE
from folioflow.plans.stage import cut
from folioflow.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the shared tables it names as common table expressions of its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return add


SHARED = {
    "tree_nodes": A.NODES, "new_nodes": A.NEW_NODES, "tree_edges": A.EDGES, "tree_marks": A.MARKS, "bib": A.BIBLIOGRAPHY, "new_bib": A.NEW_BIBLIOGRAPHY,
    "notes": A.FOOTNOTES, "docs": A.DOCUMENTS, "cells": A.CELLS, "items": A.ITEMS, "turns": A.TURNS,
    "parts": A.as_rows(A.PARTS, "n, scope, path, parent, type, field, entry, above, own_json"), "part_slots": A.as_rows(A.SLOTS, "owner, field, entry, n_nodes"),
    "part_texts": A.as_rows(A.TEXTS, "owner, role, place, value"), "part_edges": A.as_rows(A.LINKED, "owner, role, family, place, target, s0, s1"),
}
CLAIMS = """
SELECT doc_key, 0 AS rank, scope, o1, o2, node_id AS id, label, type AS owner_type, 'node' AS domain FROM tree_nodes
UNION ALL SELECT doc_key, 1, 0, pool_index, -1, id, label, 'bibliography entry', 'bibliography' FROM bib
UNION ALL SELECT doc_key, 2, 0, pool_index, -1, id, label, 'footnote', 'footnote' FROM notes
"""
INDEX = "SELECT doc_key, label, arg_min({'id': id, 't': owner_type, 'd': domain}, rank * 1000000000000 + scope * 100000000000 + CAST(o1 AS BIGINT) * 100000 + o2 + 1) AS t FROM claims WHERE label IS NOT NULL GROUP BY 1, 2"
INDEXED = "SELECT doc_key, label, t.id AS target_id, t.t AS target_type, t.d AS target_domain FROM idx0"


def with_tables(sql: str) -> str:
    used = dict(SHARED) | {"claims": CLAIMS, "idx0": INDEX, "idx": INDEXED}
    need: list[str] = []

    def visit(text: str) -> None:
        for name in used:
            if name not in need and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                visit(used[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({used[n]})" for n in need)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"


def T(spark, d, sql):
    return A.frame(spark, d, sql)


# --- sources and the flagship ------------------------------------------------


@query("min_slice", """
SELECT doc_key, o1 + 1 AS doc_index, count(*) OVER (PARTITION BY doc_key) AS doc_count, concat('nodes/', o1) AS path,
       concat('sha256:', sha256(concat('{"text":{"value":', CAST(to_json(nfc_normalize(value)) AS VARCHAR), '},"type":"paragraph"}'))) AS node_hash FROM turns""")
def min_slice(spark, d):
    t = T(spark, d, A.TURNS)
    placed = traversal.positions(t.select("doc_key", F.lit(0).alias("scope"), F.array("o1").alias("ord"), F.lit(None).cast("array<int>").alias("parent_ord"), F.lit("nodes").alias("slot"), F.lit(None).cast("int").alias("slot_index"), F.lit(None).cast("int").alias("page"), "value", "o1"))
    return placed.select("doc_key", "doc_index", "doc_count", F.concat(F.lit("nodes/"), F.col("o1").cast("string")).alias("path"), S.paragraph_hash(F.col("value")).alias("node_hash"))


#: Files made of events: every fifth is whole, the others are cut short, of another version, without a title, or hold a node of no known type.
RAW_EVENTS = """
SELECT CAST(event_id AS STRING) AS doc_key, CASE event_id % 5 WHEN 1 THEN substr(raw, 1, length(raw) - 3) WHEN 2 THEN replace(raw, '0.5.0', '0.4.0') WHEN 3 THEN replace(raw, 'title', 'titel') WHEN 4 THEN replace(raw, 'paragraph', 'paragraf') ELSE raw END AS raw
FROM (SELECT event_id, concat('{"cnd_version":"0.5.0","built_at":"2024-01-01T00:00:00+00:00","doc":{"title":"', event_type, '"},"nodes":[{"id":"00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0'), '","type":"paragraph","text":{"value":"', event_type, '"}}]}') AS raw FROM events) e
"""


def parsed_events(spark, d):
    return documents.parse(T(spark, d, RAW_EVENTS))


@query("src_cnd_json", "SELECT CAST(event_id AS VARCHAR) AS doc_key, event_type AS title, 1 AS n_nodes, event_type AS first_text FROM events WHERE event_id % 5 = 0")
def src_cnd_json(spark, d):
    c = documents.corpus(cut(parsed_events(spark, d)))
    n = c.nodes.groupBy("doc_key").agg(F.count("*").alias("n_nodes"))
    return c.documents.select("doc_key", "title").join(n, "doc_key").join(c.texts.select("doc_key", F.col("value").alias("first_text")), "doc_key")


@query("src_bad_record", "SELECT CAST(event_id AS VARCHAR) AS doc_key, CASE event_id % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'cnd-version-unsupported' WHEN 3 THEN 'doc.title' ELSE 'nodes/0' END AS cause FROM events WHERE event_id % 5 > 0")
def src_bad_record(spark, d):
    return documents.errors(parsed_events(spark, d)).select("doc_key", F.split("reason", ":")[0].alias("cause"))


@query("src_version_gate", "SELECT CAST(event_id AS VARCHAR) AS doc_key, '0.4.0' AS found FROM events WHERE event_id % 5 = 2")
def src_version_gate(spark, d):
    bad = documents.errors(parsed_events(spark, d)).where(F.startswith("reason", F.lit(VERSION_RULE)))
    return bad.select("doc_key", F.trim(F.split("reason", ":")[1]).alias("found"))


@query("sink_report_json", "SELECT concat('{\"doc_key\":', doc_key, ',\"seq\":1,\"rule\":\"cnd-version-unsupported\",\"location\":\"cnd_version ', version, '\",\"message\":\"only version 0.5.0 is read\"}') AS line FROM docs WHERE version <> '0.5.0'")
def sink_report_json(spark, d):
    return json_lines(validate.validate(A.corpus(spark, d)).where("seq = 1 and rule = 'cnd-version-unsupported'"))


# --- traversal ---------------------------------------------------------------

WALK = "row_number() OVER (PARTITION BY doc_key ORDER BY scope, o1, o2)"


@query("walk_body", f"SELECT doc_key, node_id, {WALK} AS walk_order, path, depth FROM tree_nodes WHERE scope = 0")
def walk_body(spark, d):
    return traversal.walk_body(A.nodes(spark, d)).select("doc_key", "node_id", "walk_order", "path", "depth")


QUERIES["walk_default"], ORACLE_SQL["walk_default"] = QUERIES["walk_body"], ORACLE_SQL["walk_body"]


@query("walk_full", f"SELECT doc_key, scope, node_id, {WALK} AS walk_order, path FROM tree_nodes")
def walk_full(spark, d):
    return traversal.walk_full(A.nodes(spark, d)).select("doc_key", "scope", "node_id", "walk_order", "path")


@query("walk_subtree", "SELECT doc_key, scope, o1 AS root, node_id, row_number() OVER (PARTITION BY doc_key, scope, o1 ORDER BY o2) AS walk_order FROM tree_nodes WHERE depth = 1")
def walk_subtree(spark, d):
    n = A.nodes(spark, d)
    return traversal.walk_subtree(n, n.where("depth = 0")).select("doc_key", "scope", F.get("root_ord", 0).alias("root"), "node_id", "walk_order")


def whole(spark, d, only, once=False):
    """Files with nodes of every type, read back as tables with the fields named by ``only``; not written in between where ``once`` says that one of them is read, once."""
    parsed = documents.parse(A.whole_documents(spark, d), only)
    return documents.corpus(parsed if once else cut(parsed))


@query("whole_walk", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, scope, {A.id_of('n')} AS node_id, type, path, n - CASE WHEN scope = 0 THEN 0 ELSE 24 END AS doc_index, CASE WHEN scope = 0 THEN 24 ELSE 1 END AS doc_count FROM parts")
def whole_walk(spark, d):
    return traversal.positions(whole(spark, d, "nodes.scope nodes.ord nodes.node_id nodes.type nodes.path nodes.page nodes.parent_ord nodes.slot nodes.slot_index", once=True).nodes).select("doc_key", "scope", "node_id", "type", "path", "doc_index", "doc_count")


@query("slots", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, {A.id_of('owner')} AS node_id, field, entry, n_nodes FROM part_slots")
def slots(spark, d):
    c = whole(spark, d, "nodes.scope nodes.ord nodes.node_id nodes.type nodes.parent_ord nodes.slot_index entries.scope entries.ord entries.entry")
    return traversal.slots(c.nodes, c.entries).select("doc_key", "node_id", "field", "entry", "n_nodes")


@query("path_depth_parent", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, {A.id_of('n')} AS node_id, path, len(regexp_extract_all(path, '(children|items|cells)/')) - len(regexp_extract_all(path, '(items|cells)/')) - scope AS depth, CASE WHEN parent IS NOT NULL THEN {A.id_of('parent')} END AS parent_id, field AS slot, entry AS slot_index FROM parts")
def path_depth_parent(spark, d):
    return traversal.with_parent(whole(spark, d, "nodes.scope nodes.ord nodes.node_id nodes.path nodes.depth nodes.parent_ord nodes.slot nodes.slot_index").nodes).select("doc_key", "node_id", "path", "depth", "parent_id", "slot", "slot_index")


@query("ctx_heading_path", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, {A.id_of('n')} AS node_id, above AS heading_path FROM parts")
def ctx_heading_path(spark, d):
    return whole(spark, d, "nodes.node_id nodes.ctx_heading_path", once=True).nodes.select("doc_key", "node_id", F.array_join("ctx_heading_path", "/").alias("heading_path"))


WHOLE_TEXTS = " ".join(f"{place} {text}.role {text}.text_index {text}.value" for place, text in (("nodes.scope nodes.ord nodes.node_id", "nodes.texts"), ("bibliography.pool_index bibliography.id", "bibliography.formatted")))


@query("whole_texts", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, {A.id_of('owner')} AS owner, role, place AS text_index, value FROM part_texts")
def whole_texts(spark, d):
    return whole(spark, d, WHOLE_TEXTS, once=True).texts.where("scope is not null").select("doc_key", "owner", "role", "text_index", "value")


@query("whole_edges", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, {A.id_of('owner')} AS owner, role, family, place AS edge_index, target, s0, s1 FROM part_edges")
def whole_edges(spark, d):
    return whole(spark, d, f"{WHOLE_TEXTS} nodes.texts.edges bibliography.formatted.edges").edges.select("doc_key", "owner", "role", "family", "edge_index", F.coalesce("label", "href").alias("target"), F.get("span", 0).alias("s0"), F.get("span", 1).alias("s1"))


POSITIONS = """SELECT doc_key, node_id, depth, row_number() OVER (PARTITION BY doc_key, scope ORDER BY o1, o2) AS doc_index, count(*) OVER (PARTITION BY doc_key, scope) AS doc_count,
 row_number() OVER (PARTITION BY doc_key, scope, depth, CASE WHEN depth = 1 THEN o1 END ORDER BY o1, o2) AS sibling_index, count(*) OVER (PARTITION BY doc_key, scope, depth, CASE WHEN depth = 1 THEN o1 END) AS sibling_count,
 CASE WHEN page IS NOT NULL THEN row_number() OVER (PARTITION BY doc_key, scope, page ORDER BY o1, o2) END AS page_index, CASE WHEN page IS NOT NULL THEN count(*) OVER (PARTITION BY doc_key, scope, page) END AS page_count
 FROM tree_nodes"""
for _name, _cols in {"pos_doc": ["doc_index", "doc_count"], "pos_sibling": ["sibling_index", "sibling_count"], "pos_page": ["page_index", "page_count"]}.items():
    query(_name, f"SELECT doc_key, node_id, {', '.join(_cols)} FROM ({POSITIONS}) p")(lambda spark, d, cols=_cols: traversal.positions(A.nodes(spark, d)).select("doc_key", "node_id", *cols))


@query("prune_depth", f"SELECT doc_key, node_id, doc_index, doc_count FROM ({POSITIONS}) p WHERE depth <= 0")
def prune_depth(spark, d):
    return traversal.prune_depth(traversal.positions(A.nodes(spark, d)), 0).select("doc_key", "node_id", "doc_index", "doc_count")


@query("prune_pred", f"SELECT p.doc_key, p.node_id, p.doc_index FROM ({POSITIONS}) p JOIN tree_nodes c ON c.doc_key = p.doc_key AND c.node_id = p.node_id LEFT JOIN tree_nodes u ON c.depth = 1 AND u.depth = 0 AND u.doc_key = c.doc_key AND u.scope = c.scope AND u.o1 = c.o1 WHERE coalesce(u.type, '') <> 'quote'")
def prune_pred(spark, d):
    return traversal.prune_below(traversal.positions(A.nodes(spark, d)), F.col("type") == "quote").select("doc_key", "node_id", "doc_index")


@query("paginated", "SELECT d.doc_key, coalesce(p.f, false) AS paginated FROM docs d LEFT JOIN (SELECT doc_key, arg_min(page IS NOT NULL, scope * 100000000000 + CAST(o1 AS BIGINT) * 100000 + o2 + 1) AS f FROM tree_nodes GROUP BY 1) p ON d.doc_key = p.doc_key")
def paginated(spark, d):
    return traversal.paginated(A.nodes(spark, d), T(spark, d, A.DOCUMENTS))


@query("position_totals", "SELECT doc_key, scope, page, count(*) AS n FROM tree_nodes WHERE page IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT doc_key, scope, NULL, count(*) FROM tree_nodes GROUP BY 1, 2")
def position_totals(spark, d):
    return traversal.position_totals(A.nodes(spark, d)).select("doc_key", "scope", "page", "n")


# --- projections and filters -------------------------------------------------

HAS_TEXT = "type IN ('heading', 'paragraph', 'quote', 'figure')"


@query("texts_of", f"SELECT doc_key, node_id AS owner, 0 AS text_index, value FROM tree_nodes WHERE {HAS_TEXT}")
def texts_of(spark, d):
    return A.corpus(spark, d).texts.where("scope is not null").select("doc_key", "owner", "text_index", "value")


@query("edges_of", "SELECT doc_key, owner, family, coalesce(label, href) AS target, s0, s1 FROM tree_edges")
def edges_of(spark, d):
    return A.edges(spark, d).select("doc_key", "owner", "family", F.coalesce("label", "href").alias("target"), F.get("span", 0).alias("s0"), F.get("span", 1).alias("s1"))


@query("filter_type", "SELECT doc_key, node_id FROM tree_nodes WHERE type = 'figure'")
def filter_type(spark, d):
    return A.nodes(spark, d).where("type = 'figure'").select("doc_key", "node_id")


@query("blocks_plain", f"WITH own AS (SELECT doc_key, scope, o1, o2, CASE WHEN {HAS_TEXT} OR type IN ('math', 'code') THEN value ELSE '' END AS v FROM tree_nodes) SELECT p.doc_key, p.node_id, coalesce(string_agg(CASE WHEN o.v <> '' THEN o.v END, ' ' ORDER BY o.o2), '') AS plain FROM tree_nodes p JOIN own o ON o.doc_key = p.doc_key AND o.scope = p.scope AND o.o1 = p.o1 WHERE p.depth = 0 GROUP BY 1, 2")
def blocks_plain(spark, d):
    c = A.corpus(spark, d)
    n = c.nodes.withColumn("plain", F.when(F.col("type").isin("math", "code"), F.col("value"))).withColumn("alt", F.lit(None).cast("string"))
    return traversal.blocks_plain(n, c.texts).join(n.where("depth = 0").select("doc_key", "scope", "ord", "node_id"), ["doc_key", "scope", "ord"]).select("doc_key", "node_id", "plain")


@query("expand_headings", "SELECT c.doc_key, c.node_id FROM tree_nodes c LEFT JOIN tree_nodes u ON c.depth = 1 AND u.depth = 0 AND u.doc_key = c.doc_key AND u.scope = c.scope AND u.o1 = c.o1 WHERE coalesce(u.type, '') <> 'quote' AND c.scope = 0")
def expand_headings(spark, d):
    return traversal.expand_headings(A.nodes(spark, d).where("scope = 0")).select("doc_key", "node_id")


QUERIES["iter_body"], ORACLE_SQL["iter_body"] = QUERIES["expand_headings"], ORACLE_SQL["expand_headings"]


@query("is_inline_cell", "SELECT doc_key, entry, n_children = 0 OR n_children = 1 AND entry % 2 = 0 AS inline FROM cells")
def is_inline_cell(spark, d):
    first = F.when(F.col("entry") % 2 == 0, "paragraph").otherwise("list")
    return T(spark, d, A.CELLS).select("doc_key", "entry", grids.is_inline_cell(F.col("n_children"), first).alias("inline"))


@query("wants_inline_table", "SELECT p_partkey, coalesce(p_size % 2 = 0, false) AS auto_inline FROM part")
def wants_inline_table(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "content").when(F.col("p_size") % 3 == 0, "data")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", grids.wants_inline(kind, "auto").alias("auto_inline"))


@query("holds_several", "SELECT doc_key, scope, o1, count(*) FILTER (WHERE t <> 'list') > 1 OR bool_or(t = 'list' AND o2 < m) AS several FROM (SELECT *, CASE WHEN k % 5 = 2 THEN 'list' ELSE type END AS t, max(o2) OVER (PARTITION BY doc_key, scope, o1) AS m FROM tree_nodes WHERE depth = 1) x GROUP BY 1, 2, 3")
def holds_several(spark, d):
    n = A.nodes(spark, d).where("depth = 1").withColumn("type", F.when(F.col("k") % 5 == 2, "list").otherwise(F.col("type"))).withColumn("seq", F.col("o2"))
    return grids.holds_several(n, ["doc_key", "scope", "o1"])


@query("infer_fig_kind", "SELECT p_partkey, coalesce(nullif(CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END, ''), CASE WHEN p_size % 2 = 0 THEN 'image' END, 'figure') AS kind FROM part")
def infer_fig_kind(spark, d):
    given = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", grids.figure_kind(given, F.when(F.col("p_size") % 2 == 0, "image")).alias("kind"))


# --- lookups -----------------------------------------------------------------


def index_of(c):
    return links.label_index(links.claims(c.nodes, c.bibliography, c.footnotes))


@query("resolve", "SELECT e.doc_key, e.owner, e.label, i.target_id, i.target_domain FROM tree_edges e LEFT JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label")
def resolve(spark, d):
    c = A.corpus(spark, d)
    return links.resolve(c.edges, index_of(c)).select("doc_key", "owner", "label", "target_id", "target_domain")


@query("incoming", "SELECT e.doc_key, e.label, e.owner, row_number() OVER (PARTITION BY e.doc_key, e.label ORDER BY e.scope, e.o1, e.o2) AS seen FROM tree_edges e JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label WHERE family <> 'links'")
def incoming(spark, d):
    c = A.corpus(spark, d)
    return links.incoming(c.edges, index_of(c))


@query("unresolved", "SELECT e.doc_key, e.owner, e.label FROM tree_edges e LEFT JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label WHERE family <> 'links' AND i.label IS NULL")
def unresolved(spark, d):
    c = A.corpus(spark, d)
    return links.unresolved(c.edges, index_of(c)).select("doc_key", "owner", "label")


@query("wrong_domain", "SELECT e.doc_key, e.owner, e.label, i.target_type FROM tree_edges e JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label WHERE target_domain <> CASE family WHEN 'refs' THEN 'node' WHEN 'cites' THEN 'bibliography' ELSE 'footnote' END")
def wrong_domain(spark, d):
    c = A.corpus(spark, d)
    return links.wrong_domain(c.edges, index_of(c)).select("doc_key", "owner", "label", "target_type")


@query("resolve_markers", "SELECT e.doc_key, e.owner, row_number() OVER (PARTITION BY e.doc_key, e.scope, e.o1 ORDER BY e.o2, s0) AS marker_index, i.target_id, family <> 'links' AND (i.target_id IS NULL OR target_domain <> CASE family WHEN 'refs' THEN 'node' WHEN 'cites' THEN 'bibliography' ELSE 'footnote' END) AS warned FROM tree_edges e LEFT JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label")
def resolve_markers(spark, d):
    c = A.corpus(spark, d)
    return links.resolve_markers(c.edges, index_of(c), ["doc_key", "scope", "o1"]).select("doc_key", "owner", "marker_index", "target_id", "warned")


@query("cited_by", "SELECT i.doc_key, i.label, count(DISTINCT e.owner) AS n_sources FROM idx i LEFT JOIN tree_edges e ON e.doc_key = i.doc_key AND e.label = i.label AND family <> 'links' WHERE target_domain <> 'node' GROUP BY 1, 2")
def cited_by(spark, d):
    c = A.corpus(spark, d)
    return links.cited_by(index_of(c), c.edges)


# --- validation --------------------------------------------------------------

ONE_RULE = {
    "v_version": ("cnd-version-unsupported", "SELECT doc_key, concat('cnd_version ', version) AS location FROM docs WHERE version <> '0.5.0'", lambda c: validate.version(c)),
    "v_id": ("id-not-unique", "SELECT doc_key, concat(owner_type, ' ', id) AS location FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, id ORDER BY rank, scope, o1, o2) AS n FROM claims) x WHERE n > 1", lambda c: validate.unique(c, "id")),
    "v_label": ("label-not-unique", "SELECT doc_key, concat('@', label, ' on ', owner_type, ' ', id) AS location FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, label ORDER BY rank, scope, o1, o2) AS n FROM claims WHERE label IS NOT NULL) x WHERE n > 1", lambda c: validate.unique(c, "label")),
    "v_unresolved": ("link-unresolved", "SELECT e.doc_key, concat('@', e.label, ' on ', e.owner_type, ' ', e.owner) AS location FROM tree_edges e LEFT JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label WHERE family <> 'links' AND i.label IS NULL", lambda c: validate.edge_rules(c)),
    "v_domain": ("link-wrong-domain", "SELECT e.doc_key, concat('@', e.label, ' on ', e.owner_type, ' ', e.owner) AS location FROM tree_edges e JOIN idx i ON e.doc_key = i.doc_key AND e.label = i.label WHERE target_domain <> CASE family WHEN 'refs' THEN 'node' WHEN 'cites' THEN 'bibliography' ELSE 'footnote' END", lambda c: validate.edge_rules(c)),
    "v_span": ("text-span-out-of-bounds", "SELECT e.doc_key, concat('@', coalesce(e.label, e.href), ' on ', e.owner_type, ' ', e.owner) AS location FROM tree_edges e WHERE NOT (0 <= s0 AND s0 <= s1 AND s1 <= length)", lambda c: validate.edge_rules(c)),
    "v_mark_bounds": ("mark-out-of-bounds", "SELECT doc_key, concat(owner_type, ' ', owner) AS location FROM tree_marks WHERE NOT (0 <= s AND s < e AND e <= length)", lambda c: validate.mark_rules(c)),
    "v_mark_order": ("mark-not-canonical", "SELECT a.doc_key, concat(a.owner_type, ' ', a.owner) AS location FROM tree_marks a JOIN tree_marks b ON a.doc_key = b.doc_key AND a.owner = b.owner AND a.mark_index = 0 AND b.mark_index = 1 WHERE (a.s, a.e, a.kind) > (b.s, b.e, b.kind)", lambda c: validate.mark_rules(c)),
    "v_mark_merge": ("mark-same-kind-overlap", "SELECT a.doc_key, concat(a.owner_type, ' ', a.owner) AS location FROM tree_marks a JOIN tree_marks b ON a.doc_key = b.doc_key AND a.owner = b.owner AND a.mark_index = 0 AND b.mark_index = 1 AND a.kind = b.kind WHERE CASE WHEN (a.s, a.e) <= (b.s, b.e) THEN b.s <= a.e ELSE a.s <= b.e END", lambda c: validate.mark_rules(c)),
    "v_mark_atomic": ("mark-atomic-crossed", "SELECT a.doc_key, concat(a.owner_type, ' ', a.owner) AS location FROM tree_marks a JOIN (SELECT doc_key, owner, mark_index, s, e FROM tree_marks UNION ALL SELECT doc_key, owner, -1, s0, s1 FROM tree_edges) o ON a.doc_key = o.doc_key AND a.owner = o.owner AND a.mark_index <> o.mark_index WHERE a.kind IN ('code', 'math') AND NOT (o.e <= a.s OR o.s >= a.e) AND NOT (o.s <= a.s AND o.e >= a.e)", lambda c: validate.mark_rules(c)),
    "v_pages": ("pagination-partial", "SELECT doc_key, concat(type, ' ', node_id) AS location FROM (SELECT *, count(page) OVER (PARTITION BY doc_key) AS w, count(*) OVER (PARTITION BY doc_key) - count(page) OVER (PARTITION BY doc_key) AS o FROM tree_nodes) x WHERE w > 0 AND o > 0 AND CASE WHEN o <= w THEN page IS NULL ELSE page IS NOT NULL END", lambda c: validate.pagination(c)),
    "v_bib": ("bib-entry-empty", "SELECT doc_key, concat('@', label, ' (bibliography entry ', id, ')') AS location FROM bib WHERE NOT has_fields AND NOT has_formatted", lambda c: validate.empty_entries(c)),
    "v_extra": ("doc-extra-shadows-field", "SELECT doc_key, 'doc.extra[''lang'']' AS location FROM docs WHERE doc_key % 4 = 0", lambda c: validate.extra_keys(c)),
}
for _name, (_rule, _sql, _run) in ONE_RULE.items():
    query(_name, f"SELECT doc_key, '{_rule}' AS rule, location FROM ({_sql}) v")(
        lambda spark, d, rule=_rule, run=_run: run(A.corpus(spark, d)).where(F.col("rule") == rule).select("doc_key", "rule", "location")
    )
ALL_RULES = " UNION ALL ".join(f"SELECT doc_key, '{r}' AS rule, location FROM ({s}) v" for r, s, _ in ONE_RULE.values())


@query("validate", f"SELECT doc_key, rule, count(*) AS n FROM ({ALL_RULES}) a GROUP BY 1, 2")
def validate_all(spark, d):
    return validate.validate(A.corpus(spark, d)).groupBy("doc_key", "rule").agg(F.count("*").alias("n"))


@query("result_ok", f"SELECT d.doc_key, count(a.rule) AS n_violations, count(a.rule) = 0 AS ok FROM docs d LEFT JOIN ({ALL_RULES}) a ON d.doc_key = a.doc_key GROUP BY 1")
def result_ok(spark, d):
    c = A.corpus(spark, d)
    return validate.results(c.documents, validate.validate(c))


QUERIES["atomic_crossed"], ORACLE_SQL["atomic_crossed"] = QUERIES["v_mark_atomic"], ORACLE_SQL["v_mark_atomic"]
QUERIES["same_kind_touch"], ORACLE_SQL["same_kind_touch"] = QUERIES["v_mark_merge"], ORACLE_SQL["v_mark_merge"]
QUERIES["canonical_order"], ORACLE_SQL["canonical_order"] = QUERIES["v_mark_order"], ORACLE_SQL["v_mark_order"]


@query("dup_rank", "SELECT doc_key, id, label, nth, first_id FROM (SELECT *, row_number() OVER w AS nth, first_value(id) OVER w AS first_id FROM claims WHERE label IS NOT NULL WINDOW w AS (PARTITION BY doc_key, label ORDER BY rank, scope, o1, o2)) x WHERE nth > 1")
def dup_rank(spark, d):
    c = A.corpus(spark, d)
    return validate.duplicates(links.claims(c.nodes, c.bibliography, c.footnotes), "label").select("doc_key", "id", "label", "nth", "first_id")


# --- statistics --------------------------------------------------------------


@query("count_types", "SELECT type, count(*) AS n, CAST(round(count(*) * 10000.0 / sum(count(*)) OVER ()) AS BIGINT) AS share_bp FROM tree_nodes GROUP BY 1")
def count_types(spark, d):
    n = A.nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row a type
    return n.select("type", "n", F.round(F.col("n") * 10000.0 / total).cast("long").alias("share_bp"))


@query("summary_stats", "SELECT n.doc_key, n.n_nodes, n.n_types, n.max_depth, coalesce(e.n_refs, 0) AS n_refs FROM (SELECT doc_key, count(*) AS n_nodes, count(DISTINCT type) AS n_types, max(depth) AS max_depth FROM tree_nodes GROUP BY 1) n LEFT JOIN (SELECT doc_key, count(*) AS n_refs FROM tree_edges WHERE family <> 'links' GROUP BY 1) e ON n.doc_key = e.doc_key")
def summary_stats(spark, d):
    n = A.nodes(spark, d).groupBy("doc_key").agg(F.count("*").alias("n_nodes"), F.countDistinct("type").alias("n_types"), F.max("depth").alias("max_depth"))
    e = A.edges(spark, d).where("family <> 'links'").groupBy("doc_key").agg(F.count("*").alias("n_refs"))
    return n.join(e, "doc_key", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))


@query("mark_kinds", "SELECT a.doc_key, a.owner, CASE WHEN a.kind = b.kind THEN a.kind ELSE concat(a.kind, ',', b.kind) END AS kinds FROM tree_marks a JOIN tree_marks b ON a.doc_key = b.doc_key AND a.owner = b.owner AND a.mark_index = 0 AND b.mark_index = 1")
def mark_kinds(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("text_index", "mark_index", "kind"))), lambda x: x["kind"])
    return A.corpus(spark, d).marks.groupBy("doc_key", "owner").agg(F.array_join(F.array_distinct(listed), ",").alias("kinds"))


@query("checked_ratio", "SELECT doc_key, count(*) FILTER (WHERE checked) AS n_checked, count(*) AS n_items FROM items GROUP BY 1 HAVING bool_or(checked IS NOT NULL)")
def checked_ratio(spark, d):
    return grids.checked_ratio(T(spark, d, A.ITEMS).withColumn("ord", F.array(F.lit(0)))).select("doc_key", "n_checked", "n_items")


def cells_of(spark, d):
    return T(spark, d, A.CELLS).withColumn("ord", F.array(F.lit(0)))


SHAPE = 'SELECT doc_key, CAST(max("row" + rowspan) AS INT) AS n_rows, CAST(max("col" + colspan) AS INT) AS n_cols FROM cells GROUP BY 1'
HEADERS = 'SELECT doc_key, "row" FROM cells GROUP BY 1, 2 HAVING bool_and(is_header) UNION ALL SELECT doc_key, 0 FROM cells GROUP BY 1 HAVING NOT bool_or(is_header)'


@query("table_shape", SHAPE)
def table_shape(spark, d):
    return grids.table_shape(cells_of(spark, d)).select("doc_key", "n_rows", "n_cols")


@query("header_rows", f'SELECT doc_key, "row" FROM ({HEADERS}) h')
def header_rows(spark, d):
    return grids.header_rows(cells_of(spark, d)).select("doc_key", "row")


@query("header_row_text", "SELECT doc_key, string_agg(CASE WHEN plain <> '' AND \"row\" = t THEN plain END, ' | ' ORDER BY \"col\") AS header FROM (SELECT *, coalesce(min(CASE WHEN is_header THEN \"row\" END) OVER (PARTITION BY doc_key), 0) AS t FROM cells) x GROUP BY 1")
def header_row_text(spark, d):
    return grids.header_row_text(cells_of(spark, d)).select("doc_key", "header")


@query("row_labels", f"""WITH h AS ({HEADERS}), l AS (SELECT c.doc_key, c.plain, row_number() OVER (PARTITION BY c.doc_key ORDER BY c."row") AS n, count(*) OVER (PARTITION BY c.doc_key) AS m FROM cells c LEFT JOIN h ON c.doc_key = h.doc_key AND c."row" = h."row" WHERE h.doc_key IS NULL AND "col" = 0 AND plain <> '')
SELECT s.doc_key, CASE WHEN s.n_cols >= 2 THEN g.t END AS labels FROM ({SHAPE}) s LEFT JOIN (SELECT doc_key, concat(string_agg(CASE WHEN n <= 20 THEN plain END, ' | ' ORDER BY n), CASE WHEN max(m) > 20 THEN concat(' | … (+', max(m) - 20, ')') ELSE '' END) AS t FROM l GROUP BY 1) g ON s.doc_key = g.doc_key""")
def row_labels(spark, d):
    return grids.row_labels(cells_of(spark, d)).select("doc_key", "labels")


@query("md_table", """WITH g AS (SELECT doc_key, max("row" + rowspan - 1) AS r, max("col" + colspan - 1) AS c, coalesce(min(CASE WHEN is_header THEN "row" END), 0) AS h FROM cells GROUP BY 1),
p AS (SELECT doc_key, h, c, i, unnest(range(0, c + 1)) AS j FROM (SELECT doc_key, h, c, unnest(range(0, r + 1)) AS i FROM g) x),
l AS (SELECT p.doc_key, p.h, p.c, p.i, concat('| ', string_agg(coalesce(replace(k.plain, '|', chr(92) || '|'), ''), ' | ' ORDER BY p.j), ' |') AS t FROM p LEFT JOIN cells k ON k.doc_key = p.doc_key AND k."row" = p.i AND k."col" = p.j GROUP BY 1, 2, 3, 4)
SELECT doc_key, string_agg(CASE WHEN i = h THEN concat(t, chr(10), '| ', array_to_string(list_transform(range(0, c + 1), lambda x: '---'), ' | '), ' |') ELSE t END, chr(10) ORDER BY i) AS grid FROM l GROUP BY 1""")
def md_table(spark, d):
    return grids.grid_markdown(cells_of(spark, d)).select("doc_key", "grid")


@query("cell_plain", "SELECT doc_key, entry, plain FROM cells WHERE plain <> ''")
def cell_plain(spark, d):
    return T(spark, d, A.CELLS).where("plain <> ''").select("doc_key", "entry", "plain")


# --- counters ----------------------------------------------------------------


@query("list_ordinals", "WITH x AS (SELECT *, row_number() OVER w AS n, last_value(number IGNORE NULLS) OVER w AS b, last_value(CASE WHEN number IS NOT NULL THEN entry + 1 END IGNORE NULLS) OVER w AS a FROM items WINDOW w AS (PARTITION BY doc_key ORDER BY entry)) SELECT doc_key, entry, CASE WHEN ordered THEN CAST(coalesce(b + n - a, n) AS BIGINT) END AS ordinal FROM x")
def list_ordinals(spark, d):
    return grids.list_ordinals(T(spark, d, A.ITEMS), ["doc_key"], "entry", "number", "ordered").select("doc_key", "entry", F.col("ordinal").cast("long").alias("ordinal"))


@query("ctr_heading", """WITH h AS (SELECT doc_key, node_id, level, scope, o1, count(*) FILTER (WHERE level < 1) OVER w AS g1, count(*) FILTER (WHERE level < 2) OVER w AS g2, count(*) FILTER (WHERE level < 3) OVER w AS g3 FROM tree_nodes WHERE type = 'heading' WINDOW w AS (PARTITION BY doc_key ORDER BY scope, o1)),
c AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_key, g1 ORDER BY scope, o1) AS c1, count(*) FILTER (WHERE level = 2) OVER (PARTITION BY doc_key, g2 ORDER BY scope, o1) AS c2, count(*) FILTER (WHERE level = 3) OVER (PARTITION BY doc_key, g3 ORDER BY scope, o1) AS c3 FROM h)
SELECT doc_key, node_id, CASE level WHEN 1 THEN CAST(c1 AS VARCHAR) WHEN 2 THEN concat(c1, '.', c2) ELSE concat(c1, '.', c2, '.', c3) END AS number FROM c""")
def ctr_heading(spark, d):
    return grids.heading_numbers(A.nodes(spark, d).where("type = 'heading'"), ["scope", "ord"], 3).select("doc_key", "node_id", "number")


@query("ctr_figure", "SELECT doc_key, node_id, CAST(row_number() OVER (PARTITION BY doc_key, k % 3 ORDER BY scope, o1, o2) AS VARCHAR) AS number FROM tree_nodes WHERE type = 'figure'")
def ctr_figure(spark, d):
    return grids.running_number(A.nodes(spark, d).where("type = 'figure'").withColumn("kind", F.col("k") % 3), ["doc_key", "kind"], ["scope", "ord"]).select("doc_key", "node_id", "number")


@query("ctr_math", "SELECT doc_key, node_id, concat('(', row_number() OVER (PARTITION BY doc_key ORDER BY scope, o1, o2), ')') AS number FROM tree_nodes WHERE type = 'math'")
def ctr_math(spark, d):
    return grids.running_number(A.nodes(spark, d).where("type = 'math'"), ["doc_key"], ["scope", "ord"], "(%d)").select("doc_key", "node_id", "number")


# --- text functions ----------------------------------------------------------


def lines(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


#: What a URL is made to begin with, by its length: an image's data, none, another's data, a script, the web, no scheme that is linked.
IMAGE_STARTS = (" DATA:image/png,", "", "data:text/html,", "java\nscript:", "HTTPS://a/", "ftp://a/")
SCALARS = {
    "html_escape": ("pages", "html", S.html_escape, "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"),
    "gfm_cell": ("pages", "html", S.gfm_cell, "replace(replace(regexp_replace(html, '\\r\\n|\\r', chr(10), 'g'), '|', '\\|'), chr(10), '<br>')"),
    "one_line": ("documents", "text", S.one_line, "regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')"),
    "unix_nl": ("documents", "text", S.unix_newlines, "regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')"),
    "sha256": ("documents", "text", S.sha256, "concat('sha256:', sha256(text))"),
    "preview": ("documents", "text", S.preview, "CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 77), '...') ELSE text END"),
    "css_token": ("documents", "text", S.css_token, "replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', '-', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"),
    "attr_value": ("pages", "html", lambda c: S.attr_value(F.replace(c, F.lit("<p>"), F.lit("]]]"))), "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html, '<p>', ']]]'), '\\', '\\\\'), '\"', '\\\"'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '\\]\\]', '] ]', 'g'), '\\]\\]', '] ]', 'g')"),
    "escape_dest": ("pages", "url", lambda c: S.escape_destination(F.concat(c, F.lit("?a=1&b=(2)"))), "concat('<', replace(replace(replace(replace(concat(url, '?a=1&b=(2)'), '\\', '\\\\'), '&', '\\&'), '<', '%3C'), '>', '%3E'), '>')"),
    "url_scheme": ("pages", "url", lambda c: S.url_scheme(F.concat(F.lit(" \t"), F.upper(c))), "lower(regexp_extract(upper(url), '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"),
    "is_safe_url": ("pages", "url", lambda c: S.is_safe_url(F.replace(c, F.lit("https:"), F.lit("java\nscript:"))), "regexp_extract(replace(url, 'https:', 'javascript:'), '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) IN ('', 'http', 'https', 'mailto')"),
    "is_safe_image": ("pages", "url", lambda c: S.is_safe_image(F.concat(F.element_at(F.array(*map(F.lit, IMAGE_STARTS)), (F.length(c) % len(IMAGE_STARTS) + 1).cast("int")), c)), "length(url) % 6 IN (0, 1, 4)"),
    "fence": ("documents", "text", lambda c: S.fence(F.replace(c, F.lit(" the "), F.lit(" ```` "))), "repeat('`', CASE WHEN contains(text, ' the ') THEN 5 ELSE 3 END)"),
    "code_span": ("documents", "text", lambda c: S.code_span(F.replace(c, F.lit(" the "), F.lit(" ``` "))), f"(SELECT concat(ticks, pad, t, pad, ticks) FROM (SELECT t, repeat('`', 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0)) AS ticks, CASE WHEN starts_with(t, '`') OR ends_with(t, '`') OR starts_with(t, ' ') AND ends_with(t, ' ') AND trim(t) <> '' THEN ' ' ELSE '' END AS pad FROM (SELECT regexp_replace(replace(text, ' the ', ' ``` '), '\\r\\n|\\r|\\n', ' ', 'g') AS t)))"),
    "escape_alt": ("pages", "html", S.escape_alt, "regexp_replace(html, '[\\[\\]`<]', '\\\\\\0', 'g')"),
    "yaml_scalar": ("documents", "text", S.yaml_scalar, "concat('\"', replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), '\"')"),
    "prefix_lines": ("documents", "text", S.prefixed, "array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x <> '' THEN concat('> ', x) ELSE '>' END), chr(10))"),
    "indent_lines": ("documents", "text", lambda c: S.indented(c, F.lit("- "), F.lit("  ")), "array_to_string(list_prepend(rtrim(concat('- ', string_split(text, chr(10))[1]), ' '), list_transform(string_split(text, chr(10))[2:], lambda x: CASE WHEN x <> '' THEN concat('  ', x) ELSE x END)), chr(10))"),
    "jcs_string": ("documents", "text", S.json_string, "CAST(to_json(text) AS VARCHAR)"),
    "node_hash": ("documents", "text", S.paragraph_hash, "concat('sha256:', sha256(concat('{\"text\":{\"value\":', CAST(to_json(nfc_normalize(text)) AS VARCHAR), '},\"type\":\"paragraph\"}')))"),
}
for _name, (_table, _col, _fn, _sql) in SCALARS.items():
    _key = "page_id" if _table == "pages" else "doc_id"
    query(_name, f"SELECT {_key}, {_sql} AS out FROM {_table}")(
        lambda spark, d, t=_table, c=_col, k=_key, fn=_fn: spark.read.parquet(f"{d}/{t}.parquet").select(k, fn(F.col(c)).alias("out"))
    )


def escaped_sql(text: str) -> str:
    """escape_inline character by character: c, the one before (p), the one after (n) and what follows (r)."""
    punctuation = "strpos('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~' || chr(10) || chr(13), n) > 0"
    word = "regexp_matches({}, '^[\\p{{L}}\\p{{N}}]$')"
    special = f"""CASE WHEN strpos('*`[]~', c) > 0 THEN true
      WHEN c = '\\' THEN n = '' OR {punctuation} WHEN c = '_' THEN NOT ({word.format('p')} AND {word.format('n')})
      WHEN c = '<' THEN regexp_matches(n, '^[A-Za-z/!?]$') WHEN c = '&' THEN regexp_matches(r, '^&(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});') ELSE false END"""
    return f"""SELECT page_id, coalesce(string_agg(CASE WHEN {special} THEN '\\' || c ELSE c END, '' ORDER BY i), '') AS t
      FROM (SELECT page_id, i, cs[i] AS c, CASE WHEN i > 1 THEN cs[i - 1] ELSE '' END AS p, coalesce(cs[i + 1], '') AS n, CASE WHEN cs[i] = '&' THEN array_to_string(cs[i : i + 40], '') END AS r
            FROM (SELECT page_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT page_id, string_split({text}, '') AS cs FROM pages) a) b) k GROUP BY 1"""


LINE_SQL = r"""CASE
  WHEN regexp_matches(x, '^ {0,3}#{1,6}([ \t]|$)') OR regexp_matches(x, '^ {0,3}>') OR regexp_matches(x, '^ {0,3}[-+]([ \t]|$)') OR regexp_matches(x, '^ {0,3}(=+|-+)[ \t]*$')
    OR regexp_matches(x, '^ {0,3}(-[ \t]*){3,}$') OR regexp_matches(x, '^[|:\- \t]+$') AND contains(x, '|') AND contains(x, '-')
  THEN regexp_replace(x, '^( {0,3})', '\1' || chr(92) || chr(92))
  WHEN regexp_matches(x, '^ {0,3}[0-9]{1,9}[.)]([ \t]|$)') THEN regexp_replace(x, '^( {0,3}[0-9]{1,9})([.)])', '\1' || chr(92) || chr(92) || '\2')
  ELSE x END"""
#: Pages with what starts blocks put at the heads of their lines, by the page's number.
PAGE_LINES = "replace(replace(html, '<p>', chr(10) || CASE page_id % 8 WHEN 0 THEN '# ' WHEN 1 THEN '> ' WHEN 2 THEN '- ' WHEN 3 THEN '12. ' WHEN 4 THEN '---' || chr(10) WHEN 5 THEN '| - |' || chr(10) WHEN 6 THEN '  ==' || chr(10) ELSE 'a_b_ \\* &amp; 3) ' END), '</p>', chr(10) || '7) ')"


@query("escape_inline", f"SELECT page_id, t AS out FROM ({escaped_sql('html')}) e")
def escape_inline(spark, d):
    return pages(spark, d).select("page_id", S.escape_inline(F.col("html")).alias("out"))


@query("escape_block", f"SELECT page_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {LINE_SQL}), chr(10)) AS out FROM ({escaped_sql(PAGE_LINES)}) e")
def escape_block(spark, d):
    return pages(spark, d).select("page_id", S.escape_block(F.expr(PAGE_LINES.replace("'a_b_ \\* ", "'a_b_ \\\\* "))).alias("out"))


@query("fmt_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders")
def fmt_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey") % 3
    return o.select("o_orderkey", S.format_date(F.year("o_orderdate"), F.when(k > 0, F.month("o_orderdate")), F.when(k != 1, F.dayofmonth("o_orderdate"))).alias("shown"))


@query("fmt_bib", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE concat_ws('. ', nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''), concat('(', 1900 + p_size, ')'), p_type) END AS shown FROM part")
def fmt_bib(spark, d):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    shown = S.format_bib(F.when(size % 4 == 0, F.col("p_name")), F.when(size % 3 == 0, "").otherwise(F.col("p_brand")), 1900 + size, F.col("p_type"), none, none, none, F.col("p_name"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", shown.alias("shown"))


@query("placeholder", "SELECT p_partkey, concat('[[figure:', p_partkey, ' kind=\"table\"', CASE WHEN p_size % 2 = 0 THEN concat(' caption=\"', p_name, '\"') ELSE '' END, ' rows=\"', p_size, '\"]]') AS shown FROM part")
def placeholder(spark, d):
    attrs = [("kind", F.lit("table")), ("caption", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), ("rows", F.col("p_size").cast("string"))]
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", S.placeholder(F.col("p_partkey").cast("string"), attrs).alias("shown"))


# --- hashing, matching, diff -------------------------------------------------

DIGESTS = "SELECT p.doc_key, p.scope, p.o1, sha256(concat('[', coalesce(concat('|', string_agg(concat(c.node_hash, '|', CASE WHEN c.slots > 0 THEN sha256('[|]') ELSE '' END), '|' ORDER BY c.o2)), ''), '|]')) AS subtree FROM {t} p LEFT JOIN {t} c ON c.depth = 1 AND c.doc_key = p.doc_key AND c.scope = p.scope AND c.o1 = p.o1 WHERE p.depth = 0 GROUP BY 1, 2, 3"
ENTRIES = """SELECT n.doc_key, n.node_id, n.label, n.type, n.node_hash AS hash, row_number() OVER (PARTITION BY n.doc_key ORDER BY n.scope, n.o1, n.o2) AS walk_order,
CASE WHEN n.scope = 0 THEN n.path ELSE concat('footnotes/', f.label, substr(n.path, 12)) END AS path, CASE WHEN n.type = 'quote' THEN g.subtree ELSE '' END AS subtree
FROM {t} n LEFT JOIN notes f ON f.doc_key = n.doc_key AND f.pool_index = n.scope - 1 LEFT JOIN (""" + DIGESTS + """) g ON n.depth = 0 AND g.doc_key = n.doc_key AND g.scope = n.scope AND g.o1 = n.o1"""  # fmt: skip
KEYS = {"label": "label", "hash+path": "concat(hash, '~', subtree, '~', path)", "hash": "concat(hash, '~', subtree)", "path+type": "concat(path, '~', type)", "container-hash": "CASE WHEN subtree <> '' THEN hash END"}


def passes_sql(final: str, until: int = 5) -> str:
    ctes = [f"o0 AS MATERIALIZED ({ENTRIES.format(t='tree_nodes')})", f"n0 AS MATERIALIZED ({ENTRIES.format(t='new_nodes')})"]
    for i, (name, key) in enumerate(list(KEYS.items())[:until]):
        for s in "on":
            ctes.append(f"{s}k{i} AS (SELECT *, row_number() OVER (PARTITION BY doc_key, k ORDER BY walk_order) AS rn FROM (SELECT *, {key} AS k FROM {s}{i}) q WHERE k IS NOT NULL)")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT o.doc_key, o.walk_order AS oo, n.walk_order AS nn, o.node_id AS old_id, n.node_id AS new_id, o.hash AS oh, n.hash AS nh, o.path AS op, n.path AS np, '{name}' AS matched_by FROM ok{i} o JOIN nk{i} n ON o.doc_key = n.doc_key AND o.k = n.k AND o.rn = n.rn)")
        for s, c in (("o", "oo"), ("n", "nn")):
            ctes.append(f"{s}{i + 1} AS MATERIALIZED (SELECT x.* FROM {s}{i} x LEFT JOIN m{i} m ON x.doc_key = m.doc_key AND x.walk_order = m.{c} WHERE m.doc_key IS NULL)")
    ctes.append("pairs AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(until)) + ")")
    ctes.append(f"""changes AS (SELECT doc_key, CASE WHEN oh <> nh THEN 'changed' WHEN op <> np THEN 'moved' ELSE 'unchanged' END AS status, matched_by, old_id, new_id, oo, nn FROM pairs
      UNION ALL SELECT doc_key, 'added', NULL, NULL, node_id, NULL, walk_order FROM n{until} UNION ALL SELECT doc_key, 'removed', NULL, node_id, NULL, walk_order, NULL FROM o{until})""")
    return f"WITH {', '.join(ctes)} {final}"


def builds(spark, d):
    c = A.corpus(spark, d)
    return match.entries(c.nodes, c.footnotes), match.entries(A.nodes(spark, d, new=True), c.footnotes)


@query("subtree_digest", DIGESTS.format(t="tree_nodes"))
def subtree_digest(spark, d):
    n = A.nodes(spark, d)
    return match.subtree_digests(n).where("size(ord) = 1").select("doc_key", "scope", F.get("ord", 0).alias("o1"), "subtree")


@query("match_path", "SELECT n.doc_key, n.node_id, CASE WHEN n.scope = 0 THEN n.path ELSE concat('footnotes/', f.label, substr(n.path, 12)) END AS match_path FROM tree_nodes n LEFT JOIN notes f ON f.doc_key = n.doc_key AND f.pool_index = n.scope - 1")
def match_path(spark, d):
    c = A.corpus(spark, d)
    return match.match_path(c.nodes, c.footnotes).select("doc_key", "node_id", "match_path")


@query("entries", f"SELECT doc_key, node_id, path, hash, walk_order, subtree FROM ({ENTRIES.format(t='tree_nodes')}) e")
def entries(spark, d):
    return builds(spark, d)[0].select("doc_key", "node_id", "path", "hash", "walk_order", "subtree")


for _i, (_id, _name) in enumerate({"m1_label": "label", "m2_hash_path": "hash+path", "m3_hash": "hash", "m4_path_type": "path+type", "m5_container": "container-hash"}.items()):
    query(_id, passes_sql(f"SELECT doc_key, old_id, new_id FROM m{_i}"))(
        lambda spark, d, name=_name: match.match_entries(*builds(spark, d), until=name, keep=["node_id"])[0].where(F.col("matched_by") == name).select("doc_key", F.col("old_node_id").alias("old_id"), F.col("new_node_id").alias("new_id"))
    )


@query("match_entries", passes_sql("SELECT doc_key, matched_by, old_id, new_id FROM pairs"))
def match_entries(spark, d):
    return match.match_entries(*builds(spark, d), keep=["node_id"])[0].select("doc_key", "matched_by", F.col("old_node_id").alias("old_id"), F.col("new_node_id").alias("new_id"))


QUERIES["match_tiebreak"], ORACLE_SQL["match_tiebreak"] = QUERIES["match_entries"], ORACLE_SQL["match_entries"]


@query("diff", passes_sql("SELECT doc_key, status, matched_by, old_id, new_id, row_number() OVER (PARTITION BY doc_key ORDER BY nn NULLS LAST, oo) AS seq FROM changes"))
def diff(spark, d):
    return match.diff(*builds(spark, d)).select("doc_key", "status", "matched_by", "old_id", "new_id", "seq")


@query("diff_counts", passes_sql("SELECT doc_key, status, count(*) AS n FROM changes GROUP BY 1, 2"))
def diff_counts(spark, d):
    return match.diff_counts(match.diff(*builds(spark, d)))


@query("status_views", passes_sql("SELECT doc_key, bool_and(status = 'unchanged') AS is_empty FROM changes GROUP BY 1"))
def status_views(spark, d):
    return match.unchanged_docs(match.diff(*builds(spark, d)))


@query("status_moved", passes_sql("SELECT doc_key, status, old_id, new_id FROM changes WHERE status IN ('moved', 'changed')"))
def status_moved(spark, d):
    return match.changes_of(match.diff(*builds(spark, d)), "moved", "changed").select("doc_key", "status", "old_id", "new_id")


POOL = """SELECT n.doc_key, CASE WHEN o.id IS NULL THEN 'added' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status, n.label, o.id AS old_id, n.id AS new_id
FROM new_bib n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, label ORDER BY pool_index DESC) AS r FROM bib) x WHERE r = 1) o ON o.doc_key = n.doc_key AND o.label = n.label
UNION ALL SELECT o.doc_key, 'removed', o.label, o.id, NULL FROM bib o WHERE NOT EXISTS (SELECT 1 FROM new_bib n WHERE n.doc_key = o.doc_key AND n.label = o.label)"""


@query("match_pool", f"SELECT doc_key, label, old_id, new_id FROM ({POOL}) p WHERE old_id IS NOT NULL AND new_id IS NOT NULL")
def match_pool(spark, d):
    return match.match_pool(T(spark, d, A.BIBLIOGRAPHY), T(spark, d, A.NEW_BIBLIOGRAPHY)).where("old_id is not null and new_id is not null").select("doc_key", "label", "old_id", "new_id")


@query("pool_diff", POOL)
def pool_diff(spark, d):
    return match.match_pool(T(spark, d, A.BIBLIOGRAPHY), T(spark, d, A.NEW_BIBLIOGRAPHY))


def mapping(spark, d, only_exact=False):
    return match.remap(match.diff(*builds(spark, d)), only_exact=only_exact)


@query("reconcile", passes_sql("SELECT doc_key, new_id, coalesce(old_id, new_id) AS id FROM changes WHERE new_id IS NOT NULL"))
def reconcile(spark, d):
    return mapping(spark, d)


@query("reconcile_exact", passes_sql("SELECT doc_key, new_id, CASE WHEN matched_by = 'label' THEN old_id ELSE new_id END AS id FROM changes WHERE new_id IS NOT NULL"))
def reconcile_exact(spark, d):
    return mapping(spark, d, only_exact=True)


@query("reconcile_counts", passes_sql("SELECT doc_key, count(old_id) AS inherited, count(*) - count(old_id) AS minted FROM changes WHERE new_id IS NOT NULL GROUP BY 1"))
def reconcile_counts(spark, d):
    return match.reconcile_counts(mapping(spark, d))


#: Ids handed on by hand, so that some collide: orders' ids folded by 40, a few rows keeping their own.
HANDED_ON = "SELECT CAST(o_custkey AS INT) AS doc_key, concat('n', o_orderkey) AS new_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('n', o_orderkey) WHEN o_orderkey % 5 = 1 THEN concat('n', o_orderkey + 4) ELSE concat('o', o_orderkey % 40) END AS id FROM orders"


@query("remap_guards", f"SELECT doc_key, id, CASE WHEN taken > 1 THEN 'inherited twice' ELSE 'inherited and kept' END AS problem FROM (SELECT doc_key, id, count(*) FILTER (WHERE id <> new_id) AS taken, count(*) FILTER (WHERE id = new_id) AS kept FROM ({HANDED_ON}) h GROUP BY 1, 2) g WHERE taken > 1 OR taken = 1 AND kept > 0")
def remap_guards(spark, d):
    return match.remap_conflicts(T(spark, d, HANDED_ON))


@query("remap_apply", passes_sql("SELECT n.doc_key, coalesce(c.old_id, n.node_id) AS node_id, n.value FROM new_nodes n LEFT JOIN changes c ON n.doc_key = c.doc_key AND n.node_id = c.new_id"))
def remap_apply(spark, d):
    return match.remap_apply(A.nodes(spark, d, new=True), mapping(spark, d)).select("doc_key", "node_id", "value")


HASHED = "concat('sha256:', sha256({}))"


@query("whole_hashes", f"SELECT CAST(doc_key AS VARCHAR) AS doc_key, path, {HASHED.format('own_json')} AS node_hash FROM parts")
def whole_hashes(spark, d):
    return whole(spark, d, "nodes.path nodes.node_hash", once=True).nodes.select("doc_key", "path", "node_hash")


POOL_JSON = f"SELECT c_custkey AS doc_key, {A.filled('{"authors":["A","B"],"label":"b1","title":"Book <K>","year":1999}')} AS b1, '{{\"label\":\"b2\"}}' AS b2, '{{\"label\":\"n1\"}}' AS n1 FROM customer"


@query("content_hash", f"""WITH pools AS ({POOL_JSON}), own AS (SELECT doc_key, string_agg(concat('["', path, '","', {HASHED.format('own_json')}, '"]'), ',' ORDER BY n) AS nodes FROM parts GROUP BY 1)
SELECT CAST(o.doc_key AS VARCHAR) AS doc_key, {HASHED.format("concat('{\"bibliography\":[\"', " + HASHED.format('b1') + ", '\",\"', " + HASHED.format('b2') + ", '\"],\"doc\":{\"lang\":\"en\",\"title\":\"About ', c_name, '\"},\"footnotes\":[\"', " + HASHED.format('n1') + ", '\"],\"nodes\":[', nodes, ']}')")} AS content_hash
FROM own o JOIN pools p ON o.doc_key = p.doc_key JOIN customer c ON c.c_custkey = o.doc_key""")
def content_hash(spark, d):
    return content_hashes(whole(spark, d, "doc_fields_json nodes.scope nodes.ord nodes.path nodes.node_hash bibliography.pool_index bibliography.hash footnotes.pool_index footnotes.hash"))


@query("pool_hash", f"WITH pools AS ({POOL_JSON}) SELECT CAST(doc_key AS VARCHAR) AS doc_key, unnest(['b1', 'b2', 'n1']) AS label, unnest([{HASHED.format('b1')}, {HASHED.format('b2')}, {HASHED.format('n1')}]) AS hash FROM pools")
def pool_hash(spark, d):
    c = whole(spark, d, "bibliography.label bibliography.hash footnotes.label footnotes.hash")
    return c.bibliography.select("doc_key", "label", "hash").unionByName(c.footnotes.select("doc_key", "label", "hash"))


# --- declarations and whole documents ----------------------------------------


def declared(spark, d):
    """Conversations as declarations: a heading for each, a paragraph for each turn."""
    from folioflow.sources import declarations  # noqa: F401  (the compiler runs on the executors)

    turns = T(spark, d, A.TURNS)
    para = F.to_json(F.struct(F.lit("paragraph").alias("type"), "label", F.col("value").alias("text")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o1", para.alias("p")))), lambda x: x["p"]), ",")
    raw = F.concat(
        F.lit('{"declaration_version":"0.2.0","doc":{"title":"Conversation '), F.col("doc_key").cast("string"),
        F.lit('"},"nodes":[{"type":"heading","level":1,"text":"Turns","children":['), F.col("ps"), F.lit("]}]}"),
    )
    return turns.groupBy("doc_key").agg(listed.alias("ps")).select(F.col("doc_key").cast("string").alias("doc_key"), raw.alias("raw"))


@query("build_numbered", "SELECT CAST(doc_key AS VARCHAR) AS doc_key, 1 + count(*) AS n_nodes, '1 Turns' AS heading_path, min(CASE WHEN o1 = 0 THEN value END) AS first_text FROM turns GROUP BY 1")
def build_numbered(spark, d):
    from folioflow.sources import declarations

    c = documents.corpus(cut(documents.parse(cut(declarations.compile_all(declared(spark, d), numbering=True)).select("doc_key", "raw"))))
    n = c.nodes.groupBy("doc_key").agg(F.count("*").alias("n_nodes"), F.max(F.when(F.col("type") == "heading", F.array_join("heading_path", "/"))).alias("heading_path"))
    first = c.texts.where("size(ord) = 2 and ord[1] = 0").select("doc_key", F.col("value").alias("first_text"))
    return n.join(first, "doc_key")


@query("build_hashes", "SELECT CAST(doc_key AS VARCHAR) AS doc_key, concat('nodes/0/children/', o1) AS path, concat('sha256:', sha256(concat('{\"label\":', CAST(to_json(label) AS VARCHAR), ',\"text\":{\"value\":', CAST(to_json(nfc_normalize(value)) AS VARCHAR), '},\"type\":\"paragraph\"}'))) AS node_hash FROM turns")
def build_hashes(spark, d):
    from folioflow.sources import declarations

    c = documents.corpus(documents.parse(cut(declarations.compile_all(declared(spark, d))).select("doc_key", "raw")))
    return c.nodes.where("type = 'paragraph'").select("doc_key", "path", "node_hash")


@query("conv_md")
def conv_md(spark, d):
    from folioflow.operators import convert
    from folioflow.sources import declarations

    built = declarations.compile_all(declared(spark, d), numbering=True)
    told = convert.to_markdown(built.select("doc_key", "raw"))
    body = F.regexp_replace("text", "(?m)^built_at: .*$", "built_at:")
    return told.select("doc_key", body.alias("text"), F.size("warnings").alias("n_warnings"))


@query("conv_html")
def conv_html(spark, d):
    from folioflow.operators import convert
    from folioflow.sources import declarations

    told = convert.to_html(declarations.compile_all(declared(spark, d), numbering=True).select("doc_key", "raw"))
    return told.select("doc_key", F.regexp_replace("text", 'data-built-at="[^"]*"', "").alias("text"), F.size("warnings").alias("n_warnings"))
