"""The driver's tables as corpora of documents, so that every operator has something to work on.

``TREE`` makes a document of each 40 customers: they are headings or quotes
(some of them within footnotes), their orders the blocks below; suppliers are
the bibliography. The same text is read by Spark and by the oracle.
``whole_documents`` makes a file of each customer, in the format, with nodes of
every type; its parts are told again, by hand, in ``PARTS`` for the oracle.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.documents import Corpus

DOC_OF = "CAST(floor(c_custkey / 40) AS INT)"
CUSTOMERS = f"""
SELECT {DOC_OF} AS doc_key, c_custkey, c_name, CASE WHEN c_custkey % 10 = 9 THEN CAST(1 + c_custkey % 3 AS INT) ELSE 0 END AS scope,
       CAST(row_number() OVER (PARTITION BY {DOC_OF}, CASE WHEN c_custkey % 10 = 9 THEN 1 + c_custkey % 3 ELSE 0 END ORDER BY c_custkey) - 1 AS INT) AS o1
FROM customer
"""
TREE = f"""
SELECT doc_key, scope, o1, -1 AS o2, concat('c', c_custkey) AS node_id, CASE WHEN c_custkey % 4 = 0 THEN 'quote' ELSE 'heading' END AS type,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('L', c_custkey % 400) END AS label, 0 AS depth, CAST(1 + c_custkey % 3 AS INT) AS level,
       CASE WHEN doc_key % 3 = 0 OR doc_key % 3 = 1 AND c_custkey % 6 > 0 THEN CAST(c_custkey % 13 AS INT) END AS page, c_name AS value, c_custkey AS k, 1 AS slots,
       CASE WHEN scope = 0 THEN concat('nodes/', o1) ELSE concat('footnotes/', scope - 1, '/children/', o1) END AS path
FROM ({CUSTOMERS}) c
UNION ALL
SELECT doc_key, scope, o1, o2, concat('o', k), CASE k % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'figure' WHEN 2 THEN 'math' WHEN 3 THEN 'code' ELSE 'image' END,
       CASE WHEN k % 3 = 0 THEN concat('L', k % 400) END, 1, NULL,
       CASE WHEN doc_key % 3 = 0 OR doc_key % 3 = 1 AND k % 6 > 0 THEN CAST(k % 13 AS INT) END, value, k, CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END,
       concat(CASE WHEN scope = 0 THEN concat('nodes/', o1) ELSE concat('footnotes/', scope - 1, '/children/', o1) END, '/children/', o2)
FROM (SELECT c.doc_key, c.scope, c.o1, o.o_orderkey AS k, concat(o.o_orderpriority, ' ', o.o_orderstatus, ' ', o.o_orderkey % 50) AS value,
             CAST(row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) - 1 AS INT) AS o2
      FROM orders o JOIN ({CUSTOMERS}) c ON o.o_custkey = c.c_custkey) x
"""
NODES = f"SELECT t.*, md5(concat(type, '|', coalesce(label, ''), '|', value)) AS node_hash FROM ({TREE}) t"
#: A second build: some blocks gone, some edited, some without their label; in some documents the first section is gone, so that all others move up; new ids.
NEW_NODES = f"""
SELECT doc_key, scope, o1, CASE WHEN depth = 0 THEN -1 ELSE CAST(row_number() OVER (PARTITION BY doc_key, scope, o1, depth ORDER BY o2) - 1 AS INT) END AS o2,
       concat('n', node_id) AS node_id, type, label, depth, level, page, value, k, slots,
       CASE WHEN depth = 0 THEN parent_path ELSE concat(parent_path, '/children/', row_number() OVER (PARTITION BY doc_key, scope, o1, depth ORDER BY o2) - 1) END AS path,
       md5(concat(type, '|', coalesce(label, ''), '|', value)) AS node_hash
FROM (SELECT doc_key, scope, o1, o2, node_id, type, CASE WHEN k % 9 = 0 THEN NULL ELSE label END AS label, depth, level, page,
             CASE WHEN k % 13 = 0 THEN concat(value, ' edited') ELSE value END AS value, k, slots,
             CASE WHEN scope = 0 THEN concat('nodes/', o1) ELSE concat('footnotes/', scope - 1, '/children/', o1) END AS parent_path
      FROM (SELECT doc_key, scope, CASE WHEN doc_key % 5 = 2 AND scope = 0 THEN o1 - 1 ELSE o1 END AS o1, o2, node_id, type, label, depth, level, page, value, k, slots
            FROM ({TREE}) t WHERE (depth = 0 OR k % 11 > 0) AND NOT (doc_key % 5 = 2 AND scope = 0 AND o1 = 0)) r) e
"""
EDGES = f"""
SELECT doc_key, scope, o1, o2, node_id AS owner, type AS owner_type, 'text' AS role, 0 AS text_index, 0 AS edge_index, CAST(length(value) AS INT) AS length,
       CASE k % 4 WHEN 0 THEN 'refs' WHEN 1 THEN 'cites' WHEN 2 THEN 'footnotes' ELSE 'links' END AS family,
       CASE WHEN k % 4 < 3 THEN concat('L', (k * 7) % 500) END AS label, CASE WHEN k % 4 = 3 THEN concat('https://example.org/', k) END AS href,
       CAST(k % 9 AS INT) AS s0, CAST(k % 9 + k % 12 - 1 AS INT) AS s1
FROM ({TREE}) t WHERE depth = 1
"""
MARKS = f"""
SELECT doc_key, scope, o1, o2, node_id AS owner, type AS owner_type, 'text' AS role, 0 AS text_index, CAST(length(value) AS INT) AS length, 0 AS mark_index,
       CAST(k % 6 AS INT) AS s, CAST(k % 6 + k % 5 AS INT) AS e, CASE k % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'code' ELSE 'emph' END AS kind
FROM ({TREE}) t WHERE depth = 1
UNION ALL
SELECT doc_key, scope, o1, o2, node_id, type, 'text', 0, CAST(length(value) AS INT), 1, CAST(k % 4 AS INT), CAST(k % 4 + k % 17 AS INT), CASE k % 2 WHEN 0 THEN 'strong' ELSE 'sup' END
FROM ({TREE}) t WHERE depth = 1
"""
#: Some entries carry an id of a footnote, so that ids aren't all unique.
BIBLIOGRAPHY = """
SELECT CAST(floor(s_suppkey / 3) AS INT) AS doc_key, CAST(row_number() OVER (PARTITION BY floor(s_suppkey / 3) ORDER BY s_suppkey) - 1 AS INT) AS pool_index,
       CASE WHEN s_suppkey % 8 = 0 THEN concat('f', CAST(floor(s_suppkey / 3) AS INT), '_1') ELSE concat('b', s_suppkey) END AS id,
       concat('L', s_suppkey % 60 + 380) AS label, s_suppkey % 3 > 0 AS has_fields, s_suppkey % 4 > 1 AS has_formatted, s_name AS title, s_suppkey AS k, md5(s_name) AS hash
FROM supplier
"""
NEW_BIBLIOGRAPHY = f"SELECT doc_key, pool_index, concat('n', id) AS id, label, CASE WHEN k % 5 = 0 THEN md5(concat(title, 'x')) ELSE hash END AS hash, k FROM ({BIBLIOGRAPHY}) b WHERE k % 6 > 0"
DOC_KEYS = f"SELECT DISTINCT {DOC_OF} AS doc_key FROM customer"
FOOTNOTES = f"""
SELECT doc_key, i AS pool_index, concat('f', doc_key, '_', i) AS id, concat('L', doc_key * 3 + i + 380) AS label
FROM ({DOC_KEYS}) d JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n ON doc_key >= 0
"""
DOCUMENTS = f"SELECT doc_key, CASE WHEN doc_key % 5 = 0 THEN '0.4.0' ELSE '0.5.0' END AS version, concat('Document ', doc_key) AS title FROM ({DOC_KEYS}) d"
#: Tables: an order is one, a line (in a total order) a row of it; row 0 is often the header.
CELLS = """
SELECT l_orderkey AS doc_key, 0 AS scope, r * 3 + c AS entry, r AS "row", c AS "col", CASE WHEN l_orderkey % 5 = 0 AND r = 1 THEN 2 ELSE 1 END AS rowspan,
       CASE WHEN l_orderkey % 7 = 0 AND c = 2 THEN 2 ELSE 1 END AS colspan, r = 0 AND l_orderkey % 3 > 0 OR c = 0 AND l_orderkey % 4 = 0 AS is_header,
       CASE c WHEN 0 THEN concat('p', l_partkey) WHEN 1 THEN concat(l_returnflag, '|', l_linestatus) ELSE CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE concat('s', l_suppkey) END END AS plain,
       CAST(l_suppkey % 3 AS INT) AS n_children
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS r FROM lineitem) l
JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) cs ON l_orderkey >= 0 AND (c < 1 OR l_orderkey % 8 > 0)
"""
#: Lists: an order is one; a line is an item, some with their own number or a checkbox.
ITEMS = """
SELECT l_orderkey AS doc_key, 0 AS scope, r AS entry, CASE WHEN l_partkey % 6 = 0 THEN CAST(l_partkey % 40 AS INT) END AS number, l_orderkey % 4 > 0 AS ordered,
       CASE WHEN l_orderkey % 2 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS checked
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS r FROM lineitem) l
"""
#: Flat documents: conversations, a turn a paragraph.
TURNS = """
SELECT conv_id AS doc_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS o1, concat('t', turn) AS label, role, text AS value FROM conversations
"""
# --- whole documents ---------------------------------------------------------


def _uuid(n: int) -> str:
    return f"00000000-0000-4000-8000-<K>{n:02d}"


def _node(n: int, type_: str, /, **fields) -> dict:
    return {"id": _uuid(n), "type": type_} | fields


def _text(value: str, **fields) -> dict:
    return {"value": value} | fields


def _para(n: int, value: str, **fields) -> dict:
    return _node(n, "paragraph", text=_text(value, **fields))


def _template() -> dict:
    """A document with every type of node; <K>, <NAME> and <SEG> stand for a customer's ten-digit key, name and segment."""
    first = _para(
        2, "<NAME> buys in <SEG>", marks=[{"start": 0, "end": 4, "kind": "strong"}, {"start": 5, "end": 8, "kind": "emph"}],
        refs=[{"label": "fig", "text_span": [0, 4]}, {"label": "gone"}], cites=[{"label": "b1", "form": "prose"}], footnotes=[{"label": "n1"}],
        links=[{"href": "https://x.org/<K>", "text_span": [5, 8]}],
    )
    quote = _node(6, "quote", attribution=_text("<SEG>"), children=[_para(7, "quoted")])
    code = _node(8, "code", text="x = <K>\n", lang="py", title="t")
    items = [{"number": 3, "checked": True, "children": [_para(5, "one <K>"), quote]}, {"children": []}, {"checked": False, "children": [code]}]
    terms = [{"term": _text("alpha"), "children": [_para(10, "a")]}, {"term": _text("beta", refs=[{"label": "top"}]), "children": []}]
    section = _node(3, "heading", level=2, heading_path=["<NAME>", "Lists"], text=_text("Lists"), children=[
        _node(4, "list", ordered=True, items=items), _node(9, "terms", items=terms),
    ])
    cells = [
        {"row": 0, "col": 0, "is_header": True, "children": [_para(12, "h1")]}, {"row": 0, "col": 1, "is_header": True, "children": [_para(13, "h2")]},
        {"row": 1, "col": 0, "children": [_para(14, "<K>")]}, {"row": 1, "col": 1, "children": [_node(15, "image", path="p.png", alt="pic"), _para(16, "more")]},
    ]
    figure = _node(
        17, "figure", label="fig", kind="chart", numbering={"value": "1", "name": "Figure"}, caption=_text("Cap <K>", cites=[{"label": "b1"}]),
        description=_text("Desc", links=[{"href": "https://y.org/"}]), children=[_node(18, "image", path="i.png", alt="alt <K>")],
    )
    math = _node(20, "math", text="x^2", raw={"format": "latex", "value": "x^{2}"})
    layout = [{"row": 0, "col": 1, "children": [_para(22, "right")]}, {"row": 0, "col": 0, "children": [_para(23, "left")]}]
    return {
        "cnd_version": "0.5.0", "id": _uuid(0), "built_at": "2024-01-02T03:04:05+00:00", "doc": {"title": "About <NAME>", "lang": "en"},
        "nodes": [
            _node(1, "heading", level=1, label="top", heading_path=["<NAME>"], text=_text("<NAME>"), children=[first, section, _node(11, "table", kind="data", cells=cells)]),
            figure, _node(19, "admonition", kind="note", title=_text("T"), children=[math]), _node(21, "layout", cells=layout), _para(24, "last"),
        ],
        "footnotes": [{"id": _uuid(30), "label": "n1", "children": [_para(25, "note <K>")]}],
        "bibliography": [{"id": _uuid(31), "label": "b1", "title": "Book <K>", "year": 1999, "authors": ["A", "B"]}, {"id": _uuid(32), "label": "b2"}],
    }


def filled(template: str, key: str = "c_custkey", name: str = "c_name", segment: str = "c_mktsegment") -> str:
    """SQL of a template with a customer's values in it."""
    quoted = template.replace("'", "''")
    return f"replace(replace(replace('{quoted}', '<K>', lpad(CAST({key} AS VARCHAR), 10, '0')), '<NAME>', {name}), '<SEG>', {segment})"


#: The template's nodes in walk order, by hand: id, scope, path, parent's id, type, field, entry, heading path, and the canonical JSON that the hash is of.
PARTS = [
    (1, 0, "nodes/0", None, "heading", "nodes", None, "", '{"heading_path":["<NAME>"],"label":"top","level":1,"text":{"value":"<NAME>"},"type":"heading"}'),
    (2, 0, "nodes/0/children/0", 1, "paragraph", "children", None, "<NAME>", '{"text":{"cites":[{"form":"prose","label":"b1"}],"footnotes":[{"label":"n1"}],"links":[{"href":"https://x.org/<K>","text_span":[5,8]}],"marks":[{"end":4,"kind":"strong","start":0},{"end":8,"kind":"emph","start":5}],"refs":[{"label":"fig","text_span":[0,4]},{"label":"gone"}],"value":"<NAME> buys in <SEG>"},"type":"paragraph"}'),
    (3, 0, "nodes/0/children/1", 1, "heading", "children", None, "<NAME>", '{"heading_path":["<NAME>","Lists"],"level":2,"text":{"value":"Lists"},"type":"heading"}'),
    (4, 0, "nodes/0/children/1/children/0", 3, "list", "children", None, "<NAME>/Lists", '{"items":[{"checked":true,"number":3},{},{"checked":false}],"ordered":true,"type":"list"}'),
    (5, 0, "nodes/0/children/1/children/0/items/0/children/0", 4, "paragraph", "items", 0, "<NAME>/Lists", '{"text":{"value":"one <K>"},"type":"paragraph"}'),
    (6, 0, "nodes/0/children/1/children/0/items/0/children/1", 4, "quote", "items", 0, "<NAME>/Lists", '{"attribution":{"value":"<SEG>"},"type":"quote"}'),
    (7, 0, "nodes/0/children/1/children/0/items/0/children/1/children/0", 6, "paragraph", "children", None, "<NAME>/Lists", '{"text":{"value":"quoted"},"type":"paragraph"}'),
    (8, 0, "nodes/0/children/1/children/0/items/2/children/0", 4, "code", "items", 2, "<NAME>/Lists", '{"lang":"py","text":"x = <K>\\n","title":"t","type":"code"}'),
    (9, 0, "nodes/0/children/1/children/1", 3, "terms", "children", None, "<NAME>/Lists", '{"items":[{"term":{"value":"alpha"}},{"term":{"refs":[{"label":"top"}],"value":"beta"}}],"type":"terms"}'),
    (10, 0, "nodes/0/children/1/children/1/items/0/children/0", 9, "paragraph", "items", 0, "<NAME>/Lists", '{"text":{"value":"a"},"type":"paragraph"}'),
    (11, 0, "nodes/0/children/2", 1, "table", "children", None, "<NAME>", '{"cells":[{"col":0,"is_header":true,"row":0},{"col":1,"is_header":true,"row":0},{"col":0,"row":1},{"col":1,"row":1}],"kind":"data","type":"table"}'),
    (12, 0, "nodes/0/children/2/cells/0/children/0", 11, "paragraph", "cells", 0, "<NAME>", '{"text":{"value":"h1"},"type":"paragraph"}'),
    (13, 0, "nodes/0/children/2/cells/1/children/0", 11, "paragraph", "cells", 1, "<NAME>", '{"text":{"value":"h2"},"type":"paragraph"}'),
    (14, 0, "nodes/0/children/2/cells/2/children/0", 11, "paragraph", "cells", 2, "<NAME>", '{"text":{"value":"<K>"},"type":"paragraph"}'),
    (15, 0, "nodes/0/children/2/cells/3/children/0", 11, "image", "cells", 3, "<NAME>", '{"alt":"pic","path":"p.png","type":"image"}'),
    (16, 0, "nodes/0/children/2/cells/3/children/1", 11, "paragraph", "cells", 3, "<NAME>", '{"text":{"value":"more"},"type":"paragraph"}'),
    (17, 0, "nodes/1", None, "figure", "nodes", None, "", '{"caption":{"cites":[{"label":"b1"}],"value":"Cap <K>"},"description":{"links":[{"href":"https://y.org/"}],"value":"Desc"},"kind":"chart","label":"fig","type":"figure"}'),
    (18, 0, "nodes/1/children/0", 17, "image", "children", None, "", '{"alt":"alt <K>","path":"i.png","type":"image"}'),
    (19, 0, "nodes/2", None, "admonition", "nodes", None, "", '{"kind":"note","title":{"value":"T"},"type":"admonition"}'),
    (20, 0, "nodes/2/children/0", 19, "math", "children", None, "", '{"raw":{"format":"latex","value":"x^{2}"},"text":"x^2","type":"math"}'),
    (21, 0, "nodes/3", None, "layout", "nodes", None, "", '{"cells":[{"col":1,"row":0},{"col":0,"row":0}],"type":"layout"}'),
    (22, 0, "nodes/3/cells/0/children/0", 21, "paragraph", "cells", 0, "", '{"text":{"value":"right"},"type":"paragraph"}'),
    (23, 0, "nodes/3/cells/1/children/0", 21, "paragraph", "cells", 1, "", '{"text":{"value":"left"},"type":"paragraph"}'),
    (24, 0, "nodes/4", None, "paragraph", "nodes", None, "", '{"text":{"value":"last"},"type":"paragraph"}'),
    (25, 1, "footnotes/0/children/0", None, "paragraph", "children", None, "", '{"text":{"value":"note <K>"},"type":"paragraph"}'),
]
#: Every slot of the template's nodes: owner, field, entry, nodes in it.
SLOTS = [
    (1, "children", None, 3), (3, "children", None, 2), (4, "items", 0, 2), (4, "items", 1, 0), (4, "items", 2, 1), (6, "children", None, 1),
    (9, "items", 0, 1), (9, "items", 1, 0), (11, "cells", 0, 1), (11, "cells", 1, 1), (11, "cells", 2, 1), (11, "cells", 3, 2),
    (17, "children", None, 1), (19, "children", None, 1), (21, "cells", 0, 1), (21, "cells", 1, 1),
]
#: Its texts (owner, role, place, value) and edges (owner, role, family, place, target, span).
TEXTS = [
    (1, "text", 0, "<NAME>"), (2, "text", 0, "<NAME> buys in <SEG>"), (3, "text", 0, "Lists"), (5, "text", 0, "one <K>"), (6, "attribution", 0, "<SEG>"),
    (7, "text", 0, "quoted"), (9, "term", 0, "alpha"), (9, "term", 1, "beta"), (10, "text", 0, "a"), (12, "text", 0, "h1"), (13, "text", 0, "h2"), (14, "text", 0, "<K>"),
    (16, "text", 0, "more"), (17, "caption", 0, "Cap <K>"), (17, "description", 1, "Desc"), (19, "title", 0, "T"), (22, "text", 0, "right"), (23, "text", 0, "left"),
    (24, "text", 0, "last"), (25, "text", 0, "note <K>"),
]
LINKED = [
    (2, "text", "refs", 0, "fig", 0, 4), (2, "text", "refs", 1, "gone", None, None), (2, "text", "cites", 0, "b1", None, None), (2, "text", "footnotes", 0, "n1", None, None),
    (2, "text", "links", 0, "https://x.org/<K>", 5, 8), (9, "term", "refs", 0, "top", None, None), (17, "caption", "cites", 0, "b1", None, None),
    (17, "description", "links", 0, "https://y.org/", None, None),
]


def as_rows(rows: list[tuple], names: str) -> str:
    """SQL of a small table, with a customer's values filled in."""

    def value(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else filled(v)

    columns = [n.strip() for n in names.split(",")]
    return " UNION ALL ".join(f"SELECT c_custkey AS doc_key, {', '.join(f'{value(v)} AS {n}' for v, n in zip(row, columns))} FROM customer" for row in rows)


def id_of(column: str) -> str:
    """SQL of the id of a template's numbered node."""
    return f"concat('00000000-0000-4000-8000-', lpad(CAST(doc_key AS VARCHAR), 10, '0'), lpad(CAST({column} AS VARCHAR), 2, '0'))"


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, raw): a file a customer."""
    text = filled(json.dumps(_template()).replace("\\", "\\\\")).replace("VARCHAR", "STRING")
    # not by frame(), which would take the JSON's "row" and "col" for names; dealt out first, since a customer becomes a file 50 times as long
    customers, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.conf.get("spark.sql.shuffle.partitions")
    return customers.select("c_custkey", "c_name", "c_mktsegment").repartition(int(n), "c_custkey").selectExpr("CAST(c_custkey AS STRING) AS doc_key", f"{text} AS raw")


TABLES = ("customer", "orders", "supplier", "nation", "lineitem", "conversations", "documents", "pages", "events", "region", "part")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A shared text over the Parquet tables, without names registered in the session.

    Customers are merged with their orders: their file is far smaller than their
    rows, and the planner would have the driver collect and broadcast all of them.
    """
    text = sql.replace('"row"', "`row`").replace('"col"', "`col`").replace("(SELECT c.doc_key,", "(SELECT /*+ MERGE(c) */ c.doc_key,")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text))


def with_ord(df: DataFrame) -> DataFrame:
    """The two places of TREE as ``ord`` and ``parent_ord`` arrays, and where a node stands."""
    top = F.col("o2") < 0
    return df.withColumns({
        "ord": F.when(top, F.array("o1")).otherwise(F.array("o1", "o2")), "parent_ord": F.when(~top, F.array("o1")),
        "slot": F.when(top, F.lit("nodes")).otherwise(F.lit("children")), "slot_index": F.lit(None).cast("int"),
    })


def nodes(spark: SparkSession, sf_dir: str, new: bool = False) -> DataFrame:
    return with_ord(frame(spark, sf_dir, NEW_NODES if new else NODES))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_ord(frame(spark, sf_dir, EDGES)).drop("parent_ord", "slot", "slot_index")
    return out.withColumns({"span": F.array("s0", "s1"), "pool_index": F.lit(None).cast("int"), "form": F.lit(None).cast("string")})


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """TREE as the tables that every operator takes."""
    n = nodes(spark, sf_dir)
    bib = frame(spark, sf_dir, BIBLIOGRAPHY)
    marks = with_ord(frame(spark, sf_dir, MARKS)).withColumns({"start": F.col("s"), "end": F.col("e"), "pool_index": F.lit(None).cast("int")})
    text_keys = {"pool_index": F.lit(None).cast("int"), "role": F.lit("text"), "text_index": F.lit(0), "owner": F.col("node_id")}
    texts = n.where("type in ('heading', 'paragraph', 'quote', 'figure')").withColumns(text_keys).select("doc_key", "scope", "ord", "owner", "pool_index", "role", "text_index", "value")
    shown = bib.where("has_formatted").select("doc_key", F.lit(None).cast("int").alias("scope"), F.lit(None).cast("array<int>").alias("ord"), F.col("id").alias("owner"), "pool_index", F.lit("formatted").alias("role"), F.lit(0).alias("text_index"), F.col("title").alias("value"))
    return Corpus(
        documents=frame(spark, sf_dir, DOCUMENTS).withColumn("extra_keys", F.when(F.col("doc_key") % 4 == 0, F.array(F.lit("lang"), F.lit("note"))).otherwise(F.array(F.lit("note")))),
        nodes=n, entries=n.limit(0), texts=texts.unionByName(shown), marks=marks.drop("owner_type"), edges=edges(spark, sf_dir).drop("owner_type"), bibliography=bib,
        footnotes=frame(spark, sf_dir, FOOTNOTES),
    )
