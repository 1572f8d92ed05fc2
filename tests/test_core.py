"""Documents end to end: loading, hashing, positions, validation, matching, building, rendering."""

import hashlib
import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import canonical, inline
from folioflow.functions import scalars as S
from folioflow.functions.blocks import MarkdownDocument, label_text
from folioflow.functions.html import HtmlDocument
from folioflow.operators import grids, links, match, traversal, validate
from folioflow.plans import adapters
from folioflow.sources import declarations, documents

HEAD = {"cnd_version": "0.5.0", "built_at": "2024-01-02T03:04:05+00:00", "doc": {"title": "T"}}


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def para(n, value, **more):
    return {"id": uid(n), "type": "paragraph", "text": {"value": value}} | more


def sample():
    table = {"id": uid(5), "type": "table", "cells": [{"row": r, "col": c, "is_header": r == 0, "children": [para(10 + 3 * r + c, f"r{r}c{c}")]} for r in range(2) for c in range(2)]}
    body = [{"id": uid(1), "type": "heading", "level": 1, "heading_path": ["A"], "label": "a", "text": {"value": "A"}, "children": [
        para(2, "see me", label="p", **{"text": {"value": "see me", "marks": [{"start": 0, "end": 3, "kind": "strong"}], "refs": [{"label": "a", "text_span": [0, 3]}], "cites": [{"label": "gone"}], "links": [{"href": "https://x.org/(1)", "text_span": [4, 6]}]}}),
        {"id": uid(3), "type": "list", "ordered": True, "items": [{"number": 3, "children": [para(4, "item")]}, {"children": []}]},
        table,
    ]}]
    return HEAD | {"nodes": body, "footnotes": [{"id": uid(50), "label": "n", "children": [para(51, "note")]}], "bibliography": [{"id": uid(60), "label": "b", "title": "B", "year": 1999}]}


def corpus_of(spark, docs):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    parsed = documents.parse(spark.createDataFrame(rows, "doc_key string, raw string")).cache()
    return documents.corpus(parsed), parsed


def test_walk_paths_and_positions(spark):
    c, _ = corpus_of(spark, [sample()])
    walked = traversal.walk_full(traversal.positions(c.nodes)).orderBy("walk_order").collect()
    assert [r.path for r in walked] == [
        "nodes/0", "nodes/0/children/0", "nodes/0/children/1", "nodes/0/children/1/items/0/children/0", "nodes/0/children/2",
        *(f"nodes/0/children/2/cells/{k}/children/0" for k in range(4)), "footnotes/0/children/0",
    ]
    assert [r.depth for r in walked] == [0, 1, 1, 2, 1, 2, 2, 2, 2, 0]
    assert [r.doc_index for r in walked] == [*range(1, 10), 1] and walked[0].doc_count == 9 and walked[0].page_index is None
    pruned = traversal.prune_below(traversal.positions(c.nodes), F.col("type") == "table").collect()
    assert len(pruned) == 6 and {r.doc_count for r in pruned if r.scope == 0} == {9}
    assert {r.path for r in traversal.expand_headings(c.nodes.where("scope = 0")).collect()} == {"nodes/0", *(f"nodes/0/children/{k}" for k in range(3))}
    assert not traversal.paginated(c.nodes, c.documents).first().paginated
    text = {tuple(r.ord): r.plain for r in traversal.blocks_plain(c.nodes, c.texts).where("scope = 0").collect()}
    assert text[(0,)] == "A see me item r0c0 r0c1 r1c0 r1c1" and text[(0, 1)] == "item"


def test_bad_files_become_reasons(spark):
    docs = ["", "{", "[]", json.dumps(HEAD | {"nodes": 3}), json.dumps(HEAD | {"cnd_version": "0.4.0"}), json.dumps(HEAD | {"nodes": [{"type": "x", "id": uid(1)}]}), json.dumps(HEAD | {"nodes": [{"type": "paragraph", "id": "no", "text": {"value": ""}}]}), sample()]
    c, parsed = corpus_of(spark, docs)
    assert {r.doc_key for r in documents.errors(parsed).collect()} == set("0123456") and c.documents.count() == 1
    assert "0.4.0" in documents.errors(parsed).where("doc_key = '4'").first().reason


def test_hash_covers_content_only():
    a = para(1, "x")
    same = [para(2, "x"), a | {"location": {"page": 3}}, a | {"state_metadata": {}}, {**a, "text": {"value": "x", "marks": [], "lang": None}}]
    assert len({documents.node_hash(n) for n in [a, *same]}) == 1
    other = [para(1, "y"), a | {"label": "l"}, {**a, "text": {"value": "x", "lang": "en"}}]
    assert len({documents.node_hash(n) for n in [a, *other]}) == 4
    assert documents.node_hash(para(1, "é")) == documents.node_hash(para(1, unicodedata.normalize("NFC", "é")))


def test_documents_are_dealt_out_and_hashed_alike(spark):
    from folioflow.plans import adapters

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert adapters.whole_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n > 1
    odd = [{}, {"b": 1, "a": "q\"\\\n\x01\x7f/"}, {"x": 1e3}, {"x": 0.1}, {"x": 2**53 - 1}, {"é": "e\u0301"}, {"\U0001f600": 1, "\ufb33": True}, {"x": None, "y": [False, -1]}]
    docs = [HEAD | {"nodes": [para(1, "é" if k == 3 else "plain", state_metadata=x)]} for k, x in enumerate(odd)] * 30
    c, parsed = corpus_of(spark, [*docs, HEAD | {"nodes": [para(1, "x", state_metadata={"x": 2**53})]}])
    got = {int(r.doc_key): r.node_hash for r in c.nodes.collect()}
    assert got == {k: documents.node_hash(d["nodes"][0]) for k, d in enumerate(docs)} and documents.errors(parsed).count() == 1


def test_parts_of_documents_are_told_alone(spark, capsys):
    code = {"id": uid(2), "type": "code", "text": "x", "state_metadata": {"x": 1e3}}
    docs = [HEAD | {"nodes": [code]}, sample(), HEAD | {"nodes": [code | {"state_metadata": {"x": 2**53}}]}, HEAD | {"nodes": [code | {"label": 1}]}, HEAD | {"nodes": [{"id": uid(1), "type": "list", "items": None}]}, "{"]
    files = spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc_key string, raw string")
    whole, part = documents.parse(files).cache(), documents.parse(files, "nodes.scope nodes.ord nodes.parent_ord nodes.node_id nodes.node_hash entries.scope entries.ord entries.entry").cache()
    assert sorted(documents.errors(whole).collect()) == sorted(documents.errors(part).collect()) and documents.errors(part).count() == 4
    c, all_ = documents.corpus(part), documents.corpus(whole)
    assert c.nodes.columns == ["doc_key", "scope", "ord", "node_id", "parent_ord", "node_hash"] and c.texts is None and c.bibliography is None
    assert sorted(c.nodes.collect()) == sorted(all_.nodes.select(c.nodes.columns).collect()) and sorted(c.entries.collect()) == sorted(all_.entries.select(c.entries.columns).collect())
    assert c.nodes.where("doc_key = '0'").first().node_hash == documents.node_hash(code)  # a code's text once decided how its numbers were written
    told = all_.nodes.select("doc_key", "scope", "ord", "type", "node_id", "parent_ord", "slot_index")
    for joined in (traversal.with_parent(told), traversal.slots(told, all_.entries)):
        joined.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_canonical_numbers_and_keys():
    for x, text in {1e3: "1000", 0.1: "0.1", 1e21: "1e+21", 1e-7: "1e-7", 1.5e-5: "0.000015", -0.0: "0", 123456789012345680000.0: "123456789012345680000", 5e-324: "5e-324"}.items():
        assert canonical.number_text(x) == text
    assert canonical.dumps({"b": 1, "a": [True, None, "\x01\n\""], "\U0001f600": 0, "דּ": 0}) == '{"a":[true,null,"\\u0001\\n\\""],"b":1,"\U0001f600":0,"דּ":0}'
    with pytest.raises(ValueError):
        canonical.dumps(float("nan"))


def test_column_hash_equals_document_hash(spark):
    texts = ['plain', 'q"uo\\te\n', "tab\tand \x01 control", "日本 é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.paragraph_hash(F.col("t")).alias("h")).collect()
    assert all(r.h == documents.node_hash(para(1, r.t)) for r in got)


def test_rules_name_what_is_wrong(spark):
    bad = sample()
    bad["nodes"].append(para(1, "dup", label="a"))
    bad["nodes"].append(para(70, "marks", text={"value": "marks", "marks": [{"start": 2, "end": 4, "kind": "code"}, {"start": 0, "end": 3, "kind": "strong"}, {"start": 3, "end": 9, "kind": "strong"}], "footnotes": [{"label": "b", "text_span": [4, 2]}]}, location={"page": 1}))
    bad["bibliography"].append({"id": uid(61), "label": "e", "year": 0})
    bad["doc"] = {"title": "T", "extra": {"lang": "x", "own": "y"}}
    c, _ = corpus_of(spark, [bad, sample()])
    found = validate.validate(c).where("doc_key = '0'").orderBy("seq").collect()
    rules = [r.rule for r in found]
    assert set(rules) == {"id-not-unique", "label-not-unique", "link-unresolved", "link-wrong-domain", "text-span-out-of-bounds", "mark-out-of-bounds", "mark-not-canonical", "mark-same-kind-overlap", "mark-atomic-crossed", "pagination-partial", "bib-entry-empty", "doc-extra-shadows-field"}
    assert [r.location for r in found if r.rule == "id-not-unique"] == [f"paragraph {uid(1)}"]
    assert "already claimed by heading" in next(r.message for r in found if r.rule == "label-not-unique")
    ok = {r.doc_key: r.ok for r in validate.results(c.documents, validate.validate(c)).collect()}
    assert ok == {"0": False, "1": False}  # the sample cites a label that nothing carries


def test_labels_go_to_the_first(spark):
    c, _ = corpus_of(spark, [sample()])
    index = links.label_index(links.claims(c.nodes, c.bibliography, c.footnotes))
    assert {r.label: r.target_domain for r in index.collect()} == {"a": "node", "p": "node", "b": "bibliography", "n": "footnote"}
    assert [(r.label, r.owner) for r in links.incoming(c.edges, index).collect()] == [("a", uid(2))]


def renamed(doc):
    text = json.dumps(doc)
    for n in range(100):
        text = text.replace(uid(n), uid(n + 1000))
    return json.loads(text)


def test_diff_and_ids_handed_on(spark):
    new = renamed(sample())
    new["nodes"][0]["children"].insert(0, para(2000, "new"))
    new["nodes"][0]["children"][1]["text"]["value"] = "see us"
    del new["nodes"][0]["children"][2]["items"][0]
    a, _ = corpus_of(spark, [sample()])
    b, _ = corpus_of(spark, [new])
    changes = match.diff(match.entries(a.nodes, a.footnotes), match.entries(b.nodes, b.footnotes)).cache()
    status = {r.new_id or r.old_id: (r.status, r.matched_by) for r in changes.collect()}
    assert status[uid(1001)] == ("unchanged", "label") and status[uid(1002)] == ("changed", "label") and status[uid(2000)] == ("added", None)
    assert status[uid(4)] == ("removed", None) and status[uid(1005)] == ("moved", "hash")
    m = match.remap(changes)
    assert match.remap_conflicts(m).count() == 0
    ids = {r.new_id: r.id for r in m.collect()}
    assert ids[uid(1005)] == uid(5) and ids[uid(2000)] == uid(2000)
    assert {r.status for r in match.match_pool(a.bibliography, b.bibliography).collect()} == {"unchanged"}


def test_matching_sends_nothing_to_the_driver(spark, monkeypatch):
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(match, "cut", told)
    schema = "doc_key int, node_id string, label string, type string, path string, hash string, walk_order int, subtree string"
    entry = lambda side, n, label, path, content, below="": (1, f"{side}{n}", label, "quote", path, content, n, below)
    old = spark.createDataFrame([entry("o", 1, "a", "p1", "h1"), entry("o", 2, None, "p2", "h2"), entry("o", 3, None, "p3", "h2"), entry("o", 4, "a", "p4", "h4"), entry("o", 5, None, "p5", "h5"), entry("o", 6, None, "p6", "h6", "d1"), entry("o", 7, None, "p7", "h7")], schema)
    new = spark.createDataFrame([entry("n", 1, None, "p3", "h2"), entry("n", 2, "a", "p9", "h8"), entry("n", 3, None, "p8", "h2"), entry("n", 4, None, "p5", "h9"), entry("n", 5, None, "q6", "h6", "d2"), entry("n", 6, None, "q7", "h0")], schema)
    pairs, gone, come = match.match_entries(old, new)
    assert {(r.matched_by, r.old_node_id, r.new_node_id) for r in pairs.collect()} == {("label", "o1", "n2"), ("hash+path", "o3", "n1"), ("hash", "o2", "n3"), ("path+type", "o5", "n4"), ("container-hash", "o6", "n5")}
    assert {r.node_id for r in gone.collect()} == {"o4", "o7"} and {r.node_id for r in come.collect()} == {"n6"}
    for df in (pairs, gone, come):
        told(df)
    assert not [p for p in plans if "Broadcast" in p] and len(plans) == 4


def test_only_what_is_needed_is_made_and_all_is_checked(spark):
    whole, lean = documents.flatten(sample(), True), documents.flatten(sample(), True, {"nodes", "nodes.path"})
    assert [n["path"] for n in lean["nodes"]] == [n["path"] for n in whole["nodes"]] and not any("node_hash" in n for n in lean["nodes"])
    bad = [sample() for _ in range(6)]
    bad[1]["nodes"][0]["children"][1]["items"] = 0
    bad[2]["nodes"][0]["children"][0]["text"]["marks"][0]["start"] = "0"
    bad[3]["nodes"][0]["children"].append({"id": uid(70), "type": "terms", "items": [{"term": None}]})
    bad[4]["nodes"][0]["state_metadata"] = {"a": "\ud800"}
    bad[5]["nodes"][0]["state_metadata"] = {"a": 12345678901234567890}
    files = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(bad)], "doc_key string, raw string")
    refused = [{r.doc_key for r in documents.errors(documents.parse(files, only)).collect()} for only in (None, "nodes.path")]
    assert refused == [{"1", "2", "3", "4", "5"}] * 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_builds_send_no_table_to_the_driver(spark):
    d = "/root/testdata/sf0.001"
    notes = spark.createDataFrame([(0, 0, "a"), (0, 2, "c"), (1, 1, None)], "doc_key int, pool_index int, label string")
    for df in (adapters.nodes(spark, d), adapters.nodes(spark, d, new=True), match.match_path(adapters.nodes(spark, d), notes)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    nodes = spark.createDataFrame([(0, 0, "nodes/0"), (0, 1, "footnotes/0/children/0"), (0, 3, "footnotes/2/children/1/children/0"), (1, 2, "footnotes/1/children/0"), (2, 0, "nodes/1")], "doc_key int, scope int, path string")
    got = {r.path: r.match_path for r in match.match_path(nodes, notes).collect()}
    assert got == {"nodes/0": "nodes/0", "footnotes/0/children/0": "footnotes/a/children/0", "footnotes/2/children/1/children/0": "footnotes/c/children/1/children/0", "footnotes/1/children/0": "footnotes/children/0", "nodes/1": "nodes/1"}


def test_digest_of_an_empty_slot(spark):
    nodes = spark.createDataFrame([(1, 0, [0], None, None, 0, "a", 1), (1, 0, [1], None, None, 0, "b", 2), (1, 0, [2], None, None, 0, "c", 0)], "doc_key int, scope int, ord array<int>, parent_ord array<int>, slot_index int, depth int, node_hash string, slots int")
    got = {r.ord[0]: r.subtree for r in match.subtree_digests(nodes).collect()}
    assert got == {0: hashlib.sha256(b"[|]").hexdigest(), 1: hashlib.sha256(b"[|]|[|]").hexdigest(), 2: ""}


def test_build_counts_and_refuses():
    decl = {"declaration_version": "0.2.0", "doc": {"title": "D"}, "nodes": [
        {"type": "heading", "level": 1, "text": "One", "numbering": {"name": "Section"}, "children": [
            {"type": "heading", "level": 3, "text": "Deep"}, {"type": "figure", "children": [{"type": "image", "path": "x.png"}]}, {"type": "math", "text": "x"},
            {"type": "list", "ordered": True, "items": [{}, {"number": 7}, {}]}, {"type": "list", "items": [{"number": 4}]}]},
        {"type": "heading", "level": 1, "text": "Two"}]}
    doc, problems = declarations.build(declarations.load(json.dumps(decl), False), numbering=True)
    one, two = doc["nodes"]
    assert not problems and one["numbering"] == {"value": "1", "name": "Section"} and two["heading_path"] == ["2 Two"]
    deep, figure, formula, ordered, bullets = one["children"]
    assert deep["heading_path"] == ["1 One", "1.0.1 Deep"] and figure["numbering"]["value"] == "1" and formula["numbering"]["value"] == "(1)"
    assert [i.get("number") for i in ordered["items"]] == [1, 7, 8] and bullets["items"][0].get("number") is None
    assert declarations.build(decl)[1][0][0] == "numbering-without-engine"
    for bad in ({"extra": 1}, {"declaration_version": "0.1.0"}, {"nodes": [{"type": "paragraph", "text": "x", "id": "1"}]}, {"nodes": [{"type": "heading", "level": 0, "text": "x"}]}):
        with pytest.raises(documents.Refused):
            declarations.build(declarations.load(json.dumps(decl | bad), False))


def test_markdown_and_html_of_a_document():
    text, warnings = MarkdownDocument(sample()).convert()
    assert "# A" in text and "**see** [me](<https://x.org/(1)>)\n[a] [@gone]" in text and "3. item\n2." in text
    assert "| r0c0 | r0c1 |\n| --- | --- |\n| r1c0 | r1c1 |" in text and "[^n]: note" in text and "- **b** — (1999). B" in text
    assert len(warnings) == 2
    page, _ = HtmlDocument(sample()).convert()
    assert '<h1 id="a">A</h1>' in page and '<p id="p"><strong>see</strong> <a class="cnd-link" href="https://x.org/(1)">me</a></p>' in page
    assert "<th>r0c0</th>" in page and '<span class="cnd-unresolved">[gone]</span>' in page


def test_crossing_marks_nest():
    text = {"value": "abcdef", "marks": [{"start": 0, "end": 4, "kind": "strong"}, {"start": 2, "end": 6, "kind": "emph"}]}
    assert inline.render(text, "html")[0] == "<strong>ab<em>cd</em></strong><em>ef</em>" or inline.render(text, "html")[0] == "<strong>ab</strong><em><strong>cd</strong>ef</em>"
    rng = random.Random(1)
    for _ in range(200):
        value = "".join(rng.choice("ab *_`~<&\n") for _ in range(12))
        marks = [{"start": (a := rng.randrange(12)), "end": rng.randrange(a, 13), "kind": rng.choice(["strong", "emph", "code", "sup"])} for _ in range(3)]
        html = inline.render({"value": value, "marks": marks}, "html")[0]
        plain = __import__("re").sub(r"<[^>]*>", "", html)
        assert __import__("html").unescape(plain) == value


def test_column_escapes_equal_the_text_functions(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1 *_`~<&#>-+=|.)\n\\[]!;é") for _ in range(rng.randrange(30))) for _ in range(300)] + ["&amp; &#12;", "1. x", "# h", "---", "a_b_", "\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.escape_inline(F.col("t")).alias("i"), S.escape_block(F.col("t")).alias("b")).collect()
    assert all(r.i == inline.escape_inline(r.t) for r in rows)
    assert all(r.b == inline.escape_block(r.t) for r in rows)


def test_labels_survive_case_folding():
    assert label_text("fn-1") == "fn-1" and label_text("Fn") == "%46n" and label_text("ı ß") == "%C4%B1%20%C3%9F"


def test_ordinals_and_numbers_equal_a_simulation(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(30):
        count, levels = 0, []
        for i in range(12):
            own = rng.choice([None, None, rng.randrange(20)])
            level = rng.randint(1, 3)
            count = count + 1 if own is None else own
            levels = (levels + [0] * level)[:level]
            levels[-1] += 1
            rows.append((doc, i, own, True, level))
            want[doc, i] = (count, ".".join(map(str, levels)))
    df = spark.createDataFrame(rows, "doc_key long, i int, own int, ordered boolean, level int")
    got = grids.heading_numbers(grids.list_ordinals(df, ["doc_key"], "i", "own", "ordered"), ["i"], 3).collect()
    assert {(r.doc_key, r.i): (r.ordinal, r.number) for r in got} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["min_slice", "walk_full", "pos_page", "prune_pred", "blocks_plain", "incoming", "v_mark_atomic", "header_rows", "row_labels", "md_table", "list_ordinals", "ctr_heading", "html_escape", "subtree_digest", "build_hashes", "whole_walk", "slots", "whole_edges", "whole_hashes", "content_hash"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from folioflow import catalog

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    df = catalog.QUERIES[name](spark, d)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))
