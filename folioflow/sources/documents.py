"""Documents from JSON files: read, refused or parsed, and flattened into tables.

A document is one row from start to end of the read: nothing moves before the
tables are used. Parsing and flattening take one Arrow pass; a document that
can't be read becomes a row of ``errors`` and stops no other.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from folioflow.functions.canonical import digest
from folioflow.plans import model as M


class Refused(ValueError):
    """Why a text isn't a document of this format."""


@dataclass
class Corpus:
    """Tables of a corpus, all keyed by ``doc_key``."""

    documents: DataFrame
    nodes: DataFrame
    entries: DataFrame
    texts: DataFrame
    marks: DataFrame
    edges: DataFrame
    bibliography: DataFrame
    footnotes: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, raw): one row a file, the key being its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_key"), F.col("value").alias("raw"))


# --- parsing ---------------------------------------------------------------


def _want(ok: bool, what: str) -> None:
    if not ok:
        raise Refused(what)


def _typed(value: Any, kind: type, where: str) -> Any:
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):  # words are put together only where something is wrong
        raise Refused(f"{where}: {kind.__name__} expected")
    return value


_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Documents that become one Arrow batch.
AT_ONCE = 100


def _identifier(value: Any, where: str) -> str:
    if isinstance(value, str) and _UUID.fullmatch(value):
        return value
    try:
        return str(uuid.UUID(_typed(value, str, where)))
    except ValueError:
        raise Refused(f"{where}: uuid expected") from None


def _maybe(node: dict, key: str, kind: type, where: str) -> Any:
    value = node.get(key)
    return None if value is None else _typed(value, kind, f"{where}.{key}")


def _listed(node: dict, key: str, where: str) -> list:
    value = node.get(key, [])
    return value if isinstance(value, list) else _typed(value, list, f"{where}.{key}")


def load(raw: str | None, doubles: list | None = None) -> dict:
    """The JSON object of a document, or Refused: the version is looked at before the shape. ``doubles`` gets its numbers that aren't integers of at most 15 digits."""

    def noted(kind):
        return lambda x: doubles.append(y := kind(x)) or y

    try:
        doc = json.loads(raw or "", **{} if doubles is None else {"parse_float": noted(float), "parse_constant": noted(float), "parse_int": lambda x: int(x) if len(x) < 16 else noted(int)(x)})
    except ValueError as e:
        raise Refused(f"not JSON: {e}") from None
    _want(isinstance(doc, dict), "an object expected")
    version = doc.get(M.FORMAT_VERSION_KEY)
    if isinstance(version, str) and version != M.FORMAT_VERSION:
        raise Refused(f"{M.VERSION_RULE}: {version}")
    _want(isinstance(version, str), f"{M.FORMAT_VERSION_KEY}: a string expected")
    _typed(doc.get("built_at"), str, "built_at")
    _typed(_typed(doc.get("doc"), dict, "doc").get("title"), str, "doc.title")
    _typed(doc.get("nodes"), list, "nodes")
    return doc


def rich(value: Any, where: str) -> dict:
    """A checked rich text with every list present."""
    text = _typed(value, dict, where)
    if len(text) == 1 and isinstance(only := text.get("value"), str):  # most have nothing else
        return {"value": only, "lang": None, "marks": [], "refs": [], "cites": [], "footnotes": [], "links": []}
    out = {"value": _typed(text.get("value"), str, f"{where}.value"), "lang": _maybe(text, "lang", str, where)}
    out["marks"] = _listed(text, "marks", where)
    for mark in out["marks"]:
        _typed(mark, dict, where)
        for key, kind in (("start", int), ("end", int), ("kind", str)):
            _typed(mark.get(key), kind, f"{where}.marks.{key}")
    for family in M.EDGE_FAMILIES:
        out[family] = _listed(text, family, where)
        for edge in out[family]:
            _typed(_typed(edge, dict, where).get("href" if family == "links" else "label"), str, f"{where}.{family}")
            span = edge.get("text_span")
            _want(span is None or isinstance(span, list) and all(isinstance(x, int) for x in span), f"{where}.{family}.text_span")
    return out


# --- hashing ---------------------------------------------------------------

_TEXT_DEFAULTS = {"lang": None, "marks": [], "refs": [], "cites": [], "footnotes": [], "links": []}
_EDGE_DEFAULTS = {"text_span": None, "form": None, "supplement": None}
_NODE_DEFAULTS = {
    "label": None, "state_metadata": {}, "location": None, "numbering": None, "attribution": None, "lang": None, "title": None,
    "raw": None, "path": None, "alt": None, "caption": None, "description": None, "ordered": False, "items": [], "cells": [], "children": [],
}
_ENTRY_DEFAULTS = {"number": None, "checked": None, "rowspan": 1, "colspan": 1, "is_header": False, "children": []}
_BIB_DEFAULTS = {"formatted": None, "type": None, "authors": [], "title": None, "year": None, "container": None, "doi": None, "url": None, "fields": {}}
_DOC_DEFAULTS = {"authors": [], "date": None, "keywords": [], "description": None, "lang": None, "status": None, "version": None, "extra": {}}
_FREE = {"state_metadata", "fields"}


def _same(a: Any, b: Any) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def without_defaults(value: dict, defaults: dict) -> dict:
    return {k: v for k, v in value.items() if not (k in defaults and _same(v, defaults[k]))}


def bare_text(text: dict) -> dict:
    if len(text) == 1 and "value" in text:
        return {"value": text["value"]}
    out = {k: text[k] for k in ("value", *_TEXT_DEFAULTS) if k in text}
    out["marks"] = [without_defaults({k: m[k] for k in ("start", "end", "kind", "raw") if k in m}, {"raw": None}) for m in text.get("marks", [])]
    for family in M.EDGE_FAMILIES:
        names = ("href", "text_span") if family == "links" else ("label", "text_span", *(("form", "supplement") if family == "cites" else ()))
        out[family] = [without_defaults({k: e[k] for k in names if k in e}, _EDGE_DEFAULTS) for e in text.get(family, [])]
    return without_defaults(out, _TEXT_DEFAULTS)


#: Fields of each node type that a hash covers.
_HASHED = {
    "heading": ("level", "text", "heading_path"), "paragraph": ("text",), "quote": ("attribution",), "code": ("text", "lang", "title"),
    "math": ("text", "raw"), "image": ("path", "alt"), "figure": ("kind", "caption", "description", "raw"), "admonition": ("kind", "title"),
    "list": ("ordered", "items"), "terms": ("items",), "table": ("kind", "cells"), "layout": ("cells",),
}
_COVERED = {kind: ("label", "state_metadata", *own) for kind, own in _HASHED.items()}
_RICH = {("heading", "text"), ("paragraph", "text"), ("quote", "attribution"), ("figure", "caption"), ("figure", "description"), ("admonition", "title")}
_ENTRY_FIELDS = {"list": ("number", "checked"), "terms": ("term",), "table": ("row", "col", "rowspan", "colspan", "is_header"), "layout": ("row", "col", "rowspan", "colspan", "is_header")}


def node_hash(node: dict, plain: bool = False) -> str:
    """Hash of a node's own content: no id, place or number, nothing nested, no field at its default."""
    kind = node["type"]
    out: dict[str, Any] = {"type": kind}
    needed = M.REQUIRED.get(kind, ())
    for key in _COVERED[kind]:
        if key not in node:
            continue
        value = node[key]
        if key in ("items", "cells"):
            value = []
            for entry in node[key]:
                own = {k: entry[k] for k in _ENTRY_FIELDS[kind] if k in entry}
                if "term" in own:
                    own["term"] = bare_text(own["term"])
                value.append(without_defaults(own, _ENTRY_DEFAULTS))
        elif (kind, key) in _RICH and value is not None:
            value = bare_text(value)
        if key in needed or not _same(value, None if key == "kind" else _NODE_DEFAULTS.get(key)):
            out[key] = value
    return digest(out, plain)


def pool_hash(entry: dict, note: bool, plain: bool = False) -> str:
    """Hash of a pool entry without its id (and, for a note, its content)."""
    if note:
        return digest({"label": entry["label"]}, plain)
    own = {k: entry[k] for k in ("label", *_BIB_DEFAULTS) if k in entry}
    if own.get("formatted") is not None:
        own["formatted"] = bare_text(own["formatted"])
    return digest(without_defaults(own, _BIB_DEFAULTS), plain)


def hashable(node: dict) -> bool:
    """Whether no field that only a hash reads can refuse a node without doubles whose other fields were checked: no list in the place of one, or a null term."""
    items = node.get("items", [])
    return isinstance(items, list) and isinstance(node.get("cells", []), list) and not (node["type"] == "terms" and any(x.get("term", x) is None for x in items))


def bare_doc(doc: dict) -> dict:
    out = without_defaults({k: doc[k] for k in M.DOC_FIELDS if k in doc}, _DOC_DEFAULTS)
    if "date" in out:
        out["date"] = without_defaults({k: out["date"][k] for k in ("year", "month", "day") if k in out["date"]}, {"month": None, "day": None})
    return out


# --- flattening ------------------------------------------------------------


def slots_of(node: dict) -> Iterator[tuple[str, int | None, list]]:
    """(field, entry index, nested nodes) of each place that holds nodes."""
    kind = node["type"]
    if kind in ("heading", "quote", "figure", "admonition"):
        yield "children", None, node.get("children") or []
    for field in ("items",) if kind in ("list", "terms") else ("cells",) if kind in ("table", "layout") else ():
        for i, entry in enumerate(node.get(field) or []):
            yield field, i, entry.get("children") or []


def text_row(text: dict, role: str, index: int) -> dict:
    if not (text.get("marks") or text.get("refs") or text.get("cites") or text.get("footnotes") or text.get("links")):
        return {"role": role, "text_index": index, "value": text["value"], "lang": text.get("lang"), "marks": [], "edges": []}
    edges = [
        {"family": f, "edge_index": i, "label": e.get("label"), "href": e.get("href"), "span": e.get("text_span"), "form": e.get("form"), "supplement": e.get("supplement")}
        for f in M.EDGE_FAMILIES for i, e in enumerate(text.get(f, []))
    ]
    marks = [
        {"start": m["start"], "end": m["end"], "kind": m["kind"], "raw_format": (m.get("raw") or {}).get("format"), "raw_value": (m.get("raw") or {}).get("value")}
        for m in text.get("marks", [])
    ]
    return {"role": role, "text_index": index, "value": text["value"], "lang": text.get("lang"), "marks": marks, "edges": edges}


def own_texts(node: dict) -> list[dict]:
    """A node's own texts in order, as rows."""
    kind = node["type"]
    found = [(role, node.get(role)) for role in M.OWN_TEXTS.get(kind, ())]
    if kind == "terms":
        found = [("term", item.get("term")) for item in node.get("items") or []]
    return [text_row(rich(t, role), role, i) for i, (role, t) in enumerate((r, t) for r, t in found if t is not None)]


_REST = ("heading_path", "number", "number_name", "lang", "title", "kind", "image_path", "alt", "ordered")


def flatten(doc: dict, plain: bool = False, needed: set[str] | None = None) -> dict:
    """A document as arrays of rows. A stack holds the way down, so depth has no limit. ``plain`` as in ``digest``.

    ``needed`` names the columns and fields that are told (``field`` or
    ``field.inner``; None: all), of a document with nothing in it that only a
    hash could refuse, such as half a surrogate pair; what they don't name is
    checked, but not made.
    """
    nodes, entries = [], []
    told = lambda *names: needed is None or not needed.isdisjoint(names)
    hashes, texts, rest, all_entries = told("nodes.node_hash"), told("nodes.texts"), told(*[f"nodes.{c}" for c in _REST]), told("entries")
    lean = plain and not hashes

    def walk(roots: list, scope: int, prefix: str) -> None:
        stack = [(node, [i], f"{prefix}/{i}", 0, None, prefix.split("/")[-1], None, []) for i, node in reversed(list(enumerate(roots)))]
        while stack:
            node, order, path, depth, parent, slot, at, above = stack.pop()
            if not isinstance(node, dict):
                _typed(node, dict, path)
            kind = node.get("type")
            if kind not in M.NODE_TYPES:
                raise Refused(f"{path}: unknown type")
            for key in M.REQUIRED.get(kind, ()):
                if node.get(key) is None:
                    raise Refused(f"{path}.{key}: missing")
            location, numbering, label, id_ = node.get("location"), node.get("numbering"), node.get("label"), node.get("id")
            if not (location is None and numbering is None and label is None):
                location, numbering, label = _maybe(node, "location", dict, path), _maybe(node, "numbering", dict, path), _maybe(node, "label", str, path)
            source = node.get("text") if kind in ("code", "math") else None
            inner = list(slots_of(node))
            row = {
                "scope": scope, "ord": order, "path": path, "node_id": id_ if isinstance(id_, str) and _UUID.fullmatch(id_) else _identifier(id_, path), "type": kind,
                "label": label, "depth": depth, "parent_ord": parent, "slot": slot, "slot_index": at,
                "page": location and _typed(location.get("page"), int, path), "ctx_heading_path": above,
                "level": _typed(node["level"], int, path) if kind == "heading" else None,
                "plain": None if source is None else _typed(source, str, path), "slots": len(inner),
            }
            if rest:
                row |= {
                    "heading_path": node.get("heading_path") if kind == "heading" else None, "number": numbering and numbering.get("value"), "number_name": numbering and numbering.get("name"),
                    "lang": node.get("lang"), "title": node.get("title") if kind == "code" else None, "kind": node.get("kind"), "image_path": node.get("path"), "alt": node.get("alt"),
                    "ordered": bool(node.get("ordered", False)) if kind == "list" else None,
                }
            if not lean or not hashable(node):
                row["node_hash"] = node_hash(node, plain)
            if texts or kind == "terms":
                row["texts"] = own_texts(node)
            else:
                for role in M.OWN_TEXTS.get(kind, ()):
                    t = node.get(role)
                    if t is not None and not (isinstance(t, dict) and len(t) == 1 and isinstance(t.get("value"), str)):
                        text_row(rich(t, role), role, 0)
            nodes.append(row)
            for field in ("items", "cells"):
                for i, entry in enumerate(node.get(field) or []):
                    _typed(entry, dict, path)
                    if all_entries:
                        entries.append({"scope": scope, "ord": order, "entry": i} | {k: entry.get(k, d) for k, d in (("number", None), ("checked", None), ("row", None), ("col", None), ("rowspan", 1), ("colspan", 1), ("is_header", False))})
            below = node["heading_path"] if kind == "heading" else above
            for field, i, children in reversed(inner):
                where = f"{path}/{field}" + ("" if i is None else f"/{i}/children")
                for j, child in reversed(list(enumerate(children))):
                    stack.append((child, [*order, j] if i is None else [*order, i, j], f"{where}/{j}", depth + 1, order, field, i, below))

    walk(doc["nodes"], 0, "nodes")
    note_hashes, bib_hashes = (not plain or told(f"{pool}.hash") for pool in ("footnotes", "bibliography"))
    notes = []
    for i, note in enumerate(_listed(doc, "footnotes", "document")):
        _typed(note, dict, "footnotes")
        notes.append({"pool_index": i, "id": _identifier(note.get("id"), "footnotes"), "label": _typed(note.get("label"), str, "footnotes"), "hash": pool_hash(note, True, plain) if note_hashes else None})
        walk(_listed(note, "children", "footnotes"), 1 + i, f"footnotes/{i}/children")
    bibs = []
    for i, bib in enumerate(_listed(doc, "bibliography", "document")):
        _typed(bib, dict, "bibliography")
        shown = bib.get("formatted")
        bibs.append({
            "pool_index": i, "id": _identifier(bib.get("id"), "bibliography"), "label": _typed(bib.get("label"), str, "bibliography"),
            "has_fields": any(bool(bib.get(k)) for k in M.BIB_FIELDS), "formatted": None if shown is None else text_row(rich(shown, "formatted"), "formatted", 0),
            "shown": None, "hash": pool_hash(bib, False, plain) if bib_hashes else None,
        })
    extra, bare = _typed(doc["doc"].get("extra") or {}, dict, "doc.extra"), bare_doc(doc["doc"])
    return {
        "id": doc.get("id"), "version": doc[M.FORMAT_VERSION_KEY], "built_at": doc["built_at"], "title": doc["doc"]["title"],
        "doc_json": json.dumps(doc["doc"], ensure_ascii=False) if told("doc_json") else None, "extra_keys": list(extra), "doc_fields_json": json.dumps(bare, ensure_ascii=False) if told("doc_fields_json") else None,
        "nodes": nodes, "entries": entries, "bibliography": bibs, "footnotes": notes,
    }


def narrowed(kind: DataType, paths: list[str]) -> DataType:
    """A type with the fields that are named, as ``field`` or ``field.inner``, and no others."""
    if isinstance(kind, ArrayType):
        return ArrayType(narrowed(kind.elementType, paths))
    fields = []
    for f in kind:
        inner = [p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name]
        if inner:
            fields.append(StructField(f.name, f.dataType if "" in inner else narrowed(f.dataType, inner)))
    return StructType(fields)


def as_column(values: list, kind: pa.DataType) -> pa.Array:
    """Rows as an Arrow array, field by field: far quicker than struct by struct."""
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        ends = [0, *itertools.accumulate(len(v or ()) for v in values)]
        inner = as_column([x for v in values if v for x in v], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))
    if pa.types.is_struct(kind):
        fields = [as_column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.array(values, kind)


def parse(files: DataFrame, only: str | None = None) -> DataFrame:
    """From (doc_key, raw): the flattened document, or ``reason`` why it isn't one.

    ``only`` names the columns and fields that are told, as in ``narrowed``;
    documents are read and checked in whole all the same.
    """
    schema = StructType.fromDDL(M.PARSED + ", reason string")
    if only is not None:
        schema = narrowed(schema, ["doc_key", "reason", *only.split()])
    arrow = to_arrow_schema(schema)
    needed = None
    if only is not None:
        inner = lambda t: inner(t.elementType) if isinstance(t, ArrayType) else t.names if isinstance(t, StructType) else []
        needed = {f.name for f in schema} | {f"{f.name}.{c}" for f in schema for c in inner(f.dataType)}

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(start, AT_ONCE), []
                gc.disable()  # thousands of objects, none of them in a cycle
                try:
                    for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        row, doubles = dict.fromkeys(arrow.names) | {"doc_key": key, "raw": raw}, []
                        try:
                            doc = load(raw, doubles)
                            # half a surrogate pair is refused where it is hashed, so such a document is hashed in whole
                            plain = not doubles
                            row |= flatten(doc, plain, None if not plain or "\\ud" in raw or "\\uD" in raw else needed)
                        except (Refused, ValueError, TypeError, KeyError, AttributeError) as e:
                            row["reason"] = str(e) or type(e).__name__
                        rows.append(row)
                    told = pa.RecordBatch.from_arrays([as_column([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)
                finally:
                    gc.enable()
                yield told

    return files.select("doc_key", "raw").mapInArrow(run, schema)


def errors(parsed: DataFrame) -> DataFrame:
    """(doc_key, reason) of what couldn't be read."""
    return parsed.where("reason is not null").select("doc_key", "reason")


def corpus(parsed: DataFrame) -> Corpus:
    """The tables of all documents that could be read; each is a projection of one parsed row. What wasn't parsed gives no table, but None."""
    ok, has = parsed.where("reason is null"), {f.name: f.dataType for f in parsed.schema}
    rows = lambda name: ok.select("doc_key", F.explode(name).alias("x")).select("doc_key", "x.*") if name in has else None
    nodes, bibs = rows("nodes"), rows("bibliography")
    texts = marks = edges = None
    if nodes is not None and bibs is not None and "texts" in nodes.columns and "formatted" in bibs.columns:
        of_nodes = nodes.select("doc_key", "scope", "ord", F.col("node_id").alias("owner"), F.lit(None).cast("int").alias("pool_index"), F.explode("texts").alias("t"))
        of_bibs = bibs.where("formatted is not null").select("doc_key", F.lit(None).cast("int").alias("scope"), F.lit(None).cast("array<int>").alias("ord"), F.col("id").alias("owner"), "pool_index", F.col("formatted").alias("t"))
        told = of_nodes.unionByName(of_bibs).select("doc_key", "scope", "ord", "owner", "pool_index", "t.*")
        keys = ["doc_key", "scope", "ord", "owner", "pool_index", "role", "text_index"]
        texts = told.drop("marks", "edges")
        if "marks" in told.columns:
            marks = told.select(*keys, F.length("value").alias("length"), F.posexplode("marks").alias("mark_index", "m")).select(*keys, "length", "mark_index", "m.*")
        if "edges" in told.columns:
            edges = told.select(*keys, F.length("value").alias("length"), F.explode("edges").alias("e")).select(*keys, "length", "e.*")
    of_documents = [c for c in ("id", "version", "built_at", "title", "doc_json", "doc_fields_json", "extra_keys", "raw") if c in has]
    return Corpus(
        documents=ok.select("doc_key", *of_documents),
        nodes=None if nodes is None else nodes.drop("texts"),
        entries=rows("entries"),
        texts=texts,
        marks=marks,
        edges=edges,
        bibliography=None if bibs is None else bibs.drop("formatted"),
        footnotes=rows("footnotes"),
    )
