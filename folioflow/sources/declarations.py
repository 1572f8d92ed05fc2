"""Declarations (the authored form, YAML or JSON) compiled into documents.

A declaration is a document without what can be derived: ids, heading paths,
ordinals and numbers. Each is compiled by itself in an Arrow pass; what is
wrong with one becomes rows of errors, and stops no other.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.plans import model as M
from folioflow.sources.documents import Refused

_BASE = ("type", "label", "state_metadata")
# The fields that each declared object may have.
NODE_FIELDS = {
    "heading": ("level", "text", "numbering", "children"), "paragraph": ("text",), "quote": ("attribution", "children"), "code": ("text", "lang", "title"),
    "math": ("text", "raw", "numbering"), "image": ("path", "alt"), "figure": ("kind", "caption", "description", "numbering", "children", "raw"),
    "admonition": ("kind", "title", "children"), "list": ("ordered", "items"), "terms": ("items",), "table": ("kind", "cells"), "layout": ("cells",),
}
ENTRY_FIELDS = {"list": ("number", "checked", "children"), "terms": ("term", "children"), "table": ("row", "col", "rowspan", "colspan", "is_header", "children")}
ENTRY_FIELDS["layout"] = ENTRY_FIELDS["table"]
TOP_FIELDS = ("declaration_version", "source", "doc", "nodes", "bibliography", "footnotes")
BIB_FIELDS = ("label", "formatted", "type", "authors", "title", "year", "container", "doi", "url", "fields")
_RICH_FIELDS = ("attribution", "caption", "description")


def load(raw: str | None, yaml_text: bool) -> dict:
    """The declaration, or Refused: syntax, then version, then shape."""
    try:
        if yaml_text:
            import yaml

            out = yaml.safe_load(raw or "")
        else:
            out = json.loads(raw or "")
    except ImportError:
        raise Refused("no YAML reader is installed") from None
    except Exception as e:  # any syntax error of either reader
        raise Refused(f"can't be read: {e}") from None
    if not isinstance(out, dict):
        raise Refused("an object expected")
    version = out.get("declaration_version")
    if isinstance(version, str) and version != M.DECLARATION_VERSION:
        raise Refused(f"{M.DECLARATION_RULE}: {version}")
    strict(out, TOP_FIELDS, "declaration")
    if not isinstance(version, str) or not isinstance(out.get("doc"), dict) or not isinstance(out.get("nodes"), list):
        raise Refused("declaration_version, doc and nodes are required")
    return out


def strict(value: Any, allowed: tuple[str, ...], where: str) -> dict:
    if not isinstance(value, dict):
        raise Refused(f"{where}: an object expected")
    extra = sorted(set(map(str, value)) - set(allowed))
    if extra:
        raise Refused(f"{where}: unknown key {', '.join(extra)}")
    return value


def rich(value: Any, where: str) -> dict:
    """A plain string stands for a text with that value."""
    if isinstance(value, str):
        return {"value": value}
    if not isinstance(value, dict) or not isinstance(value.get("value"), str):
        raise Refused(f"{where}: a text expected")
    return value


class Compiler:
    """One declaration's compilation: counters run in reading order over the body and then the footnotes."""

    def __init__(self, numbering: bool, new_id=lambda: str(uuid.uuid4())):
        self.numbering, self.new_id = numbering, new_id
        self.levels: list[int] = []
        self.figures: dict[str, int] = {}
        self.formulas = 0
        self.problems: list[tuple[str, str]] = []

    def number(self, node: dict) -> str:
        kind = node["type"]
        if kind == "heading":
            level = node["level"]
            self.levels = (self.levels + [0] * level)[:level]
            self.levels[-1] += 1
            return ".".join(map(str, self.levels))
        if kind == "math":
            self.formulas += 1
            return f"({self.formulas})"
        counter = node.get("kind") or next((c.get("type") for c in node.get("children") or []), "figure")
        self.figures[counter] = self.figures.get(counter, 0) + 1
        return str(self.figures[counter])

    def node(self, given: Any, above: list[str], where: str) -> dict:
        kind = given.get("type") if isinstance(given, dict) else None
        if kind not in NODE_FIELDS:
            raise Refused(f"{where}: unknown type {kind!r}")
        node = strict(given, (*_BASE, *NODE_FIELDS[kind]), where)
        for key in M.REQUIRED.get(kind, ()):
            if key != "heading_path" and node.get(key) is None:
                raise Refused(f"{where}.{key}: missing")
        if kind == "heading" and (not isinstance(node["level"], int) or node["level"] < 1):
            raise Refused(f"{where}.level: at least 1")
        out: dict[str, Any] = {"id": self.new_id(), "type": kind}
        out |= {k: node[k] for k in ("label", "state_metadata") if node.get(k)}
        for key in NODE_FIELDS[kind]:
            value = node.get(key)
            if value is None or key in ("children", "items", "cells", "numbering"):
                continue
            text = key in _RICH_FIELDS or key == "text" and kind in ("heading", "paragraph") or key == "title" and kind == "admonition"
            out[key] = rich(value, f"{where}.{key}") if text else value
        if "numbering" in NODE_FIELDS[kind]:
            word = node.get("numbering")
            if word is not None:
                strict(word, ("name",), f"{where}.numbering")
            if self.numbering:
                out["numbering"] = {"value": self.number(node)} | ({"name": word["name"]} if word and word.get("name") is not None else {})
            elif word is not None:
                self.problems.append(("numbering-without-engine", f"{kind} {('@' + node['label']) if node.get('label') else where}"))
        if kind == "heading":
            own = out["text"]["value"]
            above = [*above, f"{out['numbering']['value']} {own}" if self.numbering else own]
            out["heading_path"] = above
        if "children" in NODE_FIELDS[kind]:
            out["children"] = self.nodes(node.get("children"), above, where)
        for field in ("items", "cells"):
            if field in NODE_FIELDS[kind]:
                out[field] = self.entries(node, kind, field, above, where)
        return out

    def nodes(self, given: Any, above: list[str], where: str) -> list[dict]:
        if given is not None and not isinstance(given, list):
            raise Refused(f"{where}: a list expected")
        return [self.node(n, above, f"{where}/{i}") for i, n in enumerate(given or [])]

    def entries(self, node: dict, kind: str, field: str, above: list[str], where: str) -> list[dict]:
        out, count = [], 0
        for i, entry in enumerate(node.get(field) or []):
            strict(entry, ENTRY_FIELDS[kind], f"{where}/{field}/{i}")
            got = {k: entry[k] for k in ENTRY_FIELDS[kind] if k not in ("children", "number", "term") and entry.get(k) is not None}
            if kind == "list" and node.get("ordered"):
                count = count + 1 if entry.get("number") is None else entry["number"]
                got["number"] = count
            if kind == "terms":
                got["term"] = rich(entry.get("term"), f"{where}/{field}/{i}.term")
            out.append(got | {"children": self.nodes(entry.get("children"), above, f"{where}/{field}/{i}")})
        return out


def build(decl: dict, numbering: bool = False, built_at: str | None = None, new_id=None) -> tuple[dict, list[tuple[str, str]]]:
    """The document of a declaration, and what transcribing it found wrong."""
    c = Compiler(numbering, *([new_id] if new_id else []))
    doc = {M.FORMAT_VERSION_KEY: M.FORMAT_VERSION, "id": c.new_id(), "built_at": built_at or datetime.now(UTC).isoformat(), "doc": decl["doc"]}
    if decl.get("source") is not None:
        doc["source"] = decl["source"]
    doc["nodes"] = c.nodes(decl["nodes"], [], "nodes")
    doc["footnotes"] = []
    for i, note in enumerate(decl.get("footnotes") or []):
        strict(note, ("label", "children"), f"footnotes/{i}")
        doc["footnotes"].append({"id": c.new_id(), "label": note["label"], "children": c.nodes(note.get("children"), [], f"footnotes/{i}")})
    doc["bibliography"] = []
    for i, entry in enumerate(decl.get("bibliography") or []):
        own = {k: v for k, v in strict(entry, BIB_FIELDS, f"bibliography/{i}").items() if v is not None}
        if "formatted" in own:
            own["formatted"] = rich(own["formatted"], f"bibliography/{i}.formatted")
        doc["bibliography"].append({"id": c.new_id()} | own)
    return doc, c.problems


def compile_all(files: DataFrame, numbering: bool = False) -> DataFrame:
    """From (doc_key, raw): (doc_key, raw document or null, problems: array of "rule: where").

    Keys ending in .yaml or .yml are YAML, all others JSON. Ids are minted here:
    write the result before anything reads it twice.
    """

    def run(batches):
        for batch in batches:
            docs, problems = [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc, found = build(load(raw, str(key).endswith((".yaml", ".yml"))), numbering)
                    docs.append(None if found else json.dumps(doc, ensure_ascii=False))
                    problems.append([f"{rule}: {where}" for rule, where in found])
                except (Refused, TypeError, KeyError, AttributeError) as e:
                    docs.append(None), problems.append([f"declaration: {e}"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs, pa.string()), pa.array(problems, pa.list_(pa.string()))], names=["doc_key", "raw", "problems"])

    return files.selectExpr("cast(doc_key as string) as doc_key", "raw").mapInArrow(run, "doc_key string, raw string, problems array<string>")
