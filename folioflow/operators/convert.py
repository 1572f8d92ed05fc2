"""Documents as other formats: one row in, one row out."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.functions.blocks import MarkdownDocument
from folioflow.functions.html import HtmlDocument
from folioflow.sources.documents import flatten, load, without_defaults, _DOC_DEFAULTS


def to_markdown(documents: DataFrame, text_only: bool = False) -> DataFrame:
    """Documents as Markdown files."""
    return _converted(documents, lambda doc: MarkdownDocument(doc, text_only).convert())


def to_html(documents: DataFrame) -> DataFrame:
    """Documents as standalone HTML pages."""
    return _converted(documents, lambda doc: HtmlDocument(doc).convert())


def _converted(documents: DataFrame, convert) -> DataFrame:
    """From (doc_key, raw): (doc_key, text, warnings, reason). What can't be read has a reason and no text."""

    def run(batches):
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc = load(raw)
                    flatten(doc)  # the whole shape is checked before any of it is rendered
                    text, warnings = convert(doc)
                    out.append((key, text, warnings, None))
                except (ValueError, TypeError, KeyError, AttributeError) as e:
                    out.append((key, None, [], str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.string())), pa.array([r[3] for r in out], pa.string())],
                names=["doc_key", "text", "warnings", "reason"],
            )

    return documents.selectExpr("cast(doc_key as string) as doc_key", "raw").mapInArrow(run, "doc_key string, text string, warnings array<string>, reason string")


def to_json(doc: dict, indent: int | None = 2) -> str:
    """A document's JSON with the id first and metadata at its defaults left out."""
    first = {"id": doc["id"]} if doc.get("id") else {}
    rest = {k: v for k, v in doc.items() if k != "id" and not (k in ("bibliography", "footnotes") and v == []) and v is not None}
    return json.dumps(first | rest | {"doc": without_defaults(doc["doc"], _DOC_DEFAULTS)}, indent=indent, ensure_ascii=False)
