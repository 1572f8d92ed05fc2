"""Whole documents as HTML pages. Text is always escaped; a label becomes an element's id, so references are links."""

from __future__ import annotations

import re
from datetime import datetime
from html import escape

from folioflow.functions import inline
from folioflow.functions.blocks import MarkdownBlocks, MarkdownDocument, expanded, safe_image, safe_url, several
from folioflow.plans import model as M

# The prefix of classes, and names of meta elements that a page writes itself.
CLASS = "cnd-"
RESERVED = ("author", "description", "keywords", "date", "status", "version", "viewport")
STYLE = f"""body {{ max-width: 46rem; margin: 0 auto; padding: 2rem 1rem; line-height: 1.6 }}
table {{ border-collapse: collapse }} th, td {{ border: 1px solid; padding: .25rem .5rem }}
.{CLASS}layout {{ display: grid; gap: 1rem }}
.{CLASS}markers {{ font-size: .85em }}
"""


def named(node: dict) -> str:
    return f' id="{escape(node["label"])}"' if node.get("label") else ""


def attr(name: str, value) -> str:
    return f' {name}="{escape(value)}"' if value else ""


def tag(name: str, attrs: str, inner: str) -> str:
    return f"<{name}{attrs}>{inner}</{name}>"


def numbered(node: dict) -> str:
    n = node.get("numbering") or {}
    return " ".join(p for p in (n.get("name"), n.get("value")) if p)


class HtmlBlocks(MarkdownBlocks):
    """Blocks as HTML fragments."""

    def __init__(self, links: bool = True):
        super().__init__("inline", "inline", escape=True, links=links)

    def text(self, text: dict, one: bool = False) -> str:
        def wrap(family, edge):
            if family != "links" or not safe_url(edge["href"]):
                return None
            return f'<a class="{CLASS}link" href="{escape(edge["href"])}">', "</a>"

        said, edges = inline.render(text, "html", wrap=wrap if self.links else None)
        self.written += [id(text["links"][i]) for family, i in sorted(edges) if family == "links"]
        return said

    def all(self, nodes: list[dict] | None) -> str:
        return "".join(map(self.block, expanded(nodes or [])))

    def flow(self, nodes: list[dict] | None) -> str:
        """What an item, a cell or a definition holds: a plain paragraph alone needs no element."""
        nodes = nodes or []
        if several(nodes):
            return self.all(nodes)
        bare = lambda n: n["type"] == "paragraph" and n.get("label") is None and n["text"].get("lang") is None
        return "".join(self.text(n["text"]) if bare(n) else self.block(n) for n in expanded(nodes))

    def _heading(self, n):
        inner = " ".join(p for p in (escape(numbered(n)), self.text(n["text"])) if p) if numbered(n) else self.text(n["text"])
        return tag(f"h{min(max(n['level'], 1), 6)}", named(n), inner)

    def _paragraph(self, n):
        return tag("p", named(n) + attr("lang", n["text"].get("lang")), self.text(n["text"]))

    def _table(self, n):
        cells = n.get("cells") or []
        rows = [sorted((c for c in cells if c["row"] == r), key=lambda c: c["col"]) for r in sorted({c["row"] for c in cells})]
        return tag("table", named(n) + attr("data-kind", n.get("kind")), "".join(tag("tr", "", "".join(map(self.cell, row))) for row in rows))

    def cell(self, c: dict) -> str:
        spans = "".join(f' {k}="{c[k]}"' for k in ("rowspan", "colspan") if c.get(k, 1) != 1)
        return tag("th" if c.get("is_header") else "td", spans, self.flow(c.get("children")))

    def _layout(self, n):
        cells = sorted(n.get("cells") or [], key=lambda c: (c["row"], c["col"]))
        width = max((c["col"] + max(c.get("colspan", 1), 1) for c in cells), default=1)
        area = lambda c: f' style="grid-row: {c["row"] + 1} / span {max(c.get("rowspan", 1), 1)}; grid-column: {c["col"] + 1} / span {max(c.get("colspan", 1), 1)}"'
        inner = "".join(tag("div", area(c), self.all(c.get("children"))) for c in cells)
        return tag("div", f'{named(n)} class="{CLASS}layout" style="grid-template-columns: repeat({width}, 1fr)"', inner)

    def _quote(self, n):
        inner = self.all(n.get("children"))
        return tag("blockquote", named(n), inner + (tag("footer", "", self.text(n["attribution"])) if n.get("attribution") is not None else ""))

    def _admonition(self, n):
        title = escape(n["kind"]) if n.get("title") is None else self.text(n["title"])
        token = escape(re.sub(r"\s+", "-", n["kind"].strip()))
        kind = f" {CLASS}admonition-{token}" if token else ""
        return tag("aside", f'{named(n)} class="{CLASS}admonition{kind}"', tag("p", f' class="{CLASS}admonition-title"', title) + self.all(n.get("children")))

    def _code(self, n):
        code = tag("code", f' class="language-{escape(n["lang"])}"' if n.get("lang") else "", escape(n["text"]))
        if not n.get("title"):
            return tag("pre", named(n), code)
        return tag("div", f'{named(n)} class="{CLASS}code"', tag("p", f' class="{CLASS}code-title"', escape(n["title"])) + tag("pre", "", code))

    def _math(self, n):
        number = tag("span", f' class="{CLASS}number"', escape(numbered(n))) if numbered(n) else ""
        return tag("div", f'{named(n)} class="{CLASS}math-block"', tag("code", f' class="{CLASS}math"', escape(n["text"])) + number)

    def _figure(self, n):
        inner = self.all(n.get("children"))
        if not n.get("children") and n.get("raw") is not None:
            inner += tag("pre", f' class="{CLASS}raw" data-format="{escape(n["raw"]["format"])}"', tag("code", "", escape(n["raw"]["value"])))
        caption = ": ".join(p for p in (escape(numbered(n)), self.text(n["caption"]) if n.get("caption") is not None else "") if p)
        if n.get("description") is not None:
            caption += tag("p", f' class="{CLASS}description"', self.text(n["description"]))
        return tag("figure", named(n) + attr("data-kind", n.get("kind")), inner + (tag("figcaption", "", caption) if caption else ""))

    def _image(self, n):
        if n.get("path") and safe_image(n["path"]):
            return f'<img{named(n)} src="{escape(n["path"])}" alt="{escape(n.get("alt") or "")}">'
        return tag("span", f'{named(n)} class="{CLASS}missing-image"', escape(n.get("alt") or "image"))

    def _list(self, n):
        box = {None: "", True: '<input type="checkbox" disabled checked> ', False: '<input type="checkbox" disabled> '}
        items = "".join(tag("li", "", box[i.get("checked")] + self.flow(i.get("children"))) for i in n.get("items") or [])
        return tag("ol" if n.get("ordered") else "ul", named(n), items)

    def _terms(self, n):
        return tag("dl", named(n), "".join(tag("dt", "", self.text(i["term"])) + tag("dd", "", self.flow(i.get("children"))) for i in n.get("items") or []))


class HtmlDocument(MarkdownDocument):
    """One document as a standalone page."""

    def __init__(self, doc: dict, footnotes_title: str = "Footnotes", bibliography_title: str = "Bibliography", style: str = STYLE):
        super().__init__(doc, False, footnotes_title, bibliography_title)
        self.blocks, self.style = HtmlBlocks(), style

    def convert(self) -> tuple[str, list[str]]:
        doc, d = self.doc, self.doc["doc"]
        built = datetime.fromisoformat(doc["built_at"]).isoformat()
        head = [
            "<!DOCTYPE html>", f'<html{attr("lang", d.get("lang"))} data-{CLASS}version="{escape(doc[M.FORMAT_VERSION_KEY])}" data-built-at="{escape(built)}">', "<head>",
            '<meta charset="utf-8">', '<meta name="viewport" content="width=device-width, initial-scale=1">', tag("title", "", escape(d["title"])),
            *self.meta(), f"<style>\n{self.style}</style>", "</head>", "<body>", "<article>",
        ]
        body = [b for b in map(self.block, self.body()) if b]
        return "\n".join([*head, *body, "</article>", *self.notes(), *self.references(), "</body>", "</html>"]) + "\n", self.warnings

    def meta(self) -> list[str]:
        d = self.doc["doc"]
        date = d.get("date")
        pairs = [("author", a) for a in d.get("authors") or []] + [("description", d.get("description")), ("keywords", ", ".join(d.get("keywords") or []))]
        if date:
            pairs.append(("date", f"{date['year']:04d}" + (f"-{date['month']:02d}" + (f"-{date['day']:02d}" if date.get("day") is not None else "") if date.get("month") is not None else "")))
        pairs += [("status", d.get("status")), ("version", d.get("version"))]
        for name, value in (d.get("extra") or {}).items():
            if name.strip().lower() in RESERVED:
                self.warnings.append(f"doc.extra key {name!r} names a meta element the converter writes itself; skipped")
            else:
                pairs.append((name, value))
        return [f'<meta name="{escape(n)}" content="{escape(v)}">' for n, v in pairs if v]

    def block(self, node: dict) -> str:
        self.blocks.written = []
        said = self.blocks.block(node)
        marks = self.markers(node, list(self.blocks.written))
        return f'{said}\n<span class="{CLASS}markers">{marks}</span>' if marks else said

    def marker(self, family: str, edge: dict) -> str:
        if family == "links":
            href = escape(edge["href"])
            return f'<a class="{CLASS}link" href="{href}">{href}</a>' if safe_url(edge["href"]) else href
        label = escape(edge["label"])
        if family == "cites" and edge.get("form") == "none":
            return ""
        if self.domain.get(edge["label"]) != family:
            return tag("span", f' class="{CLASS}unresolved"', f"[{label}]")
        if family == "footnotes":
            return tag("sup", f' class="{CLASS}footnote"', f'<a href="#{label}">{label}</a>')
        more = f", {escape(edge['supplement'])}" if edge.get("supplement") else ""
        return f'<a class="{CLASS}{"cite" if family == "cites" else "ref"}" href="#{label}">[{label}{more}]</a>'

    def notes(self) -> list[str]:
        found = self.doc.get("footnotes") or []
        items = [tag("li", f' id="{escape(f["label"])}"', "".join(map(self.block, expanded(f.get("children") or [])))) for f in found]
        return [f'<section class="{CLASS}footnotes">', tag("h2", "", escape(self.titles[0])), "<ol>", *items, "</ol>", "</section>"] if found else []

    def references(self) -> list[str]:
        found = self.doc.get("bibliography") or []
        items = [tag("li", f' id="{escape(e["label"])}"', self.blocks.text(self.reference(e))) for e in found]
        return [f'<section class="{CLASS}bibliography">', tag("h2", "", escape(self.titles[1])), "<ul>", *items, "</ul>", "</section>"] if found else []
