"""Text functions as column expressions: they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format's URL rule.
SAFE_SCHEMES = ("http", "https", "mailto")
FORBIDDEN_SCHEMES = ("javascript", "vbscript", "data")


def unix_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n|\r", "\n")


def one_line(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n|\r|\n", " ")


def json_string(s: Column) -> Column:
    """A string as canonical JSON writes it."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    plain = out
    for c, e in named.items():
        plain = F.replace(plain, F.lit(c), F.lit(e))
    control = F.rlike(out, F.lit("[\\x00-\\x07\\x0b\\x0e-\\x1f]"))
    chars = F.transform(F.split(plain, ""), lambda c: F.when(F.ascii(c).between(0, 31) & (c != ""), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))).otherwise(c))
    return F.concat(F.lit('"'), F.when(control, F.array_join(chars, "")).otherwise(plain), F.lit('"'))


def sha256(s: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(s.cast("binary"), 256))


def paragraph_hash(value: Column, label: Column | None = None) -> Column:
    """Content hash of a paragraph with a plain text in normal form C, with its label if it has one."""
    text = F.concat(F.lit('"text":{"value":'), json_string(value), F.lit('},"type":"paragraph"}'))
    if label is None:
        return sha256(F.concat(F.lit("{"), text))
    return sha256(F.concat(F.lit("{"), F.when(label.isNotNull(), F.concat(F.lit('"label":'), json_string(label), F.lit(","))).otherwise(F.lit("")), text))


def normalized_url(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "(?U)^[\\s\\x00-\\x20\\x{FEFF}]+", ""), "[\t\n\r]", "")


def url_scheme(s: Column) -> Column:
    """The lower-cased scheme as the most lenient reader sees it; null without one."""
    found = F.regexp_extract(normalized_url(s), "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)
    return F.when(found != "", F.lower(found))


def allowed_schemes(names) -> tuple[str, ...]:
    """Extra schemes, lower-cased; TypeError for one bare string, ValueError for what can't be one or is never linked."""
    import re

    if isinstance(names, str):
        raise TypeError("a collection of scheme names is wanted, not one string")
    out = []
    for name in names:
        low = name.lower() if isinstance(name, str) else ""
        if not re.fullmatch(r"[a-z][a-z0-9+.\-]*", low) or low in FORBIDDEN_SCHEMES:
            raise ValueError(f"{name!r} can't be an allowed scheme")
        out.append(low)
    return tuple(sorted(set(out)))


def is_safe_url(s: Column, extra=()) -> Column:
    scheme = url_scheme(s)
    return scheme.isNull() | scheme.isin(*SAFE_SCHEMES, *allowed_schemes(extra))


def is_safe_image(s: Column) -> Column:
    return is_safe_url(s) | F.startswith(F.lower(normalized_url(s)), F.lit("data:image/"))


def gfm_cell(s: Column, text_only: bool = False) -> Column:
    return F.replace(F.replace(unix_newlines(s), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" " if text_only else "<br>"))


def html_escape(s: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(c), F.lit(e))
    return s


def css_token(s: Column) -> Column:
    return html_escape(F.regexp_replace(F.regexp_replace(s, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", "-"))


def attr_value(s: Column) -> Column:
    """A placeholder's attribute: backslash and quote escaped, blanks folded, no two closing brackets in a row."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    out = F.regexp_replace(F.regexp_replace(out, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")
    return F.regexp_replace(out, "\\](?=\\])", "] ")


def escape_destination(s: Column) -> Column:
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("&"), F.lit("\\&"))
    out = F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    wrapped = F.concat(F.lit("<"), F.replace(F.replace(out, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit(">"))
    return F.when(F.rlike(out, F.lit("[\\x00-\\x20()<>\\x7f]")), wrapped).otherwise(out)


def fence(s: Column) -> Column:
    """Backticks, three or more, longer than any run in the text."""
    runs = F.transform(F.regexp_extract_all(s, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def code_span(s: Column) -> Column:
    """A code span whose backticks no run inside it matches; blanks keep edge backticks and blanks apart."""
    text = one_line(s)
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    blank = F.rlike(text, F.lit("^ .* $")) & (F.trim(text) != "")
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")) | blank, F.lit(" ")).otherwise(F.lit(""))
    return F.concat(ticks, pad, text, pad, ticks)


def escape_alt(s: Column) -> Column:
    return F.regexp_replace(s, "\\\\(?=[!-/:-@\\[-`{-~]|\\z)|[\\[\\]`<]", "\\\\$0")


def escape_inline(s: Column) -> Column:
    """Escapes what starts inline Markdown; an underscore between letters or digits, and a lone & or <, stay."""
    punct = "[!-/:-@\\[-`{-~\\r\\n]"
    pattern = (
        f"\\\\(?={punct}|\\z)|[*`\\[\\]~]|(?<![\\p{{L}}\\p{{N}}])_|_(?![\\p{{L}}\\p{{N}}])|<(?=[A-Za-z/!?])"
        "|&(?=(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"
    )
    return F.regexp_replace(s, pattern, "\\\\$0")


def escape_block(s: Column) -> Column:
    """escape_inline, and a backslash before what would start a block on any line."""
    out = escape_inline(unix_newlines(s))
    first = "(?m)^( {0,3})(?=#{1,6}(?:[ \\t]|$)|>|[-+](?:[ \\t]|$)|(?:=+|-+)[ \\t]*$|(?:-[ \\t]*){3,}$|(?=[|:\\- \\t]*\\|)(?=[|:\\- \\t]*-)[|:\\- \\t]*$)"
    out = F.regexp_replace(out, first, "$1\\\\")
    return F.regexp_replace(out, "(?m)^( {0,3}\\d{1,9})([.)])(?=[ \\t]|$)", "$1\\\\$2")


def yaml_scalar(s: Column) -> Column:
    """A double-quoted YAML scalar."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))


def format_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; a day shows only with a month."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(year, 4), pad(month, 2), F.when(month.isNotNull(), pad(day, 2)))


def preview(s: Column, n: int = 80) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def prefixed(s: Column, marker: str = ">") -> Column:
    """Each line after the marker and a blank; an empty line is the marker alone."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.when(x != "", F.concat(F.lit(marker + " "), x)).otherwise(F.lit(marker))), "\n")


def indented(s: Column, first: Column, indent: Column) -> Column:
    """``first`` before the first line, ``indent`` before each other line that isn't empty."""
    lines = F.split(s, "\n")
    head = F.rtrim(F.concat(first, F.get(lines, 0)))
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.when(x != "", F.concat(indent, x)).otherwise(x))
    return F.array_join(F.concat(F.array(head), rest), "\n")


def format_bib(formatted: Column, authors: Column, year: Column, title: Column, container: Column, doi: Column, url: Column, label: Column) -> Column:
    """``formatted`` if it isn't empty, else the fields joined by '. ', else the label."""
    given = lambda c: F.when(c != "", c)
    parts = F.concat_ws(". ", given(authors), F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(")"))), given(title), given(container), given(doi), given(url))
    return F.coalesce(given(formatted), given(parts), label)


def placeholder(node_id: Column, attrs: list[tuple[str, Column]]) -> Column:
    """[[figure:id key="value" ...]], null or empty attributes left out, in the order given."""
    parts = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f'{k}="'), attr_value(v), F.lit('"'))) for k, v in attrs]
    return F.concat(F.lit("[[figure:"), node_id, F.lit(" "), F.concat_ws(" ", *parts), F.lit("]]"))
