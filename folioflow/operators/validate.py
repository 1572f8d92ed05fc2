"""The rules that a document must keep; each returns (doc_key, rule, location, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import links
from folioflow.plans import model as M
from folioflow.sources.documents import Corpus

OUT = ["doc_key", "rule", "location", "message", "place"]


def _out(df: DataFrame, rule: str, where, message, *place) -> DataFrame:
    parts = [F.coalesce(F.format_string("%09d", F.col(p)) if isinstance(p, str) else p, F.lit("~")) for p in place] or [F.lit("")]
    return df.select("doc_key", F.lit(rule).alias("rule"), where.alias("location"), message.alias("message"), F.concat_ws("/", *parts).alias("place"))


def order_text(ord_col: Column) -> Column:
    return F.array_join(F.transform(ord_col, lambda x: F.format_string("%09d", x)), ".")


def _text_where(df: DataFrame):
    return F.coalesce(F.concat_ws(" ", "owner_type", "owner"), F.lit(""))


def with_owner(rows: DataFrame, c: Corpus) -> DataFrame:
    """Adds owner_type to rows of texts, marks or edges: the node's type, or that it is a bibliography entry."""
    types = c.nodes.select("doc_key", "scope", "ord", F.col("type").alias("owner_type"))
    of_nodes = rows.where("scope is not null").join(types, ["doc_key", "scope", "ord"])
    of_bibs = rows.where("scope is null").withColumn("owner_type", F.lit("bibliography entry"))
    return of_nodes.unionByName(of_bibs.select(*of_nodes.columns))


def _place(df: DataFrame) -> list:
    return [F.when(F.col("scope").isNull(), F.lit("1")).otherwise(F.lit("0")), F.format_string("%09d", F.coalesce("scope", "pool_index")), F.coalesce(order_text(F.col("ord")), F.lit("")), "text_index"]


def version(c: Corpus) -> DataFrame:
    bad = c.documents.where(F.col("version") != M.FORMAT_VERSION)
    return _out(bad, M.VERSION_RULE, F.concat(F.lit(M.FORMAT_VERSION_KEY + " "), "version"), F.lit(f"only version {M.FORMAT_VERSION} is read"))


def duplicates(claimed: DataFrame, key: str) -> DataFrame:
    """Second and later claimants of an id or label, with the first one's id."""
    order = Window.partitionBy("doc_key", key).orderBy("rank", "scope", "ord")
    ranked = claimed.where(F.col(key).isNotNull()).select(
        "*", F.row_number().over(order).alias("nth"), F.first("id").over(order).alias("first_id"), F.first("owner_type").over(order).alias("first_type")
    )
    return ranked.where("nth > 1")


def unique(c: Corpus, key: str) -> DataFrame:
    dup = duplicates(links.claims(c.nodes, c.bibliography, c.footnotes), key)
    owner = F.concat_ws(" ", "owner_type", "id")
    where = owner if key == "id" else F.concat(F.lit("@"), F.col("label"), F.lit(" on "), owner)
    verb = "id is already used by " if key == "id" else "label is already claimed by "
    return _out(dup, f"{key}-not-unique", where, F.concat(F.lit(verb), F.concat_ws(" ", "first_type", "first_id")), "rank", "scope", order_text(F.col("ord")))


def edge_rules(c: Corpus) -> DataFrame:
    index = links.label_index(links.claims(c.nodes, c.bibliography, c.footnotes))
    edges = with_owner(c.edges, c)
    name = F.coalesce("label", "href")
    where = F.concat(F.lit("@"), name, F.lit(" on "), _text_where(edges))
    place = [*_place(edges), links.family_rank(F.col("family")).cast("string"), "edge_index"]
    lost = _out(links.unresolved(edges, index), "link-unresolved", where, F.concat("family", F.lit(" edge names a label nothing carries")), *place)
    described = F.element_at(F.create_map(*[F.lit(x) for i in {"refs": "a node", "cites": "a bibliography entry", "footnotes": "a footnote"}.items() for x in i]), F.col("family"))
    wrong = links.wrong_domain(edges, index)
    wrong = _out(wrong, "link-wrong-domain", where, F.concat("family", F.lit(" edge must resolve to "), described, F.lit(", got "), "target_type"), *place)
    span, n = F.col("span"), F.col("length")
    fine = (F.size(span) == 2) & (F.get(span, 0) >= 0) & (F.get(span, 0) <= F.get(span, 1)) & (F.get(span, 1) <= n)
    out = edges.where(span.isNotNull() & ~F.coalesce(fine, F.lit(False)))
    message = F.concat(F.lit("text_span ["), F.array_join(span.cast("array<string>"), ", "), F.lit("] is outside a text of "), n.cast("string"), F.lit(" code points"))
    return lost.unionByName(wrong).unionByName(_out(out, "text-span-out-of-bounds", where, message, *place))


def mark_rules(c: Corpus) -> DataFrame:
    marks = with_owner(c.marks, c)
    text = ["doc_key", "scope", "ord", "owner", "pool_index", "text_index"]
    where, place = _text_where(marks), _place(marks)
    span = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit(")"))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length"))
    empty = (F.col("start") == F.col("end")) & (F.col("start") >= 0) & (F.col("start") <= F.col("length"))
    bad = marks.where(~inside)
    said = F.when(empty, F.lit("is empty")).otherwise(F.concat(F.lit("is outside a text of "), F.col("length").cast("string"), F.lit(" code points")))
    bounds = _out(bad, "mark-out-of-bounds", where, F.concat_ws(" ", "kind", F.lit("mark"), span, said), *place, "mark_index")

    listed = Window.partitionBy(*text).orderBy("mark_index")
    keyed = F.struct("start", "end", "kind")
    unsorted = marks.withColumn("_bad", F.lag(keyed).over(listed) > keyed).where("_bad").dropDuplicates(text)
    canon = _out(unsorted, "mark-not-canonical", where, F.lit("marks are not sorted by (start, end, kind)"), *place)

    alike = Window.partitionBy(*text, "kind").orderBy("start", "end")
    touch = marks.withColumn("_end", F.lag("end").over(alike)).where("start <= _end")
    merge = _out(touch, "mark-same-kind-overlap", where, F.concat(F.lit("two "), "kind", F.lit(" marks overlap or touch at "), F.col("start").cast("string"), F.lit("; merge them")), *place, "start")

    edge_spans = c.edges.where("size(span) = 2").select(*text, F.lit(-1).alias("o_index"), F.get("span", 0).alias("o_start"), F.get("span", 1).alias("o_end"), F.lit("edge span").alias("what"))
    mark_spans = c.marks.select(*text, F.col("mark_index").alias("o_index"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.concat("kind", F.lit(" mark")).alias("what"))
    crossed = _out(
        atomic_crossed(marks, mark_spans.unionByName(edge_spans), text), "mark-atomic-crossed", where,
        F.concat("what", F.lit(" ["), F.col("o_start").cast("string"), F.lit(", "), F.col("o_end").cast("string"), F.lit(") reaches inside the "), "kind", F.lit(" mark "), span), *place, "mark_index",
    )
    return bounds.unionByName(canon).unionByName(merge).unionByName(crossed)


def atomic_crossed(marks: DataFrame, spans: DataFrame, text: list[str]) -> DataFrame:
    """Atomic marks with each other span of their text that overlaps but doesn't cover them.

    The spans of one text meet only its atoms: an equi-join on the text, null-safe for bibliography texts.
    """
    atoms = marks.where(F.col("kind").isin(*M.ATOMIC_MARKS))
    key = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in text])
    left, right = atoms.withColumn("_k", key), spans.withColumn("_k", key).select("_k", *[F.col(k).alias(f"_{k}") for k in text], "o_index", "o_start", "o_end", "what")
    same = [left["_k"] == right["_k"], *[left[k].eqNullSafe(right[f"_{k}"]) for k in text]]
    met = left.join(right, same)
    apart = (F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end"))
    covers = (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))
    return met.where((F.col("o_index") != F.col("mark_index")) & ~apart & ~covers)


def pagination(c: Corpus) -> DataFrame:
    """Of a document where some nodes have a page and some don't: the fewer, or on a tie those without."""
    located = F.col("page").isNotNull()
    doc = Window.partitionBy("doc_key")
    told = c.nodes.select("*", F.count_if(located).over(doc).alias("with_page"), F.count_if(~located).over(doc).alias("without"))
    less = F.when(F.col("without") <= F.col("with_page"), ~located).otherwise(located)
    bad = told.where((F.col("with_page") > 0) & (F.col("without") > 0) & less)
    message = F.concat(F.lit("partially paginated; these nodes should "), F.when(located, F.lit("omit their location")).otherwise(F.lit("carry a location")))
    return _out(bad, "pagination-partial", F.concat_ws(" ", "type", "node_id"), message, "scope", order_text(F.col("ord")))


def empty_entries(c: Corpus) -> DataFrame:
    formatted = c.texts.where("scope is null").select("doc_key", "pool_index")
    bad = c.bibliography.where("not has_fields").join(formatted, ["doc_key", "pool_index"], "left_anti")
    where = F.concat(F.lit("@"), "label", F.lit(" (bibliography entry "), "id", F.lit(")"))
    return _out(bad, "bib-entry-empty", where, F.lit("entry has neither `formatted` nor any structured field"), "pool_index")


def extra_keys(c: Corpus) -> DataFrame:
    bad = c.documents.select("doc_key", F.explode("extra_keys").alias("key")).where(F.col("key").isin(*M.DOC_FIELDS))
    return _out(bad, "doc-extra-shadows-field", F.concat(F.lit("doc.extra['"), "key", F.lit("']")), F.lit("an extra key repeats a named metadata field"), F.col("key"))


def validate(c: Corpus) -> DataFrame:
    """All violations, ``seq`` giving each document's in a stable order."""
    found = [version(c), unique(c, "id"), unique(c, "label"), edge_rules(c), mark_rules(c), pagination(c), empty_entries(c), extra_keys(c)]
    out = None
    for rank, df in enumerate(found):
        df = df.withColumn("check", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    order = Window.partitionBy("doc_key").orderBy("check", "place", "rule", "location", "message")
    return out.select("doc_key", F.row_number().over(order).alias("seq"), "rule", "location", "message")


def results(documents: DataFrame, violations: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(doc_key, n_violations, ok): a file is ok without violations; files that can't be read aren't."""
    n = violations.groupBy("doc_key").agg(F.count("*").alias("n"))
    out = documents.select("doc_key").join(n, "doc_key", "left").select("doc_key", F.coalesce("n", F.lit(0)).alias("n_violations"), F.col("n").isNull().alias("ok"))
    return out if errors is None else out.unionByName(errors.select("doc_key", F.lit(0).cast("long").alias("n_violations"), F.lit(False).alias("ok")))
