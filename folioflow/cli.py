"""Commands over files of documents: validate, hash, diff, build, convert, inspect.

Exit codes: 0 all well, 1 something is wrong with a document, 2 wrong usage or a file that can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import canonical
from folioflow.operators import convert, match, validate
from folioflow.plans.stage import cut
from folioflow.sources import declarations, documents


def content_hashes(c: documents.Corpus) -> DataFrame:
    """(doc_key, content_hash): metadata, all nodes by path, and both pools."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct("scope", "ord", "path", "node_hash"))), lambda x: F.array(x["path"], x["node_hash"]))
    n = c.nodes.groupBy("doc_key").agg(pair.alias("nodes"))
    pool = lambda df, name: df.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pool_index", "hash"))), lambda x: x["hash"]).alias(name))
    # merged, since the planner takes arrays in files for small and would broadcast their rows
    joined = c.documents.select("doc_key", "doc_fields_json").join(n.hint("merge"), "doc_key", "left").join(pool(c.bibliography, "bibs").hint("merge"), "doc_key", "left").join(pool(c.footnotes, "notes").hint("merge"), "doc_key", "left")

    @F.udf("string")
    def digest(doc, nodes, bibs, notes):
        return canonical.digest({"doc": json.loads(doc), "nodes": [list(x) for x in nodes or []], "bibliography": list(bibs or []), "footnotes": list(notes or [])})

    return joined.select("doc_key", digest("doc_fields_json", "nodes", "bibs", "notes").alias("content_hash"))


def load(spark: SparkSession, paths: list[str]) -> tuple[documents.Corpus, DataFrame]:
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc_key"), F.col("value").alias("raw"))
    parsed = cut(documents.parse(files))
    return documents.corpus(parsed), documents.errors(parsed)


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as one line of JSON, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def show(rows: DataFrame, as_json: bool) -> int:
    n = 0
    for row in (json_lines(rows) if as_json else rows).toLocalIterator():
        n += 1
        print(row.line if as_json else "\t".join("" if v is None else str(v) for v in row))
    return n


def inspect(c: documents.Corpus) -> DataFrame:
    refs = c.edges.where("family <> 'links'").groupBy("doc_key").agg(F.count("*").alias("n_refs"))
    n = c.nodes.groupBy("doc_key").agg(F.count("*").alias("n_nodes"), F.countDistinct("type").alias("n_types"), F.max("depth").alias("max_depth"))
    return c.documents.select("doc_key", "title").join(n, "doc_key", "left").join(refs, "doc_key", "left").fillna(0)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "hash", "inspect", "markdown", "html", "build"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="+")
        s.add_argument("--json", action="store_true")
        if name == "hash":
            s.add_argument("--nodes", action="store_true")
        if name == "build":
            s.add_argument("--numbering", action="store_true")
        if name in ("build", "markdown", "html"):
            s.add_argument("-o", "--output")
    d = sub.add_parser("diff")
    d.add_argument("old"), d.add_argument("new"), d.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()

    if args.command == "diff":
        (old, e1), (new, e2) = load(spark, [args.old]), load(spark, [args.new])
        if show(e1.union(e2), args.json):
            return 2
        sides = [match.entries(c.nodes, c.footnotes).withColumn("doc_key", F.lit("")) for c in (old, new)]
        changes = cut(match.diff(*sides))
        show(changes.where("status <> 'unchanged'").orderBy("seq"), args.json)
        return int(changes.where("status <> 'unchanged'").limit(1).count() > 0)
    if args.command == "build":
        files = spark.read.text(args.paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc_key"), F.col("value").alias("raw"))
        built = cut(declarations.compile_all(files, args.numbering))
        broken = validate.validate(documents.corpus(documents.parse(built.where("raw is not null").select("doc_key", "raw"))))
        wrong = show(built.where("raw is null").select("doc_key", F.array_join("problems", "; ")), args.json) + show(broken, args.json)
        if not wrong:
            built.select("raw").write.text(args.output) if args.output else show(built.select("raw"), False)
        return int(wrong > 0)
    corpus, errors = load(spark, args.paths)
    bad = show(errors, args.json)
    if args.command == "validate":
        return 1 if show(validate.validate(corpus).orderBy("doc_key", "seq"), args.json) or bad else 0
    if args.command == "hash":
        show(corpus.nodes.select("doc_key", "path", "node_hash") if args.nodes else content_hashes(corpus), args.json)
    elif args.command == "inspect":
        show(inspect(corpus), args.json)
    else:
        told = (convert.to_markdown if args.command == "markdown" else convert.to_html)(corpus.documents)
        told.select("text").write.text(args.output) if args.output else show(told.select("text"), False)
    return 2 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
