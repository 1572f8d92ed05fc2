"""Matching two builds of a corpus, what changed between them, and handing ids on.

An entry is a node with its path, hash, reading order and the digest of what is
below it. Passes run in a fixed order; in each, equal keys pair in reading order
(the nth of one build with the nth of the other), and what is matched leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.model import MATCH_PASSES
from folioflow.plans.stage import cut

ENTRY = ["doc_key", "node_id", "label", "type", "path", "hash", "walk_order", "subtree"]


def match_path(nodes: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Adds match_path: the path with a footnote's pool index replaced by its label.

    Labels come as one map a document, merged on the document alone: notes grow
    with the corpus, so they are not for the driver, and what follows is dealt out alike.
    """
    notes = footnotes.groupBy("doc_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pool_index") + 1, "label"))).alias("_notes"))
    rest = F.array_join(F.slice(F.split("path", "/"), 3, F.greatest(F.size(F.split("path", "/")) - 2, F.lit(0))), "/")
    path = F.when(F.col("scope") > 0, F.concat_ws("/", F.lit("footnotes"), F.col("_notes")[F.col("scope")], rest)).otherwise(F.col("path"))
    return nodes.join(notes.hint("merge"), "doc_key", "left").withColumn("match_path", path).drop("_notes")


def subtree_digests(nodes: DataFrame) -> DataFrame:
    """(doc_key, scope, ord, subtree): digest of the hashes below each node, slot by slot; '' without slots.

    From the deepest level up, one aggregation a level: a node's children are
    known when its turn comes. ``slots`` counts a node's slots, so that empty
    ones are seen; ``slot_index`` (null: the only slot) says where a child is.
    Levels that more than one other reads are written.
    """
    key = ["doc_key", "scope", "ord"]
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select(*key, F.lit("").alias("subtree"))
    kid = "struct<s:int,o:array<int>,h:string,d:string>"
    empty = F.array().cast(f"array<{kid}>")
    slot = lambda s: F.concat(
        F.array(F.lit("[")), F.flatten(F.transform(F.filter(F.coalesce("kids", empty), lambda k: k["s"] == s), lambda k: F.array(k["h"], k["d"]))), F.array(F.lit("]"))
    )
    digest = F.when(F.col("slots") == 0, F.lit("")).otherwise(
        F.sha2(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), slot)), "|").cast("binary"), 256)
    )
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth).select(*key, "parent_ord", "slot_index", "node_hash", "slots")
        if levels:
            child = F.struct(F.coalesce("slot_index", F.lit(0)).alias("s"), F.col("ord").alias("o"), F.col("node_hash").alias("h"), F.col("subtree").alias("d"))
            below = levels[-1].groupBy("doc_key", "scope", F.col("parent_ord").alias("ord")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
            level = level.join(below, key, "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast(f"array<{kid}>"))
        told = level.select(*key, "parent_ord", "slot_index", "node_hash", digest.alias("subtree"))
        levels.append(cut(told) if 0 < depth < deepest else told)
    return reduce(DataFrame.unionByName, levels).select(*key, "subtree")


def entries(nodes: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Entries of a corpus; headings and figures have no digest of their own."""
    nodes = cut(nodes.select("doc_key", "scope", "ord", "parent_ord", "slot_index", "slots", "depth", "node_id", "label", "type", "path", "node_hash"))
    order = F.row_number().over(Window.partitionBy("doc_key").orderBy("scope", "ord"))
    # only what can hold others is joined with its digest
    held = nodes.where("slots > 0").join(subtree_digests(nodes).where("subtree <> ''"), ["doc_key", "scope", "ord"])
    told = match_path(held.unionByName(nodes.where("slots <= 0 or slots is null").withColumn("subtree", F.lit(""))), footnotes)
    return told.select(
        "doc_key", "node_id", "label", "type", F.col("match_path").alias("path"), F.col("node_hash").alias("hash"), order.alias("walk_order"),
        F.when(F.col("type").isin("heading", "figure"), F.lit("")).otherwise(F.col("subtree")).alias("subtree"),
    )


def pass_keys() -> dict[str, Column]:
    """The key of each pass; a null key pairs with nothing."""
    join = lambda *cols: F.concat_ws("\x00", *cols)
    return dict(zip(MATCH_PASSES, [
        F.col("label"), join("hash", "subtree", "path"), join("hash", "subtree"), join("path", "type"), F.when(F.col("subtree") != "", F.col("hash")),
    ]))


def match_entries(old: DataFrame, new: DataFrame, until: str = MATCH_PASSES[-1], keep: list[str] = ENTRY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, old left over, new left over) after the passes up to ``until``, with the columns of ENTRY named by ``keep``.

    Both builds are dealt by document once. A pass counts what is left of either
    side under each key: the nth of one pairs with the nth of the other. A pair
    is told by its pass, the first old entry under its key and n, all numbers,
    and brought together at the end; nothing is joined, sent to the driver or
    read again between passes. Each pass is one window, sorted by a hash of its
    key before the key itself. The result is written, since three tables read it.
    """
    sides = [side.select(*ENTRY).withColumn("_old", F.lit(is_old)) for side, is_old in ((old, True), (new, False))]
    left, none = sides[0].unionByName(sides[1]).repartition("doc_key"), F.lit(None)
    left = left.withColumns({"matched_by": none.cast("string"), "_head": none.cast("int"), "_n": none.cast("long")})
    is_old = F.col("_old")
    for name, key in pass_keys().items():
        group = Window.partitionBy("_h", "doc_key", "_k").orderBy("walk_order")
        so_far, all_ = (group.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
        told = left.withColumn("_k", F.when(F.col("matched_by").isNull(), key)).withColumn("_h", F.xxhash64("doc_key", "_k")).withColumns({
            "_rank": F.when(is_old, F.count_if(is_old).over(so_far)).otherwise(F.count_if(~is_old).over(so_far)), "_first": F.min(F.when(is_old, F.col("walk_order"))).over(all_),
            "_most": F.least(F.count_if(is_old).over(all_), F.count_if(~is_old).over(all_)),
        })
        hit = F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_most"))
        told = told.withColumns({"matched_by": F.when(hit, F.lit(name)).otherwise(F.col("matched_by")), "_head": F.when(hit, F.col("_first")).otherwise(F.col("_head")), "_n": F.when(hit, F.col("_rank")).otherwise(F.col("_n"))})
        left = told.drop("_k", "_h", "_rank", "_first", "_most")
        if name == until:
            break
    # the old entry of a pair stands before the new one and takes it along; what is left over stands alone
    keep = [c for c in ENTRY if c != "doc_key" and c in keep]
    entry, alone = F.struct(*keep), F.col("matched_by").isNull()
    pair = Window.partitionBy("_h", "doc_key", "matched_by", "_head", "_n").orderBy(is_old.desc())
    mate = left.withColumn("_h", F.xxhash64("doc_key", "matched_by", "_head", "_n")).withColumn("_mate", F.lead(entry).over(pair))
    whole = cut(mate.where(is_old | alone).select("doc_key", "matched_by", F.when(is_old, entry).alias("o"), F.when(~is_old, entry).when(~alone, F.col("_mate")).alias("n")))
    pairs = whole.where("matched_by is not null").select("doc_key", "matched_by", *[F.col(f"{side[0]}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in keep])
    gone, come = (whole.where(f"matched_by is null and {side} is not null").select("doc_key", f"{side}.*") for side in "on")
    return pairs, gone, come


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_key, status, matched_by, old_id, new_id, old_order, new_order, seq): new order first, then what was removed."""
    pairs, gone, come = match_entries(old, new, keep=["node_id", "path", "hash", "walk_order"])
    status = F.when(F.col("old_hash") != F.col("new_hash"), "changed").when(F.col("old_path") != F.col("new_path"), "moved").otherwise("unchanged")
    out = pairs.select("doc_key", status.alias("status"), "matched_by", F.col("old_node_id").alias("old_id"), F.col("new_node_id").alias("new_id"), F.col("old_walk_order").alias("old_order"), F.col("new_walk_order").alias("new_order"))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    added = come.select("doc_key", F.lit("added").alias("status"), none_s.alias("matched_by"), none_s.alias("old_id"), F.col("node_id").alias("new_id"), none_i.alias("old_order"), F.col("walk_order").alias("new_order"))
    removed = gone.select("doc_key", F.lit("removed").alias("status"), none_s.alias("matched_by"), F.col("node_id").alias("old_id"), none_s.alias("new_id"), F.col("walk_order").alias("old_order"), none_i.alias("new_order"))
    order = Window.partitionBy("doc_key").orderBy(F.col("new_order").asc_nulls_last(), "old_order")
    return out.unionByName(added).unionByName(removed).withColumn("seq", F.row_number().over(order))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_key", "status").agg(F.count("*").alias("n"))


def changes_of(changes: DataFrame, *statuses: str) -> DataFrame:
    """The changes of some statuses (added, removed, changed, moved, unchanged), in each document's order."""
    return changes.where(F.col("status").isin(*statuses))


def unchanged_docs(changes: DataFrame) -> DataFrame:
    """(doc_key, is_empty): whether nothing changed."""
    return changes.groupBy("doc_key").agg(F.bool_and(F.col("status") == "unchanged").alias("is_empty"))


def match_pool(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pool entries by label: the last old duplicate serves; a matched label hides its other duplicates.

    In and out: (doc_key, pool_index, id, label, hash); statuses unchanged, changed, added, removed.
    """
    last = old.groupBy("doc_key", "label").agg(F.max_by(F.struct("id", "hash", "pool_index"), "pool_index").alias("o"))
    n = new.join(last, ["doc_key", "label"], "left")
    status = F.when(F.col("o").isNull(), "added").when(F.col("o.hash") == F.col("hash"), "unchanged").otherwise("changed")
    matched = n.select("doc_key", status.alias("status"), "label", F.col("o.id").alias("old_id"), F.col("id").alias("new_id"))
    gone = old.join(new.select("doc_key", "label").distinct(), ["doc_key", "label"], "left_anti")
    return matched.unionByName(gone.select("doc_key", F.lit("removed").alias("status"), "label", F.col("id").alias("old_id"), F.lit(None).cast("string").alias("new_id")))


def remap(changes: DataFrame, pools: DataFrame | None = None, only_exact: bool = False) -> DataFrame:
    """(doc_key, new_id, id): the id each new node or pool entry takes; ``only_exact`` takes nodes matched by label alone."""
    kept = F.col("old_id").isNotNull()
    if only_exact:
        kept = kept & (F.col("matched_by") == "label")
    out = changes.where("new_id is not null").select("doc_key", "new_id", F.when(kept, F.col("old_id")).otherwise(F.col("new_id")).alias("id"))
    if pools is not None:
        out = out.unionByName(pools.where("new_id is not null").select("doc_key", "new_id", F.coalesce("old_id", "new_id").alias("id")))
    return out


def remap_conflicts(mapping: DataFrame) -> DataFrame:
    """(doc_key, id, problem): ids that two take over, or that one takes over and another keeps."""
    told = mapping.withColumn("inherited", F.col("id") != F.col("new_id"))
    g = told.groupBy("doc_key", "id").agg(F.count_if("inherited").alias("taken"), F.count_if(~F.col("inherited")).alias("kept"))
    return g.where("taken > 1 or taken >= 1 and kept >= 1").select("doc_key", "id", F.when(F.col("taken") > 1, "inherited twice").otherwise("inherited and kept").alias("problem"))


def reconcile_counts(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("doc_key").agg(F.count_if(F.col("id") != F.col("new_id")).alias("inherited"), F.count_if(F.col("id") == F.col("new_id")).alias("minted"))


def remap_apply(rows: DataFrame, mapping: DataFrame, id_col: str = "node_id") -> DataFrame:
    """Rows with their ids replaced; everything else, labels on edges too, stays."""
    m = mapping.select("doc_key", F.col("new_id").alias(id_col), F.col("id").alias("_id"))
    return rows.join(m, ["doc_key", id_col], "left").withColumn(id_col, F.coalesce("_id", id_col)).drop("_id")
