"""Merkle manifests of a table: a tree of digests for each group of rows and one over the groups.

Leaves are put in order and numbered over ranges, so no task holds a group. A parent is
combined by its key: each task gathers the numbered digests of partial parents, and as soon
as a parent has as many children as the size of its tree gives it, its digest is emitted and
is itself a child of the next parent. What stays incomplete at the ends of tasks (some nodes
for each level) is dealt anew by a common ancestor, until nothing is left open. Each node
keeps its children, so the way back from the root gives every block of leaves its path, and
leaves meet their block's nodes in groups of bounded size to build their proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import Scratch, read
from genostrata.llm.repair import CRC32_SQL, crc32_sql

#: Children of a node, and as a shift.
ARITY, SHIFT = 8, 3
#: Levels of a tree that are one block, where leaves meet their nodes: 8 ** 3 leaves.
BLOCK_LEVELS = 3
#: Partial parents that a task holds; the oldest half goes to the next round beyond that.
MOST_OPEN = 100_000
#: Open children up to which a round deals whole trees, and levels that it lifts beyond that.
MOST_LEFT, LIFT = 500_000, 4

NODE = "tree string, size bigint, level int, idx bigint, digest string, children array<string>, kind string"


def field_text(column: Column) -> Column:
    """A value as - if it is null, else its UTF-8 length, a colon and itself."""
    value = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest_of(*columns: Column) -> Column:
    """The lowercase hex sha256 of the fields' texts, one after the other."""
    return F.sha2(F.concat(*map(field_text, columns)).cast("binary"), 256)


def joined(digests: list[str]) -> str:
    """The digest over digests as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def numbered(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``leaves`` (tree, ...) with idx, the place in its tree, and size, the tree's leaves.

    Places follow ``order``, which must tell all rows of a tree apart that differ.
    """
    ordered = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                at = at + 1 if t == tree else 0
                tree = t
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    placed = scratch.table(ordered.mapInArrow(run, f"{schema}, part int, place bigint"))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(tree).alias("size")))
    return placed.join(starts, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("place")).drop("part", "place", "start")


def _height_counts(size: int) -> list[int]:
    """Nodes at each level of a tree of ``size`` leaves, the last one being 1."""
    counts = [size]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // ARITY))
    return counts


def combined(children: DataFrame) -> DataFrame:
    """Nodes that the children of each task complete, and the children that stay open.

    children(tree, size, level, idx, digest). Rows of kind node have their children, rows of
    kind root the digest of a whole tree, and rows of kind open are children to deal anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, str]] = {}
        sizes: dict[str, tuple[int, list[int]]] = {}
        out: list[tuple] = []
        names = [c.split()[0] for c in NODE.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def arrives(tree: str, size: int, level: int, idx: int, digest: str) -> None:
            if sizes.get(tree, (0,))[0] != size:
                if len(sizes) > MOST_OPEN:
                    sizes.clear()
                sizes[tree] = size, _height_counts(size)
            counts = sizes[tree][1]
            while True:
                if counts[level] == 1:
                    out.append((tree, size, level, idx, digest, None, "root"))
                    return
                level, at = level + 1, idx % ARITY
                idx //= ARITY
                key = (tree, size, level, idx)
                had = partial.setdefault(key, {})
                had[at] = digest
                if len(had) < min(ARITY, counts[level - 1] - ARITY * idx):
                    return
                del partial[key]
                below = [had[i] for i in range(len(had))]
                digest = joined(below)
                out.append((*key, digest, below, "node"))

        def give_up(most: int) -> None:
            for key in list(partial)[: len(partial) - most]:
                tree, size, level, idx = key
                for at, digest in partial.pop(key).items():
                    out.append((tree, size, level - 1, idx * ARITY + at, digest, None, "open"))

        for batch in batches:
            for event in zip(*(batch.column(n).to_pylist() for n in ("tree", "size", "level", "idx", "digest"))):
                arrives(*event)
            if len(partial) > MOST_OPEN:
                give_up(MOST_OPEN // 2)
            if out:
                yield packed()
        give_up(0)
        if out:
            yield packed()

    return children.select("tree", "size", "level", "idx", "digest").mapInArrow(run, NODE)


def tree_nodes(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes and roots over leaves(tree, size, idx, digest), in rounds until no child is open."""
    part = scratch.table(combined(leaves.withColumn("level", F.lit(0))))
    found = part.where("kind <> 'open'")
    while left := part.where("kind = 'open'").count():
        target = (F.floor(F.col("level") / LIFT) + 1) * LIFT
        ancestor = F.lit(0).cast("bigint") if left <= MOST_LEFT else F.call_function("shiftright", F.col("idx"), ((target - F.col("level")) * SHIFT).cast("int"))
        deal = part.where("kind = 'open'").withColumn("ancestor", ancestor).withColumn("target", F.lit(0).cast("bigint") if left <= MOST_LEFT else target)
        part = scratch.table(combined(deal.repartition("tree", "target", "ancestor")))
        found = found.unionByName(part.where("kind <> 'open'"))
    return found


def paths(nodes: DataFrame, ends: DataFrame, stop: int) -> DataFrame:
    """(tree, level, idx, path) of the nodes at level ``stop``, or of the root of a lower tree.

    path lists, from the node up, its place among its siblings and all of them, and then
    what ``ends`` (tree, path) has for the tree.
    """
    roots = nodes.where("kind = 'root'").select("tree", "level", "idx")
    inner = nodes.where("kind = 'node'").select("tree", "level", "idx", "children")
    top = roots.agg(F.max("level")).first()[0] or 0
    roots = roots.join(ends, "tree")
    found, here = roots.where(F.col("level") <= stop), roots.where(F.col("level") == top)
    for level in range(top, stop, -1):
        below = here.join(inner.where(F.col("level") == level).drop("level"), ["tree", "idx"])
        below = below.select("tree", F.col("idx"), "path", "children", F.posexplode("children").alias("at", "own"))
        step = F.array(F.struct(F.col("at").cast("int").alias("at"), F.col("children").alias("run")))
        below = below.select("tree", F.lit(level - 1).alias("level"), (F.col("idx") * ARITY + F.col("at")).alias("idx"), F.concat(step, "path").alias("path"))
        # Below the root's level of a lower tree its root starts.
        here = below.unionByName(roots.where(F.col("level") == level - 1)) if level - 1 > stop else below
    return found.unionByName(here) if top > stop else found


PATH = "array<struct<at: int, run: array<string>>>"


def proofs(leaves: DataFrame, nodes: DataFrame, top_paths: DataFrame, keep: str, scratch: Scratch) -> DataFrame:
    """(``keep``, leaf, subroot, root, proof_sha256, folded_root, tampered) of leaves(tree, idx, digest, tampered, ...).

    top_paths(tree, path, subroot, root) has the path of each tree's root to the root of all.
    A leaf's siblings are those of its block, of the block's path and of the tree's.
    """
    block_bits = SHIFT * BLOCK_LEVELS
    block = F.shiftright("idx", block_bits)
    inside = nodes.where(f"kind = 'node' AND level <= {BLOCK_LEVELS}")
    of_block = F.call_function("shiftright", F.col("idx"), (F.lit(BLOCK_LEVELS) - F.col("level")) * SHIFT)
    inside = inside.select("tree", of_block.alias("block"), "level", "idx", "children", F.lit(None).cast(PATH).alias("path"))
    up = paths(nodes, top_paths.select("tree", "path"), BLOCK_LEVELS)
    up = up.select("tree", F.when(F.col("level") == BLOCK_LEVELS, F.col("idx")).otherwise(0).alias("block"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "path")
    right = inside.unionByName(up).join(top_paths.select("tree", "subroot", "root"), "tree")
    left = leaves.withColumn("block", block)
    kind = leaves.schema[keep].dataType.simpleString()
    result = f"`{keep}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def fold(leaf: pa.Table, node: pa.Table) -> pa.Table:
        inner, path, subroot, root = {}, [], None, None
        for level, idx, children, p, s, r in zip(*(node.column(c).to_pylist() for c in ("level", "idx", "children", "path", "subroot", "root"))):
            if children is not None:
                inner[level, idx] = children
            else:
                path, subroot, root = [(x["at"], x["run"]) for x in p], s, r
        proof, folded = [], []
        for idx, own in zip(leaf.column("idx").to_pylist(), leaf.column("tampered").to_pylist()):
            steps = []
            for level in range(1, BLOCK_LEVELS + 1):
                if (run := inner.get((level, idx >> SHIFT * level))) is None:
                    break
                steps.append((idx >> SHIFT * (level - 1) & ARITY - 1, run))
            siblings = hashlib.sha256()
            for at, run in steps + path:
                siblings.update("".join(run[:at] + run[at + 1 :]).encode())
                own = joined([*run[:at], own, *run[at + 1 :]])
            proof.append(siblings.hexdigest())
            folded.append(own)
        n = leaf.num_rows
        return pa.table([leaf.column(keep), leaf.column("digest"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string())], names=[keep, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    left = left.select(keep, "tree", "block", "idx", "digest", "tampered")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(fold, result)


def manifest(docs: DataFrame, fields: list[str], group: str, doc_id: str, *, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``doc_id``, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    A leaf is the digest of a row's ``fields``. The leaves of each ``group`` value (a null is
    one) ascend by ``doc_id`` (nulls first, equal ids by leaf) and are merged eight at a
    time up to subroot; subroots, null group first and then by the group's bytes, likewise
    up to root. proof_sha256 is the digest of a leaf's siblings from its level to the root.
    Rows in which ``where`` holds are verified as if their fields were those of
    ``tampered``: folded_root is what their leaf and the original siblings give. Repeated
    rows are leaves of their own. An empty table gives an empty result; other columns are
    not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = digest_of(*map(F.col, fields))
    if where is not None:
        other = digest_of(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(key.alias("tree"), F.col(doc_id).alias("id"), leaf.alias("digest"), (leaf if where is None else F.when(where, other).otherwise(leaf)).alias("tampered"))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
        leaves = scratch.table(numbered(rows, ["id", "digest", "row"], scratch))
        nodes = tree_nodes(leaves, scratch)
        subroots = nodes.where("kind = 'root'").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
        tops = scratch.table(numbered(subroots, ["of"], scratch))
        top_nodes = tree_nodes(tops, scratch)
        found = top_nodes.where("kind = 'root'").select("digest").first()
        root = F.lit(found[0] if found else None).cast("string")
        above = paths(top_nodes, top_nodes.where("kind = 'root'").select("tree", F.array().cast(PATH).alias("path")), 0)
        above = tops.join(above.select("idx", "path"), "idx").select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), root.alias("root"))
        found = scratch.table(proofs(leaves, nodes, scratch.table(above), "id", scratch), keep=True)
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", doc_id)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of the documents by language; every third document or so is tampered with."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return manifest(read(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", tampered={"text": F.translate("text", UPPER, LOWER)}, where=chosen)


def _op11_sql(levels: int = 8, top_levels: int = 4) -> str:
    """The levels of the trees one after the other; up to 8 ** levels leaves and 8 ** top_levels groups."""
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(shown(text if f == "text" else f) for f in FIELDS) + ")"
    parts = [
        f"""WITH {CRC32_SQL.strip()},
    chosen AS (SELECT *, coalesce({crc32_sql("doc_id::VARCHAR")} % 3 = 0, FALSE) AS hurt FROM documents, crc_table),
    lowered AS (SELECT *, CASE WHEN hurt THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM chosen),
    leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('other')} AS tampered FROM lowered),
    l0 AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
    n0 AS (SELECT tree, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS c FROM l0)"""
    ]

    def grow(name: str, of: int) -> None:
        for k in range(1, of + 1):
            parts.append(
                f"""    {name}g{k} AS (SELECT tree, i // 8 AS i, list(d ORDER BY i) AS run, any_value(c) AS c FROM {name}{k - 1} GROUP BY tree, i // 8),
    {name}{k} AS (SELECT tree, i, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d, (c + 7) // 8 AS c FROM {name}g{k})"""
            )

    grow("n", levels)
    parts.append(f"    t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS c, tree AS of FROM n{levels})")
    grow("t", top_levels)
    parts.append("    f0 AS (SELECT l0.*, 0 AS lift, t0.i AS j, t0.d AS subroot, '' AS siblings, tampered AS folded FROM l0 JOIN t0 ON l0.tree = t0.of)")
    last = "f0"
    for name, tree, at, of in (("n", "f.tree", "f.i", levels), ("t", "''", "f.j", top_levels)):
        for k in range(1, of + 1):
            own = f"(({at} // {8 ** (k - 1)}) % 8 + 1)"
            rest = f"array_to_string(list_concat(g.run[:{own} - 1], g.run[{own} + 1:]), '')"
            new = f"sha256(array_to_string(list_concat(list_append(g.run[:{own} - 1], f.folded), g.run[{own} + 1:]), ''))"
            parts.append(
                f"""    {name}f{k} AS (SELECT f.* REPLACE (CASE WHEN g.c = 1 THEN f.siblings ELSE f.siblings || {rest} END AS siblings,
        CASE WHEN g.c = 1 THEN f.folded ELSE {new} END AS folded) FROM {last} f JOIN {name}g{k} g ON g.tree = {tree} AND g.i = {at} // {8**k})"""
            )
            last = f"{name}f{k}"
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT d FROM t{top_levels}) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = (SELECT d FROM t{top_levels}) AS verified FROM {last}"


OP11_SQL = _op11_sql()
