"""Merkle manifest of a dataset: one digest proves every row, and a short list of siblings proves one.

Every row is a leaf. The leaves of a source, in the order of their ids, are hashed by runs of ``FANOUT``
until one node, the subroot, remains; the subroots of the sources are hashed likewise to the root.

Leaves are numbered within their source and cut into aligned blocks of ``FANOUT**LEVELS``. A block is one
contiguous matrix of 64-byte hex digests: rows are reshaped by the fanout and hashed level by level, and the
node above leaf k at level l is k // FANOUT**l, so that siblings are slices found by index arithmetic. The tops of
blocks are the leaves of the next table, so a source of any size, and any number of sources, takes a few
tables, each smaller by FANOUT**LEVELS; no task holds more than one block, and the driver holds no digest.
On the way back every block is told its own path to the root as one row.

A path is one text a level, such as ``<hex>*<hex>``, where ``*`` stands for the node below.

Results for hard cases: a null in any column is ``-`` in the leaf (an empty text is ``0:``); null ids come
first, rows of one id by their leaves; repeated rows are leaves of their own; of an empty table nothing
remains; other columns are not hashed and are kept where their names do not clash with the results'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.scans import numbered

from .common import join_spread, materialize, other_columns, quoted

#: Nodes that become one.
FANOUT = 3
#: Levels of one block: 3**7 leaves, 140 KB of digests.
LEVELS = 7

HEX = 64

#: What a leaf hashes, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RESULTS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex sha256 of the columns' texts, each behind its length in UTF-8 bytes; ``-`` for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


# --- one block ------------------------------------------------------------------------------------


def digests(texts: pa.Array) -> np.ndarray:
    """Hex digests as one contiguous matrix of n x 64 bytes."""
    return np.frombuffer("".join(texts.to_pylist()).encode("ascii"), np.uint8).reshape(-1, HEX)


def levels_of(leaves: np.ndarray, fanout: int, most: int | None) -> list[np.ndarray]:
    """The levels above a block's leaves: ``most`` of them, or up to the one of a single node.

    Whole runs are rows of the level reshaped to ``fanout`` digests; the shorter last run is hashed by itself.
    """
    out = [leaves]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        now = out[-1]
        whole = len(now) // fanout * fanout
        rows = np.ascontiguousarray(now[:whole]).reshape(-1, fanout * HEX)
        made = [sha256(r).hexdigest() for r in rows]
        if whole < len(now):
            made.append(sha256(now[whole:].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(made).encode("ascii"), np.uint8).reshape(-1, HEX))
    return out


def paths_of(levels: list[np.ndarray], fanout: int) -> list[list[str]]:
    """For every node of every level but the last, what its parent hashes, with ``*`` in its own place."""
    out = []
    for now in levels[:-1]:
        text = now.tobytes().decode("ascii")
        at = np.arange(len(now))
        first = at - at % fanout
        last = np.minimum(first + fanout, len(now))
        out.append([f"{text[a * HEX : k * HEX]}*{text[(k + 1) * HEX : b * HEX]}" for k, a, b in zip(at.tolist(), first.tolist(), last.tolist())])
    return out


def folded(node: str, path: Sequence[str]) -> str:
    """The root that a node gives with the siblings of its path."""
    for step in path:
        node = sha256(step.replace("*", node).encode("ascii")).hexdigest()
    return node


def proof(path: Sequence[str]) -> str:
    """Digest of all siblings, level by level, left to right."""
    return sha256("".join(path).replace("*", "").encode("ascii")).hexdigest()


# --- trees of any size ----------------------------------------------------------------------------

#: A node: its tree, its place, how many nodes the tree has at this level, its digest.
_NODES = "tree bigint, pos bigint, n bigint, digest string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, block), cut into whole blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in (0, 1)]
        cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            piece = batch.slice(a, b - a)
            if held and (held[0].column(0)[0], held[0].column(1)[0]) != (piece.column(0)[0], piece.column(1)[0]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _grouped(df: DataFrame, size: int, *then: str) -> DataFrame:
    """Nodes with their block in front, a block in one partition and in order."""
    held = df.select("tree", F.floor(F.col("pos") / size).cast("bigint").alias("block"), *[c for c in df.columns if c != "tree"])
    return held.repartition("tree", "block").sortWithinPartitions("tree", "block", *then)


def _tops(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The top of every block of trees that have more nodes than a block, as the nodes of the next table."""
    size = fanout**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            top = levels_of(digests(b.column(4)), fanout, levels)[-1].tobytes().decode("ascii")
            above = -(-b.column(3)[0].as_py() // size)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1), pa.array([above]), pa.array([top])], names=["tree", "pos", "n", "digest"])

    return _grouped(nodes.where(F.col("n") > size), size, "pos").select("tree", "block", "pos", "n", "digest").mapInArrow(run, _NODES)


def _roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, root) of trees that lie in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            top = levels_of(digests(b.column(4)), fanout, None)[-1].tobytes().decode("ascii")
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([top])], names=["tree", "root"])

    size = fanout**levels
    return _grouped(nodes.where(F.col("n") <= size), size, "pos").select("tree", "block", "pos", "n", "digest").mapInArrow(run, "tree bigint, root string")


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes from the leaves up, each written, and (tree, root) of every tree."""
    tables, size = [nodes], fanout**levels
    roots = None
    while True:
        found = _roots(tables[-1], fanout, levels)
        roots = found if roots is None else roots.unionByName(found)
        if not tables[-1].where(F.col("n") > size).head(1):
            return tables, materialize(roots, "merkle-roots")
        tables.append(materialize(_tops(tables[-1], fanout, levels), "merkle-nodes"))


def descend(tables: list[DataFrame], fanout: int = FANOUT, levels: int = LEVELS, above: DataFrame | None = None) -> DataFrame:
    """(tree, pos, path) of the blocks of the lowest table: the path of a block's top to its tree's root and on.

    ``above`` has (tree, path) of the trees' roots, where these are leaves themselves.
    """
    size, found = fanout**levels, None
    for nodes in tables[:0:-1]:
        told = _told(nodes, found, above, size)
        found = materialize(_in_blocks(nodes, told, size, fanout, levels), "merkle-paths")
    return _told(tables[0], found, above, size)


def _told(nodes: DataFrame, blocks: DataFrame | None, above: DataFrame | None, size: int) -> DataFrame:
    """(tree, block, path) for the blocks of a table: from the table above, or for whole trees from their roots."""
    whole = nodes.where((F.col("n") <= size) & (F.col("pos") == 0)).select("tree", F.lit(0).cast("bigint").alias("block"))
    if above is None:
        told = whole.withColumn("path", F.array().cast("array<string>"))
    else:
        told = whole.join(above, "tree").select("tree", "block", "path")
    return told if blocks is None else told.unionByName(blocks.select("tree", F.col("pos").alias("block"), "path"))


def _with_paths(nodes: DataFrame, told: DataFrame, size: int) -> DataFrame:
    """Nodes by block, the path of a block's top in its first row: (tree, block, head, pos, n, digest, path, …)."""
    kept = [c for c in nodes.columns if c not in ("tree", "pos", "n", "digest")]
    rows = nodes.select("tree", F.floor(F.col("pos") / size).cast("bigint").alias("block"), F.lit(1).alias("head"), "pos", "n", "digest", F.lit(None).cast("array<string>").alias("path"), *kept)
    heads = told.select("tree", "block", F.lit(0).alias("head"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"), "path", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in kept])
    return rows.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "head", "pos")


def _block_paths(b: pa.RecordBatch, size: int, fanout: int, levels: int) -> list[list[str]]:
    """The paths of a block's nodes, whose first row holds its top's path."""
    above = b.column(6)[0].as_py()
    n = b.column(4)[1].as_py()
    steps = paths_of(levels_of(digests(b.column(5).slice(1)), fanout, levels if n > size else None), fanout)
    return [[s[k // fanout**j] for j, s in enumerate(steps)] + above for k in range(b.num_rows - 1)]


def _in_blocks(nodes: DataFrame, told: DataFrame, size: int, fanout: int, levels: int) -> DataFrame:
    """(tree, pos, path) of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            paths = _block_paths(b, size, fanout, levels)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(1), b.column(3).slice(1), pa.array(paths, pa.list_(pa.string()))], names=["tree", "pos", "path"])

    return _with_paths(nodes, told, size).mapInArrow(run, "tree bigint, pos bigint, path array<string>")


# --- the manifest ---------------------------------------------------------------------------------


def manifest(df: DataFrame, tampered_text: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS, keep: Sequence[str] | None = None) -> DataFrame:
    """Leaf, subroot, root and the digest of its proof for every row of ``df``, a table with ``FIELDS``.

    ``tampered_text`` is the text that is found when the manifest is verified (the row's own by default):
    ``folded_root`` is what it gives with the siblings of the manifest, and ``verified`` whether that is the root.
    ``keep`` names the columns to carry along, the id alone by default.
    """
    kept = other_columns(df, (*RESULTS, "tree", "pos", "n", "digest", "found", "rank", "first"), ["doc_id"] if keep is None else keep)
    own = [quoted(f) for f in FIELDS]
    found = leaf_digest([*own[:-1], tampered_text]) if tampered_text is not None else F.lit(None).cast("string")
    made = df.select(F.col("source").cast("string").alias("__source"), F.col("doc_id").alias("__id"), leaf_digest(own).alias("digest"), found.alias("found"), *[quoted(c).alias(f"__keep{k}") for k, c in enumerate(kept)])
    # Texts are read once: what follows works on digests.
    made = materialize(made.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found"))), "merkle-leaves")
    ranked = numbered(made, ["__source", "__id", "digest"])
    sources = materialize(ranked.groupBy("__source").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    ranked = ranked.withColumn("__source", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")))
    named = sources.withColumn("__source", F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")))
    total = sources.agg(F.sum("n")).first()[0] or 0
    nodes = join_spread(ranked, named, ["__source"], "n", total).select("tree", (F.col("rank") - F.col("tree")).alias("pos"), "n", "digest", "found", *[f"__keep{k}" for k in range(len(kept))])
    nodes = materialize(nodes, "merkle-ranked")
    tables, subroots = climb(nodes, fanout, levels)

    # The subroots are the leaves of one tree, in the order of their sources, which their first ranks have.
    one = F.lit(0).cast("bigint")
    upper = numbered(subroots, ["tree"])
    count = upper.count()
    upper = materialize(upper.select(one.alias("tree"), F.col("rank").alias("pos"), F.lit(count).cast("bigint").alias("n"), F.col("root").alias("digest"), F.col("tree").alias("source_tree")), "merkle-subroots")
    over, root = climb(upper.drop("source_tree"), fanout, levels)
    size = fanout**levels
    above = _in_blocks(over[0], descend(over, fanout, levels), size, fanout, levels)
    above = materialize(above.join(upper.select("pos", "source_tree", F.col("digest").alias("subroot")), "pos").select(F.col("source_tree").alias("tree"), "path", "subroot"), "merkle-above")
    top = root.first()
    top_digest = top["root"] if top else ""

    told = descend(tables, fanout, levels, above.select("tree", "path"))
    told = told.join(above.select("tree", "subroot"), "tree").select("tree", "block", F.concat(F.array("subroot"), "path").alias("path"))
    arrow_kept = [nodes.schema[f"__keep{k}"] for k in range(len(kept))]
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(kept, arrow_kept)], *[T.StructField(c, T.StringType()) for c in RESULTS[:-1]], T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            above = b.column(6)[0].as_py()
            subroot, upper = above[0], above[1:]
            n = b.column(4)[1].as_py()
            leaves = b.column(5).slice(1)
            steps = paths_of(levels_of(digests(leaves), fanout, levels if n > size else None), fanout)
            proofs, roots = [], []
            for k, (leaf, other) in enumerate(zip(leaves.to_pylist(), b.column(7).slice(1).to_pylist())):
                path = [s[k // fanout**j] for j, s in enumerate(steps)] + upper
                proofs.append(proof(path))
                roots.append(folded(leaf if other is None else other, path))
            rows = b.num_rows - 1
            made = [leaves, pa.array([subroot] * rows), pa.array([top_digest] * rows), pa.array(proofs), pa.array(roots), pa.array([r == top_digest for r in roots])]
            yield pa.RecordBatch.from_arrays([b.column(8 + k).slice(1) for k in range(len(kept))] + made, names=[*kept, *RESULTS])

    return _with_paths(nodes, told, size).mapInArrow(run, schema)
