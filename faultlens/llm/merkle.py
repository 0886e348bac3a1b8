"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row's leaf is the hash of its fields. The leaves of a tree (a value of the
tree column) ascend by id; while a tree has more than one node, every two
consecutive ones become the hash of their digests, a last one alone the hash of
its own. What remains are the subroots; ordered by tree they are hashed to the
root in the same way.

How the work is laid out:

* Rows shrink to digests first. They are range-sorted over all tasks, written
  once, and numbered by a prefix sum over (tree, partition) counts, so a tree of
  any size is spread evenly.
* Nodes are hashed block by block, ``2 ** BITS`` of a level at a time, and every
  node learns its sibling there: one shuffle for ten levels.
* Proofs: a node holds the siblings on its way to an ancestor, at first its own
  sibling alone. A self-join appends to each node's segment that of the ancestor
  which the segment reaches; this doubles the distance, so that after
  log2(height) joins every leaf reaches the subroot. At distance d only the
  levels that d divides are still in use, so all but the leaves shrink fast.
* The key of a join is the ancestor and a block of ``2 ** BITS`` descendants;
  high ancestors are copied to their blocks, so no key holds more rows than that.
* The subroots go through the same steps as one tree, and their segments to the
  root are appended to the leaves' by tree and block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.graph import cut

#: Levels that a block of nodes is hashed through at once.
BITS = 10


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hash of fields in order: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = [f.cast("string") for f in fields]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` from 0 in each tree and the tree's size ``n``. The
    rows are sorted over all tasks and written, so a retried task sees the same
    partitions; row numbers break ties, so equal rows are spread as well."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = ["tree", *order, "_row"]
    spread = cut(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).drop("_row"))
    tree = Window.partitionBy("_tree")
    before = tree.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy(F.col("tree").alias("_tree"), F.col("_part").alias("_p")).agg(
        F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("n", F.sum("_c").over(tree))
    numbered = spread.join(parts, (F.col("tree") == F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_low")).alias("idx"), "n")


def _hash_block(nodes: pa.Table, base: int) -> pa.Table:
    """All nodes of a block whose lowest level is ``base``: the given ones with their
    siblings, those above them, and the one at the block's top, which has none yet."""
    nodes = nodes.sort_by("idx")
    n, first = nodes.column("n")[0].as_py(), nodes.column("idx")[0].as_py()
    height = (n - 1).bit_length()
    digests = nodes.column("digest").to_pylist()
    tree, kept = nodes.column("tree")[0].as_py(), nodes.column("kept")
    out = []
    for level in range(base, min(base + BITS, height) + 1):
        top = level in (base + BITS, height)
        count = len(digests)
        siblings = [None] * count if top else [digests[k ^ 1] if k ^ 1 < count else None for k in range(count)]
        keep = kept.combine_chunks() if level == base else pa.nulls(count, kept.type)
        out.append(pa.Table.from_arrays([
            pa.array([tree] * count, pa.string()), pa.array([level] * count, pa.int32()),
            pa.array(range(first, first + count), pa.int64()), pa.array([n] * count, pa.int64()),
            pa.array(digests, pa.binary()), pa.array(siblings, pa.binary()),
            pa.array([level == height] * count, pa.bool_()), keep],
            names=["tree", "level", "idx", "n", "digest", "sibling", "subroot", "kept"]))
        pairs = [b"".join(d.hex().encode() for d in digests[k:k + 2]) for k in range(0, count, 2)]
        digests, first = [hashlib.sha256(p).digest() for p in pairs], first >> 1
    return pa.concat_tables(out)


def _block_hasher(base: int):
    return lambda nodes: _hash_block(nodes, base)


def _hash_levels(leaves: DataFrame) -> DataFrame:
    """All nodes above ``tree, idx, n, digest, kept``, the leaves included."""
    schema = f"tree string, level int, idx long, n long, digest binary, sibling binary, subroot boolean, kept {leaves.schema['kept'].dataType.simpleString()}"
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes, base, level = None, 0, leaves
    while True:
        # A block's top node is hashed on as a node of the next pass, which gives it its sibling.
        made = cut(level.groupBy("tree", F.shiftright("idx", BITS).alias("block")).applyInArrow(
            _block_hasher(base), schema))
        last = base + BITS >= (most - 1).bit_length()
        own = made if last else made.where(F.col("subroot") | (F.col("level") < base + BITS))
        nodes = own if nodes is None else nodes.unionByName(own)
        if last:
            return nodes
        base += BITS
        level = made.where(~F.col("subroot") & (F.col("level") == base)).select("tree", "idx", "n", "digest", "kept")


def _jumped(low: DataFrame, high: DataFrame, distance: int) -> DataFrame:
    """``low`` with the segments of its ancestors ``distance`` levels up, taken
    from ``high``, appended. Nodes that reach their subroot already stay as they are."""
    width = min(distance, BITS)
    low = low.withColumn("_up", F.col("level") + distance).withColumn("_block", F.shiftright("idx", width))
    final = F.call_function("shiftright", F.col("n") - 1, (F.col("level") - distance + width).cast("int"))
    blocks = F.sequence(F.shiftleft("idx", distance - width), F.least(F.shiftleft(F.col("idx") + 1, distance - width) - 1, final))
    high = high.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("path").alias("_path"),
                       F.explode(blocks).alias("_of"))
    same = [F.col("tree") == F.col("_tree"), F.col("_up") == F.col("_level"), F.col("_block") == F.col("_of")]
    path = F.concat("path", F.coalesce("_path", F.array().cast("array<binary>")))
    return low.join(high, same, "left").select("tree", "level", "idx", "n", "digest", "kept", path.alias("path"))


def prove(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Proofs within the trees of ``tree, digest, kept`` and the order columns.

    Returns the leaves as ``tree, level, idx, n, digest, kept, path``, where
    ``path`` holds the sibling at each level up to the subroot (null where there
    is none), and the subroots as ``tree, n, digest``.
    """
    nodes = _hash_levels(_numbered(leaves, order).select("tree", "idx", "n", "digest", "kept"))
    empty = F.array().cast("array<binary>")
    paths = nodes.withColumn("path", F.when(F.col("subroot"), empty).otherwise(F.array("sibling"))).drop("sibling")
    proven, high = paths.where("level = 0").drop("subroot"), paths.where("level > 0 AND NOT subroot").drop("subroot")
    most = nodes.agg(F.max("n")).first()[0] or 1
    distance = 1
    while distance < (most - 1).bit_length():
        odd = F.col("level") % (2 * distance) == distance
        proven = _jumped(proven, high.where(F.col("level") == distance), distance)
        if 2 * distance < (most - 1).bit_length():
            high = cut(_jumped(high.where(~odd), high.where(odd & (F.col("level") > distance)), distance))
        distance *= 2
    return proven, nodes.where("subroot").select("tree", "n", "digest")


def fold(digest: Column, path: Column, idx: Column) -> Column:
    """The root that a digest at place ``idx`` and the siblings of ``path`` give (hex)."""
    steps = F.transform(path, lambda s, k: F.struct(_hex(s).alias("s"), F.call_function("shiftright", idx, k).bitwiseAND(1).alias("odd")))
    return F.aggregate(steps, digest, lambda d, x: F.when(x["s"].isNull(), hashed(d)).when(x["odd"] == 1, hashed(x["s"], d))
                       .otherwise(hashed(d, x["s"])))


def manifest(docs: DataFrame, fields: Sequence[str], tree: str, order: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: ``leaf, subroot, root`` (hex), ``idx, path`` up
    to the subroot, ``top_idx, top_path`` from there to the root, and the columns
    of ``keep``, computed from ``docs``, by their names.

    Leaves hash ``fields`` (cast to strings) and ascend by the integer ``order``, nulls first,
    rows with the same value by leaf. Trees are the values of ``tree``, null
    first, then bytewise. Null, empty and long values are ordinary ones; equal
    rows have equal leaves at consecutive places and a proof each. An empty
    table gives no rows. Columns that are not named are not looked at.
    """
    keep = {"_none": F.lit(None).cast("string")} if keep is None else keep
    leaf = leaf_digest([F.col(f) for f in fields])
    named = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = cut(docs.select(named.alias("tree"), F.col(order).cast("long").alias("_order"), F.unhex(leaf).alias("digest"),
                           F.struct(*(c.alias(k) for k, c in keep.items())).alias("kept")))
    proven, subroots = prove(rows, ["_order", "digest"])
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", F.struct(F.col("tree").alias("of"), "n").alias("kept"))
    top, roots = prove(tops, ["of"])
    root = (roots.first() or [None] * 3)[2]
    blocks = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("kept.n") - 1, BITS))
    top = top.select(F.col("kept.of").alias("_tree"), F.col("digest").alias("_subroot"), F.col("idx").alias("top_idx"),
                     F.col("path").alias("top_path"), F.explode(blocks).alias("_of"))
    whole = proven.join(top, (F.col("tree") == F.col("_tree")) & (F.shiftright("idx", BITS) == F.col("_of")))
    return whole.select(*(F.col(f"kept.{k}") for k in keep if k != "_none"), _hex(F.col("digest")).alias("leaf"),
                        _hex(F.col("_subroot")).alias("subroot"), F.lit(root and root.hex()).cast("string").alias("root"),
                        "idx", "path", "top_idx", "top_path")


def verified(rows: DataFrame, leaf: Column) -> DataFrame:
    """``rows`` of ``manifest`` with ``proof_sha256`` (hash of all siblings from
    the leaf to the root), ``folded_root`` recomputed from ``leaf`` and the
    siblings, and ``verified`` (whether that is the root)."""
    siblings = F.transform(F.concat("path", "top_path"), _hex)
    folded = rows.withColumn("folded_root", fold(leaf, F.col("path"), F.col("idx")))
    folded = folded.withColumn("folded_root", fold(F.col("folded_root"), F.col("top_path"), F.col("top_idx")))
    return folded.withColumns({"proof_sha256": F.sha2(F.array_join(siblings, ""), 256),
                               "verified": F.col("folded_root") == F.col("root")})
