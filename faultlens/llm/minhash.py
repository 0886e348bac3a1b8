"""Near-duplicate documents by circulant MinHash.

One random permutation ``sigma`` scatters a document's shingles over a circle
of 2^32 places. A second permutation ``pi`` is reused, circularly shifted by
k = 1, 2, ..., for every signature coordinate: coordinate k is the least
``pi(place - k)``. Bands of coordinates give buckets; the pairs that buckets
propose are confirmed by exact Jaccard similarity on the full shingle sets.

How the work is laid out:

* Documents with the same shingle set form one class, found by one partially
  aggregated grouping. Only the class with its smallest id goes on.
* Round 1 links every member of a bucket to the bucket's smallest id, so a
  bucket of m copies proposes m - 1 pairs, and merges the confirmed ones.
* Round 2 looks at buckets that still hold several components. Members outside
  the bucket's largest component are compared with all members, block by
  block, in two passes: the first compares signatures and lets only the members
  with a possible link to another component through, the second has their full
  sets and confirms. So no link between components is lost, and pairs never
  leave a block unless they are links. A pair that meets in several buckets is
  looked at in the first of them.
* A bucket of any size is dealt over blocks of bounded size; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.graph import components, cut
from faultlens.llm.words import Powers, in_batches, mix64, shingle_sets

#: Coordinates to a band, coordinates of the agreement sketch (8 bits each),
#: rows to a side of a block, the chance of missing a pair right at the
#: threshold, and standard deviations below it that the sketch still lets pass.
BAND_ROWS, SKETCH, BLOCK_ROWS, MISS, MARGIN = 4, 192, 2048, 1e-6, 5

_SIGN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                   ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("members", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bands_for(threshold: float) -> int:
    """Bands of ``BAND_ROWS`` coordinates that miss a pair at ``threshold`` with
    a chance of at most ``MISS``."""
    return int(np.ceil(np.log(MISS) / np.log1p(-threshold ** BAND_ROWS)))


def _sigma(x: np.ndarray) -> np.ndarray:
    return (mix64(x * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(members: np.ndarray, n_coordinates: int) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set of fingerprints."""
    place = _sigma(members)
    shift = np.arange(1, n_coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(n_coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(place), 4096):
        np.minimum(least, _pi(place[None, i:i + 4096] - shift).min(1), out=least)
    return least


def _signed(batches: Iterator[pa.RecordBatch], shingle: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    weights = mix64(np.arange(7, 7 + BAND_ROWS, dtype=np.uint64)) | np.uint64(1)
    number = mix64(np.arange(1000, 1000 + n_bands, dtype=np.uint64))

    def rows(batch):
        for doc_id, members in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), shingle, powers)):
            if not len(members):
                yield doc_id, 0, None, None, None
                continue
            least = signature(members, max(SKETCH, n_bands * BAND_ROWS))
            banded = least[:n_bands * BAND_ROWS].reshape(n_bands, BAND_ROWS).astype(np.uint64)
            keys = mix64((banded * weights).sum(1, np.uint64) ^ number)
            yield (doc_id, len(members), hashlib.blake2b(members.tobytes(), digest_size=16).digest(),
                   keys.view(np.int64), (least & np.uint32(255)).astype(np.uint8).tobytes())

    for batch in batches:
        yield from in_batches(rows(batch), _SIGN, 512)


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        sets = shingle_sets(batch.column(1), shingle, powers)
        yield from in_batches(((i, s.tobytes()) for i, s in zip(batch.column(0).to_pylist(), sets)), _SETS, 256)


def _confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(4))
        yield from in_batches(((a, b) for a, b, x, y in zip(*columns)
                               if _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)), _PAIR)


_OPEN = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("odd", pa.int32()), ("band", pa.int32()),
                   ("doc_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``key, i, j`` in sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _possible(block: pa.Table, num: int, den: int, least_equal: int, n_bands: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per member outside the largest component, the rows of the block it may be
    linked to: another component, fitting sizes, agreeing signatures, and no
    earlier bucket that holds both."""
    odd, band, doc, n, root = (block.column(c).to_numpy() for c in ("odd", "band", "doc_id", "n", "root"))
    sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(len(odd), -1)
    right = np.flatnonzero(odd == 0)
    banded, band = sketch[:, :n_bands * BAND_ROWS].reshape(len(odd), n_bands, BAND_ROWS), int(band[0])
    for x in np.flatnonzero(odd == 1).tolist():
        low, high = np.minimum(n[x], n[right]), np.maximum(n[x], n[right])
        at = right[(root[right] != root[x]) & (den * low >= num * high)]
        at = at[(sketch[at] == sketch[x]).sum(1) >= least_equal]
        if len(at):
            yield x, at[(banded[at] == banded[x]).all(2).argmax(1) == band]


def _open_rows(batches: Iterator[pa.RecordBatch], num: int, den: int, least_equal: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        keep = np.zeros(len(block), bool)
        for x, at in _possible(block, num, den, least_equal, n_bands):
            keep[at] = True
            keep[x] |= len(at) > 0
        if keep.any():
            yield from block.filter(pa.array(keep)).cast(_OPEN).to_batches()


def _block_links(batches: Iterator[pa.RecordBatch], num: int, den: int, least_equal: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    """One link to each other component that a member has in its block."""

    def rows():
        for block in _blocks(batches):
            sets = [np.frombuffer(m, np.uint64) for m in block.column("members").to_pylist()]
            doc, root = block.column("doc_id").to_numpy(), block.column("root").to_numpy()
            for x, at in _possible(block, num, den, least_equal, n_bands):
                linked = set()
                for y in at.tolist():
                    if root[y] not in linked and _linked(sets[x], sets[y], num, den):
                        linked.add(root[y])
                        yield int(doc[x]), int(doc[y])

    yield from in_batches(rows(), _PAIR)


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``den * |A & B| >= num * |A | B|`` for
    ``similarity = (num, den)`` over their sets of ``shingle``-word shingles;
    ``component_id`` is the smallest id reachable by links, and ``kept`` marks
    the rows that are their own component.

    Nulls, empty and white-space texts: an empty set, linked with nothing.
    Texts under ``shingle`` words: one shingle of all words. Null ids: never
    linked, ``component_id`` is null and ``kept`` true. Repeated ids count as
    one document, with the links of all its rows; ids are integers. An empty
    table gives no rows. Other columns are not looked at.
    """
    num, den = similarity
    n_bands = bands_for(num / den)
    t = num / den
    least_equal = int(np.floor(SKETCH * max(0.0, t - MARGIN * np.sqrt(t * (1 - t) / SKETCH))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(lambda it: _signed(it, shingle, n_bands),
                                  "doc_id long, n long, digest binary, bands array<long>, sketch binary"))
    classes = cut(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = cut(signed.where("n > 0").join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
               .dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "bands", "sketch"))
    banded = reps.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))  # many times its size, so never written
    # Written, so that the joins with them are between plain shuffles, which Spark splits where a bucket is large.
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "n")).alias("pivot")).where("m > 1"))

    def sets_of(ids: DataFrame) -> DataFrame:
        return texts.join(ids.distinct(), "doc_id", "left_semi").mapInArrow(
            lambda it: _set_rows(it, shingle), "doc_id long, members binary")

    members = banded.join(shared, "key")
    star = cut(members.where((F.col("doc_id") != F.col("pivot.doc_id"))
                             & (den * F.least("n", "pivot.n") >= num * F.greatest("n", "pivot.n")))
               .select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")).distinct())
    sets = cut(sets_of(star.select(F.explode(F.array("a", "b")).alias("doc_id"))))
    x = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    links = cut(star.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        lambda it: _confirmed(it, num, den), "a long, b long"))
    roots = components(links)

    rooted = cut(members.select("key", "band", "doc_id", "n").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .select("key", "band", "doc_id", "n", F.coalesce("root", "doc_id").alias("root")))
    tally = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top")).select(
        "key", "m", F.col("top.root").alias("top"), (F.col("m") - F.col("top.c")).alias("u")).where("u > 0")
    tally = cut(tally.select("key", "top", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("cm"),
                         F.ceil(F.col("u") / BLOCK_ROWS).cast("int").alias("cu")))
    open_ = rooted.join(tally, "key").join(reps.select("doc_id", "sketch"), "doc_id")
    slot = F.xxhash64("doc_id", F.lit(11))
    left = open_.where("root <> top").select(
        "key", F.pmod(slot, "cu").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cm") - 1)).alias("j"),
        F.lit(1).alias("odd"), "band", "doc_id", "n", "root", "sketch")
    right = open_.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("cu") - 1)).alias("i"), F.pmod(slot, "cm").cast("int").alias("j"),
        F.lit(0).alias("odd"), "band", "doc_id", "n", "root", "sketch")
    at = ["key", "i", "j"]
    blocks = left.unionByName(right).repartition(*at).sortWithinPartitions(*at)
    possible = cut(blocks.mapInArrow(lambda it: _open_rows(it, num, den, least_equal, n_bands),
                                     "key long, i int, j int, odd int, band int, doc_id long, n long, root long, sketch binary"))
    blocks = possible.join(sets_of(possible.select("doc_id")), "doc_id").select(
        *possible.columns, "members").repartition(*at).sortWithinPartitions(*at)
    more = cut(blocks.mapInArrow(lambda it: _block_links(it, num, den, least_equal, n_bands), "a long, b long"))
    links = links.unionByName(more)
    # Classes of several ids hang on their representative by a link each.
    copies = signed.join(classes, "digest").where("doc_id <> rep").select(
        F.col("doc_id").alias("node"), F.col("rep"))
    roots = components(links)
    of_copies = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "node", F.coalesce("root", "rep").alias("root"))
    found = roots.join(copies.select("node").distinct(), "node", "left_anti").unionByName(of_copies).groupBy("node").agg(
        F.min("root").alias("root"))
    return (signed.select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
