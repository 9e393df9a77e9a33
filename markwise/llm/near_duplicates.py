"""Near-duplicate documents by one-permutation MinHash and star-shaped edges.

A document's set holds its distinct 5-word shingles. One hash of every shingle
both picks a bin and is the value that competes in it, so one pass over the
set fills all bins; empty bins borrow from bins picked by a fixed random
sequence per bin (optimal densification). Bands of bins give bucket keys.

Copies are taken together first (equal sets are one class), so only classes
meet in buckets. Inside a bucket no pairs are formed: every member is compared
with a centre only, the member that shares the most buckets with others. Links
are confirmed on the full sets; pairs whose set sizes alone rule a link out are
not looked at. Members that are both too far from their centre can still be
near each other. So what hangs together by stars, confirmed or not, is a
family, and families that the confirmed links leave in more than one component
are compared exactly in blocks, by matrix products inside tasks.

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; fewer than five words make one shingle. Rows that share an id
count as one document. A row without an id is linked with nothing, has no
component and is kept. An empty table gives an empty result.

The chance to miss a link at the very threshold is at most about 1e-6 (a pair
meets in no band), far less above it; whatever meets is decided exactly, up to
collisions of 64-bit hashes inside two documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, table, texts_of
from markwise.llm.words import WordHashes, mixed, shingles_of
from markwise.operators.components import connected_components
from markwise.session import written

BINS = 192
TRIES = 64
MISS = 1e-6
#: Ids are broadcast to pick texts only if their counted bytes are within this.
BROADCAST_BYTES = 16 << 20
#: Bounds of a block of a family, and of the columns of a matrix.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS_AT_ONCE = 256, 400_000, 4096


def banding(percent: int, bins: int = BINS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows at which a pair at the threshold is missed
    with a chance below ``miss``."""
    fits = [r for r in range(1, bins + 1) if (1 - (percent / 100) ** r) ** (bins // r) <= miss]
    rows = max(fits, default=1)
    return bins // rows, rows


class OnePermutation:
    """Signatures and band keys of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.bounds = (np.arange(self.bins + 1, dtype=object) * 2**64 // self.bins)[:-1].astype(np.uint64)
        self.detours = np.random.default_rng(seed).integers(0, self.bins, (self.bins, TRIES))
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Smallest hash per bin; ``hashes`` is sorted and not empty."""
        first = np.searchsorted(hashes, self.bounds)
        filled = first < np.append(first[1:], len(hashes))
        values = hashes[np.minimum(first, len(hashes) - 1)]
        if filled.all():
            return values
        empty = np.flatnonzero(~filled)
        hit = filled[self.detours[empty]]
        lender = self.detours[empty, hit.argmax(1)]
        lost = ~hit.any(1)
        if lost.any():
            having = np.flatnonzero(filled)
            lender[lost] = having[self.detours[empty[lost], 0] % len(having)]
        values[empty] = values[lender]
        return values

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        grid = self.signature(hashes).reshape(self.bands, self.rows)
        keys = self.salt.copy()
        for row in range(self.rows):
            keys = mixed(keys + grid[:, row])
        return keys.view(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType(), False)),
    ]
)


def signed(df: DataFrame, text: str, bands: int, rows: int, keep: list[str]) -> DataFrame:
    """``df[keep]`` with set size, digest of the set and band keys."""

    def make():
        hashes, method = WordHashes(), OnePermutation(bands, rows)

        def work(column):
            sizes, digests, keys, ends = [], [], [], [0]
            for t in texts_of(column):
                shingles = shingles_of(t, hashes)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                if len(shingles):
                    keys.append(method.keys(shingles))
                ends.append(ends[-1] + (bands if len(shingles) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = pa.array(np.array(ends, np.int32))
            kind = pa.list_(pa.field("element", pa.int64(), False))
            return [sizes, digests, pa.ListArray.from_arrays(offsets, pa.array(flat), type=kind)]

        return work

    return add_columns(df, [text], SIGNED, make, keep)


def texts_of_nodes(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the documents that ``ids`` (written: node) names."""
    if ids.count() * 8 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return written(df.filter("node IS NOT NULL").join(ids, "node", "left_semi").select("node", "text"), "texts")


def confirmed(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = edges.select("a", "b").join(b, "b").join(a, "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: tuple = (b"", shingles_of(b"", hashes))
        for batch in batches:
            linked = []
            pairs = zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True)
            for one, other in pairs:
                if one != held[0]:  # rows of a centre follow each other
                    held = (one, shingles_of(one, hashes))
                mine, theirs = held[1], shingles_of(other, hashes)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                linked.append(100 * common >= percent * (len(mine) + len(theirs) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long").distinct()


def star_edges(shared: DataFrame) -> DataFrame:
    """Distinct (a, n_a, b, n_b): every bucket member b next to the bucket's centre a.

    ``shared`` are (key, node, n, weight); the centre has the greatest weight,
    then the smallest id. It is found by partial aggregation, and the join back
    has one row per key on its small side.
    """
    top = F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("n_a")))
    centres = shared.groupBy("key").agg(top.alias("top"))
    return (
        shared.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
        .join(centres, "key")
        .select((-F.col("top.minus")).alias("a"), F.col("top.n_a").alias("n_a"), "b", "n_b")
        .filter("a <> b")
        .distinct()
    )


def block_links(
    nodes: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links that join different roots, as a forest; between blocks if there are two.

    The sizes of all intersections come from one matrix product over the
    shingles that more than one set holds.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[n[number] > 1]
    column = (np.cumsum(n > 1) - 1)[number[n[number] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
        held = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        held[owner[lo:hi], column[lo:hi] - start] = 1
        common += held @ held.T
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    near &= roots[:, None] != roots[None, :]
    if (blocks != blocks[0]).any():
        near &= blocks[:, None] != blocks[None, :]
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    found = []
    for i, j in np.argwhere(np.triu(near)):
        one, other = top(int(roots[i])), top(int(roots[j]))
        if one != other:
            above[one] = other
            found.append((int(nodes[i]), int(nodes[j])))
    return found


def family_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside families that stars have not joined already.

    ``members`` are (family, node, n, root). A family is cut into blocks of at
    most about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles; a task
    compares two blocks at a time, so a node is sent once per block of its
    family and no pairs are formed outside a task's matrix.
    """
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        members.join(sizes.select("family", blocks.alias("blocks")), "family")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(texts, "node")
        .select("family", "node", "root", "block", "text", other.alias("other"))
        .select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "text")
    )
    group = ["family", "lo", "hi"]
    sent = placed.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            for batch in batches:
                numbers = [batch.column(c).to_pylist() for c in ("family", "lo", "hi", "block", "node", "root")]
                yield from zip(*numbers, texts_of(batch.column("text")), strict=True)

        for _, own in itertools.groupby(rows(), key=lambda r: r[:3]):
            _, _, _, block, node, root, text = zip(*own, strict=True)
            sets = [shingles_of(t, hashes) for t in text]
            links = block_links(np.array(node), np.array(root), np.array(block), sets, percent)
            if links:
                yield emit(["a", "b"], [pa.int64(), pa.int64()], links)

    return sent.sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")


def roots_of(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    found = connected_components(nodes.select(F.col("node").alias("id")), edges.select("a", "b"), [])
    return found.select(F.col("id").alias("node"), F.col("root").alias(name))


def linked_classes(classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all classes that share a bucket with another.

    ``classes`` is a written table (node, n_shingles, keys).
    """
    rows = classes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = written(rows.join(crowded, "key"), "buckets")
    nodes = written(shared.groupBy("node").agg(F.first("n").alias("n"), F.sum("members").alias("weight")), "nodes")
    stars = written(star_edges(shared.select("key", "node", "n").join(nodes.drop("n"), "node")), "stars")
    texts = texts_of_nodes(documents, nodes.select("node"))
    possible = stars.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = written(confirmed(possible, texts, percent), "links")
    members = (
        nodes.select("node", "n")
        .join(roots_of(nodes, links, "root"), "node")
        .join(roots_of(nodes, stars, "family"), "node")
    )
    members = written(members, "members")
    # a family is all that hangs together by buckets; with two nodes, the star has compared them
    open_ = members.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("nodes"))
    open_ = open_.filter("lo <> hi AND nodes > 2").select("family")
    more = written(family_links(members.join(open_, "family", "left_semi"), texts, percent), "links")
    if more.isEmpty():
        return members.select("node", "root")
    return roots_of(nodes, links.unionByName(more), "root")


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85, keep: list[str] | None = None
) -> DataFrame:
    """``df[keep]`` (the id alone unless named) with n_shingles, component_id, kept."""
    bands, rows = banding(percent)
    keep = [id] if keep is None else keep
    signed_rows = written(
        signed(df.select("*", df[id].alias("_node")), text, bands, rows, [*[c for c in keep if c not in OWN], "_node"]),
        "signed",
    )
    classes = written(
        signed_rows.filter("n_shingles > 0 AND _node IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("_node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")),
        "classes",
    )
    documents = df.select(df[id].alias("node"), df[text].alias("text"))
    roots = linked_classes(classes.drop("digest"), documents, percent)
    found = classes.join(roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("component_id")
    )
    return (
        signed_rows.drop("keys")
        .join(found, "digest", "left")
        .withColumn("component_id", F.when(F.col("_node").isNotNull(), F.coalesce("component_id", "_node")))
        .withColumn("kept", F.coalesce(F.col("_node") == F.col("component_id"), F.lit(True)))
        .drop("digest", "_node")
    )


OWN = ("n_shingles", "digest", "keys", "component_id", "kept", "_node")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
