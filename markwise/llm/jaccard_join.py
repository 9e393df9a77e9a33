"""Similarity join of documents on sets of word n-grams, by rare-first prefixes.

A document's set holds its distinct n-grams. In one order of all n-grams, rare
ones first, two sets of Jaccard similarity t or more share an n-gram among the
first ``|x| - ceil(t |x|) + 1`` of each. So documents are joined on the n-grams
of these prefixes only.

Equal texts are one class. Tasks send the n-gram hashes of a block of classes
with their owners to ranges of hashes; a range counts each hash and returns
those that two classes or more hold, with their counts. An n-gram of one class
joins with nothing, yet it fills a place of the prefix. Per block the prefixes
are cut and become postings: key, class, set size, place in the order, and how
the rest of the set behind that place falls into buckets.

Postings with a key in common meet in two steps, neither of which forms all
pairs of a key. First every posting meets the one of its key that has the
fewest rarer n-grams (its centre); links join classes to groups. Then, in keys
whose postings lie in more than one group, those outside the key's largest group
meet all the others, in blocks of bounded size. A pair passes if the sizes
allow it (length), if what is left behind the two places does (positional), and
if the buckets of what is left do (suffix). Pairs inside a group are not looked
at again: the join is for groups. Every pair that passes is compared once, on
its full sets.

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; a text shorter than n words is one n-gram. Rows that share an id
count as one document, linked by any of its texts. A row without an id is linked
with nothing and has no component. An empty table gives an empty result. A
column with the name of an output column gives way to it. A text is cut into
n-grams whole, in memory of about 60 bytes a word.

Prefixes go by 48 bits of a hash, which can only add pairs to compare; the
comparison goes by 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, stored, table, texts_of
from markwise.llm.words import EMPTY, WordHashes, shingle_set
from markwise.operators.components import connected_components
from markwise.operators.skew import salted_join
from markwise.session import written

WORDS, PERCENT = 4, 85
#: Bits of a hash that n-grams are counted and joined by.
KEY_BITS = 48
#: N-grams and classes of a block, and n-grams of a range.
BLOCK_GRAMS, BLOCK_CLASSES, RANGE_GRAMS = 1 << 19, 1 << 16, 1_000_000
#: Characters to an n-gram, to estimate the number of ranges.
CHARACTERS = 6
#: Buckets of the suffix filter.
BUCKETS = 8
#: Postings of a key that meet in one task: those outside the largest group, and all.
PROBES_AT_ONCE, POSTINGS_AT_ONCE = 512, 4096
#: Ids are broadcast to pick texts only if their counted bytes are within this.
BROADCAST_BYTES = 16 << 20


def grams_of(text: bytes | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a whole text, A-Z lower-cased."""
    return shingle_set(hashes.of(text.lower().split()), size) if text else EMPTY


ASKED = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("low", T.BinaryType()),
        T.StructField("owners", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("nodes", T.BinaryType()),
        T.StructField("digests", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
    ]
)


def asked_of(classes: DataFrame, size: int, part_bits: int) -> DataFrame:
    """(block, part) rows of n-gram keys and their owners' places in the block; with
    the first part of a block goes what the owners are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(ASKED)
        hashes, task, made, held = WordHashes(), TaskContext.get().partitionId(), 0, 0
        nodes: dict[tuple[int, bytes], None] = {}
        sets: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal made, held
            number = task << 32 | made
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.concatenate(sets) >> np.uint64(64 - KEY_BITS)
            owners = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            parts = (keys >> np.uint64(KEY_BITS - part_bits)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))[: len(parts)]
            rows = [
                (number, int(parts[a]), (keys[a:b] >> np.uint64(32)).astype("<u2").tobytes(),
                 keys[a:b].astype("<u4").tobytes(), owners[a:b].tobytes(), None, None, None, None)
                for a, b in itertools.pairwise([*starts.tolist(), len(parts)])
            ]
            who = np.array([node for node, _ in nodes], "<i8").tobytes(), b"".join(d for _, d in nodes), sizes.tobytes()
            rows.append((number, (task + made) % (1 << part_bits), None, None, None, None, *who))
            made, held = made + 1, 0
            nodes.clear()
            sets.clear()
            return emit(arrow.names, arrow.types, rows)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "digest")]
            for node, digest, text in zip(*columns, texts_of(batch.column("text")), strict=True):
                if (node, digest) in nodes:
                    continue
                nodes[node, digest] = None
                sets.append(grams_of(text, hashes, size))
                held += len(sets[-1])
                if held >= BLOCK_GRAMS or len(sets) >= BLOCK_CLASSES:
                    yield block()
        if sets:
            yield block()

    return classes.select("node", "digest", "text").mapInArrow(run, ASKED)


def unpacked_keys(high: bytes, low: bytes) -> np.ndarray:
    return np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(low, "<u4")


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, at its place, up to the largest unsigned 32-bit number."""
    order = np.argsort(keys, kind="stable").astype(np.uint32 if len(keys) < 2**32 else np.int64)
    ordered = keys[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(keys)]
    del ordered
    runs = np.diff(np.append(starts, len(keys)))
    count = np.empty(len(keys), np.uint32)
    count[order] = np.repeat(np.minimum(runs, 2**32 - 1).astype(np.uint32), runs)
    return count


def shared_grams(asked: pa.Table) -> pa.Table:
    """The n-grams of a range that occur twice or more, per block, with their counts;
    rows that describe a block's owners as they are."""
    owners_rows = asked.filter(pc.is_valid(asked.column("nodes")))
    rows = asked.filter(pc.is_null(asked.column("nodes"))).select(["block", "part", "high", "low", "owners"]).to_pylist()
    out = []
    if rows:
        keys = [unpacked_keys(r["high"], r["low"]) for r in rows]
        count = occurrences(np.concatenate(keys))
        at = 0
        for row, own in zip(rows, keys, strict=True):
            n = count[at : at + len(own)]
            at += len(own)
            kept = n > 1
            if kept.any():
                out.append(
                    (row["block"], row["part"], np.frombuffer(row["high"], "<u2")[kept].tobytes(),
                     np.frombuffer(row["low"], "<u4")[kept].tobytes(), np.frombuffer(row["owners"], "<u2")[kept].tobytes(),
                     n[kept].astype("<u4", copy=False).tobytes(), None, None, None)
                )
    made = pa.concat_tables([owners_rows, pa.Table.from_batches([emit(asked.schema.names, asked.schema.types, out)])])
    # the worker goes on to other ranges
    pa.default_memory_pool().release_unused()
    return made


POSTINGS = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),  # of rows that describe a class
        T.StructField("key", T.LongType()),  # of postings, as all that follows
        T.StructField("place", T.LongType()),
        T.StructField("rest", T.ArrayType(T.IntegerType(), False)),
    ]
)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Places of the order that any set similar to one of n n-grams must share one of."""
    return n - -(-percent * n // 100) + 1


def postings_of(percent: int):
    """The postings of a block, and a row per class."""

    def run(block: pa.Table) -> pa.Table:
        who, rows = None, []
        for row in block.to_pylist():
            if row["nodes"] is None:
                rows.append(row)
            else:
                who = row
        nodes, sizes = np.frombuffer(who["nodes"], "<i8"), np.frombuffer(who["sizes"], "<i8")
        digests = [who["digests"][16 * i : 16 * i + 16] for i in range(len(nodes))]
        classes = len(nodes)
        if rows:
            keys = np.concatenate([unpacked_keys(r["high"], r["low"]) for r in rows])
            owners = np.concatenate([np.frombuffer(r["owners"], "<u2") for r in rows]).astype(np.int64)
            counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
        else:
            keys, owners, counts = EMPTY, np.empty(0, np.int64), np.empty(0, np.uint32)
        order = np.lexsort((keys, counts, owners))
        keys, owners = keys[order], owners[order]
        shared = np.bincount(owners, minlength=classes)
        begin = np.cumsum(shared) - shared
        place = np.arange(len(keys)) - begin[owners] + (sizes - shared)[owners]
        taken = np.flatnonzero(place < prefix_length(sizes, percent)[owners])
        bucket = (keys & np.uint64(BUCKETS - 1)).astype(np.int64)
        rest = np.empty((len(taken), BUCKETS), np.int32)
        last = (begin + shared)[owners[taken]]
        for b in range(BUCKETS):
            until = np.append(0, np.cumsum(bucket == b))
            rest[:, b] = until[last] - until[taken + 1]
        empty = pa.nulls(len(taken), pa.binary())
        offsets = pa.array(np.arange(0, (len(taken) + 1) * BUCKETS, BUCKETS, dtype=np.int32))
        kind = pa.list_(pa.field("element", pa.int32(), False))
        names = [f.name for f in POSTINGS]
        found = pa.table(
            [
                pa.array(nodes[owners[taken]]), pa.array(sizes[owners[taken]]), empty,
                pa.array(keys[taken].astype(np.int64)), pa.array(place[taken]),
                pa.ListArray.from_arrays(offsets, pa.array(rest.ravel()), type=kind),
            ],
            names=names,
        )
        described = pa.table(
            [
                pa.array(nodes), pa.array(sizes), pa.array(digests, pa.binary()), pa.nulls(classes, pa.int64()),
                pa.nulls(classes, pa.int64()), pa.nulls(classes, kind),
            ],
            names=names,
        )
        return pa.concat_tables([described, found])

    return run


def least_common(percent: int, n_a, n_b):
    """How many n-grams two sets of these sizes must share."""
    return (percent * (n_a + n_b) + 99 + percent) // (100 + percent)


def may_link(percent: int, a: str, b: str) -> Column:
    """Whether two postings of a key can belong to a link, whatever else they share.

    Before the two places the sets share at most what the nearer place allows,
    behind them at most the sum of the smaller buckets.
    """
    least = F.expr(f"({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}")
    behind = F.aggregate(
        F.zip_with(f"{a}.rest", f"{b}.rest", lambda x, y: F.least(x, y).cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    before = F.least(f"{a}.place", f"{b}.place") + 1
    by_size = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * 100 >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * percent
    return by_size & (before + behind >= least)


def pair_of(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def pairs_with_centres(postings: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): postings next to their key's centre."""
    fields = F.struct("node", "n", "place", "rest")
    met = salted_join(
        postings.select("key", "node", fields.alias("x")), crowded.select("key", F.col("centre").alias("y")),
        ["key"], "node", "inner",
    )
    return (
        met.filter((F.col("x.node") != F.col("y.node")) & may_link(percent, "x", "y"))
        .select(*pair_of(F.col("x.node"), F.col("y.node")))
        .distinct()
    )


def matched(probes: list[tuple], others: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of a probe and another posting of its key, of different groups, that can be
    links of which this key is the first n-gram in common.

    Postings are (node, root, n, place, rest). A link passes at its first common
    n-gram, before which nothing is shared.
    """

    def columns(rows):
        node, root, n, place, rest = zip(*rows, strict=True)
        return np.array(node), np.array(root), np.array(n), np.array(place), np.array(rest)

    node, root, n, place, rest = columns(others)
    found = set()
    for own, group, size, at, behind in probes:
        fits = (root != group) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
        least = least_common(percent, n, size)
        fits &= 1 + np.minimum(n - place, size - at) - 1 >= least
        near = np.flatnonzero(fits)
        if len(near):
            near = near[1 + np.minimum(rest[near], np.array(behind)).sum(1) >= least[near]]
            found.update((min(own, x), max(own, x)) for x in node[near].tolist())
    return sorted(found)


def pairs_between_groups(postings: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different groups, from the keys that hold more than one."""
    members = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = written(members.select("key", "node", "root", "n", "place", "rest"), "members")
    per_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    per_key = per_root.groupBy("key").agg(
        F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("groups")
    )
    blocks = [
        F.ceil((F.col("all") - F.col("top.size")) / PROBES_AT_ONCE).cast("int").alias("probe_blocks"),
        F.ceil(F.col("all") / POSTINGS_AT_ONCE).cast("int").alias("blocks"),
    ]
    open_ = per_key.filter("groups > 1").select("key", F.col("top.root").alias("top"), *blocks)
    placed = salted_join(members, open_, ["key"], "node", "inner")

    def dealt(column: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(column)).cast("int")

    def each(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    own = ["key", "node", "root", "n", "place", "rest"]
    probes = placed.filter("root <> top").select(
        *own, F.lit(True).alias("probe"), dealt("probe_blocks").alias("i"), each("blocks").alias("j")
    )
    others = placed.select(*own, F.lit(False).alias("probe"), each("probe_blocks").alias("i"), dealt("blocks").alias("j"))
    group = ["key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in (*group, "probe", *own[1:])], strict=True)

        out: set[tuple[int, int]] = set()
        for _, held in itertools.groupby(rows(), key=lambda r: r[:3]):
            held = list(held)
            mine = [r[4:] for r in held if r[3]]
            theirs = [r[4:] for r in held if not r[3]]
            if mine and theirs:
                out.update(matched(mine, theirs, percent))
            if len(out) > POSTINGS_AT_ONCE:
                yield emit(["a", "b"], [pa.int64(), pa.int64()], list(out))
                out.clear()
        yield emit(["a", "b"], [pa.int64(), pa.int64()], list(out))

    sent = probes.unionByName(others).repartition(*group).sortWithinPartitions(*group)
    return sent.mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Written: the pairs (a, b) whose full sets are similar enough."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    if ids.count() * 8 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    own = written(texts.join(ids, "node", "left_semi").select("node", "text"), "texts")
    both = (
        pairs.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: tuple = (b"", EMPTY)
        for batch in batches:
            linked = []
            for one, other in zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True):
                if one != held[0]:  # pairs of one class often follow each other
                    held = (one, grams_of(one, hashes, size))
                mine, theirs = held[1], grams_of(other, hashes, size)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                linked.append(100 * common >= percent * (len(mine) + len(theirs) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return written(both.mapInArrow(compare, "a long, b long").distinct(), "links")


def groups_of(links: DataFrame) -> DataFrame:
    """(node, root) of all classes with a link."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return connected_components(nodes, links, []).select(F.col("id").alias("node"), "root")


def links_by_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Written (a, b): the class of a text next to an id that has several texts."""
    several = rows.groupBy("node").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi")
    own = rows.select("node", "digest").join(several.select("node"), "node", "left_semi")
    met = own.join(classes.select("digest", F.col("node").alias("a")), "digest").filter("a <> node")
    return written(met.select("a", F.col("node").alias("b")).distinct(), "links")


def linked_groups(postings: DataFrame, texts: DataFrame, given: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of all classes with a link, from written postings and given links."""
    centre = F.min(F.struct("place", "node", "n", "rest")).alias("centre")
    crowded = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members"), centre).filter("members > 1")
    crowded = written(crowded, "crowded")
    near = written(pairs_with_centres(postings, crowded, percent), "pairs")
    links = verified(near, texts, size, percent).unionByName(given)
    roots = groups_of(links)
    met = salted_join(postings, crowded.select("key"), ["key"], "node", "left_semi")
    more = written(pairs_between_groups(met, roots, percent).join(near, ["a", "b"], "left_anti"), "pairs")
    further = verified(more, texts, size, percent)
    return roots if further.isEmpty() else groups_of(links.unionByName(further))


OWN = ("n_shingles", "component_id")


def jaccard_groups(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = WORDS,
    percent: int = PERCENT,
    keep: list[str] | None = None,
    part_bits: int | None = None,
) -> DataFrame:
    """``df[keep]`` (the id alone unless named) with n_shingles and component_id."""
    keep = [c for c in ([id] if keep is None else keep) if c not in OWN]
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(
        *[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[id].cast("long").alias("node"),
        df[text].alias("text"), F.unhex(F.md5(df[text].cast("binary"))).alias("digest"),
    )
    with_id = rows.filter("node IS NOT NULL")
    classes = written(
        with_id.filter("text <> ''").groupBy("digest").agg(F.min("node").alias("node"), F.first(F.length("text")).alias("n_chars")),
        "classes",
    )
    sums = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).first()
    if part_bits is None:
        part_bits = max(1, int((sums["chars"] or 0) / CHARACTERS / RANGE_GRAMS).bit_length())
    chosen = classes.select("node", "digest")
    if sums["n"] * 24 <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    texts = with_id.join(chosen, ["node", "digest"], "left_semi").select("node", "digest", "text")
    shared = asked_of(texts, size, part_bits).groupBy("part").applyInArrow(shared_grams, ASKED)
    found = stored(shared.groupBy("block").applyInArrow(postings_of(percent), POSTINGS), "postings")
    given = links_by_id(with_id.filter("text <> ''"), classes)
    roots = linked_groups(found.filter("key IS NOT NULL").drop("digest"), texts, given, size, percent)
    sizes = found.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("root_node"), F.first("n").alias("size"))
    own = written(
        sizes.join(roots.select(F.col("node").alias("root_node"), "root"), "root_node", "left").select(
            "digest", "size", F.coalesce("root", "root_node").alias("root")
        ),
        "classes",
    )
    labelled = salted_join(with_id.drop("text"), own, ["digest"], "node", "left").select(
        *names, F.coalesce("size", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("root", "node").alias("component_id")
    )

    def make():
        hashes = WordHashes()
        return lambda column: [[len(grams_of(t, hashes, size)) for t in texts_of(column)]]

    without = add_columns(
        rows.filter("node IS NULL"), ["text"], T.StructType([T.StructField("n_shingles", T.LongType())]), make, names
    ).withColumn("component_id", F.lit(None).cast("long"))
    result = labelled.unionByName(without)
    return result.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *OWN)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)
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
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN roots ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
