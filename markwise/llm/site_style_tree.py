"""Main text of HTML pages by site style trees.

The element trees of all pages of a host are merged: a node is a path of block
elements with their class names. For every node two entropies say how much it
matters, both relative to the logarithm of the number m of pages that have it:

presentation  entropy of the layouts (kinds of children) of the element around
content       1 minus the mean entropy of its texts: a text on c of m pages
              has log c / log m, so what all pages repeat counts 0

Importance is nine parts content and one part presentation, in 0 to 1; a node
on one page only has 1. Elements and names that mean a part around an article
(nav, footer, advert, ...) lower it by 1: their texts vary with the page, too,
so entropy does not tell them. An article or main inside a part that is noise
by its name (a wrapper named after its sidebar) or a form is none of it. In an
article or main a branch goes only by entropy, if ``LEAST_PAGES`` pages or more
all repeat it. Branches below ``LEAST_IMPORTANCE`` are taken out of every page.

Only texts' hashes and paths are gathered, summed per task first; what goes
back to the pages is the list of removed paths of each host.

Defined results: null or empty html, and pages without text, give an empty
text. Pages without a host in their url are one site. Where all text of a page
lies in branches of low importance (a host of copies), that of articles and
neutral branches stays, else that of parts that are noise by name alone. Equal
pages give equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise.llm.batches import add_columns, emit, table
from markwise.llm.html_blocks import ARTICLE, NOISE, Block, blocks_of
from markwise.session import written

LEAST_IMPORTANCE = 0.35
CONTENT_PART = 0.9
ARTICLE_RAISE, LEAST_PAGES = 0.3, 5
NODES_AT_ONCE = 200_000
BROADCAST_BYTES = 16 << 20
PAGE, TEXT, LAYOUT = 0, 1, 2


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def style_tree(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages, importance): the merged nodes of all hosts."""
    sent = df.select(host_of(df[url]).alias("host"), F.coalesce(df[html], F.lit("")).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed():
            rows = [(*key, n) for key, n in seen.items()]
            seen.clear()
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return emit(["host", "path", "kind", "feature", "n"], types, rows)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set()
                for block in blocks_of(page):
                    text = xxhash.xxh3_64_intdigest(block.text) >> 1
                    layout = xxhash.xxh3_64_intdigest("|".join(block.siblings)) >> 1
                    found |= {(block.path, PAGE, 0), (block.path, TEXT, text), (block.path, LAYOUT, layout)}
                seen.update((host, *node) for node in found)
                if len(seen) > NODES_AT_ONCE:
                    yield flushed()
        yield flushed()

    nodes = sent.mapInArrow(count, "host string, path string, kind int, feature long, n long")
    summed = nodes.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))

    def of(kind, value):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))

    spread = F.col("n") * F.log("n")
    merged = summed.groupBy("host", "path").agg(
        of(PAGE, F.col("n")).cast("long").alias("pages"),
        of(TEXT, F.col("n")).alias("texts"),
        of(TEXT, spread).alias("text_spread"),
        of(LAYOUT, F.col("n")).alias("layouts"),
        of(LAYOUT, spread).alias("layout_spread"),
    )
    log_m = F.log("pages")
    content = F.greatest(F.lit(0.0), 1 - F.col("text_spread") / F.col("texts") / log_m)
    presentation = F.greatest(F.lit(0.0), 1 - F.col("layout_spread") / F.col("layouts") / log_m)
    own = F.when(F.col("pages") > 1, CONTENT_PART * content + (1 - CONTENT_PART) * presentation).otherwise(1.0)
    raised = F.when(F.col("pages") < LEAST_PAGES, 1.0).otherwise(ARTICLE_RAISE)
    role = F.when(F.startswith("path", F.lit(NOISE)), -1.0).when(F.startswith("path", F.lit(ARTICLE)), raised).otherwise(0.0)
    return merged.select("host", "path", "pages", (own + role).alias("importance"))


def main_text(blocks: list[Block], removed: set[str]) -> str:
    kept = [b for b in blocks if b.path not in removed]
    if not kept:
        kept = [b for b in blocks if b.role != NOISE] or [b for b in blocks if not b.sealed]
    return "\n\n".join(b.text for b in kept)


def extract_text(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with ``text``, the main text of each page."""
    keep = df.columns if keep is None else keep
    low = style_tree(df, url, html).filter(F.col("importance") < LEAST_IMPORTANCE)
    removed = written(low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("_removed")), "removed")
    size = removed.agg(F.sum(F.expr("length(host) + aggregate(_removed, 0, (n, p) -> n + length(p))"))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        removed = F.broadcast(removed)
    names = [f"k{i}" for i in range(len(keep))]
    pages = df.select(
        *[df[c].alias(n) for c, n in zip(keep, names, strict=True)], host_of(df[url]).alias("host"),
        F.coalesce(df[html], F.lit("")).alias("html"),
    ).join(removed, "host", "left")

    def make():
        sets: dict[str, set[str]] = {}

        def work(host, page, paths):
            out = []
            for i, (h, text) in enumerate(zip(host.to_pylist(), page.to_pylist(), strict=True)):
                if h not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[h] = set(paths[i].as_py() or [])
                out.append(main_text(blocks_of(text), sets[h]))
            return [out]

        return work

    done = add_columns(pages, ["host", "html", "_removed"], T.StructType([T.StructField("text", T.StringType())]), make, names)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True) if c != "text"], "text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
