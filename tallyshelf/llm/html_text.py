"""Main text of web pages: subtrees that recur across a large share of a host's pages are its template and go.

Every page gives the hashes of its element subtrees. They are counted per host over pages of different
main text, so copies of one page make no template. What recurs is joined back to the pages that have it,
and each page is read again without it. Menus, forms, notices and the like go on any page by what they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm import html_tree
from tallyshelf.llm.common import column, fresh, join_small
from tallyshelf.session import settle

#: A subtree is template on half of a host's pages, and FEW_PAGES at least; a paragraph, heading, list item or
#: cell only on nine tenths of them, and MANY_PAGES at least. Shares, so that a text does not depend on how
#: many pages of its host are there.
FEW_PAGES, SHARE = 3, 50
MANY_PAGES, PROSE_SHARE = 8, 90


def host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SUBTREES = "struct<hashes: array<struct<hash: bigint, prose: boolean>>, print: bigint>"
_HASHES = pa.list_(pa.struct([("hash", pa.int64()), ("prose", pa.bool_())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for page in batch:
            found, print_ = html_tree.subtrees(html_tree.parse(page.as_py() or ""))
            hashes = [{"hash": _signed(h), "prose": prose} for h, prose in sorted(found.items())]
            out.append({"hashes": hashes, "print": _signed(print_)})
        yield pa.array(out, pa.struct([("hashes", _HASHES), ("print", pa.int64())]))


def _texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, templates in batches:
        yield pa.array([html_tree.text(p.as_py(), frozenset(h % (1 << 64) for h in t.as_py() or ()))
                        for p, t in zip(pages, templates)], pa.string())


def templates(pages: DataFrame) -> DataFrame:
    """Rows (page, templates) of pages with template subtrees, from columns page, host and html.

    A hot host is no hot key: counting is by (host, subtree), pre-aggregated in each task.
    """
    read = F.arrow_udf(_hashes, _SUBTREES)
    known = settle(pages.filter("host <> ''").select("page", "host", read("html").alias("s")).select(
        "page", "host", "s.print", F.inline_outer("s.hashes")))
    # Pages without such a subtree count as well.
    prints = known.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    counts = known.filter("hash IS NOT NULL").select("host", "hash", "prose", "print").distinct().groupBy("host", "hash", "prose").agg(F.count(F.lit(1)).alias("n"))
    least, share = F.when(F.col("prose"), MANY_PAGES).otherwise(FEW_PAGES), F.when(F.col("prose"), PROSE_SHARE).otherwise(SHARE)
    recurring = counts.filter(F.col("n") >= least).join(prints, "host").filter(
        100 * F.col("n") >= share * F.col("of")).select("host", "hash")
    return known.join(recurring, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("templates"))


def extract(pages: DataFrame, into: str = "text", url: str = "url", html: str = "html") -> DataFrame:
    """Add the main text of each page as column ``into`` (numbered where that name is taken).

    A null or empty page has the text ''. Without a host in its url a page is read by itself. Repeated
    rows each keep their row; an empty table gives none; pages are read whole. Inside an article only
    sections, never paragraphs, can be template; elsewhere a paragraph, heading, list item or cell is one
    only where nearly all pages of a host have it.
    """
    page, of, name = fresh(pages, "_page", "_templates", into)
    key = F.xxhash64(column(url), column(html))
    found = settle(templates(pages.select(key.alias("page"), host(column(url)).alias("host"), column(html).alias("html"))))
    rows = join_small(pages.withColumn(page, key), found.toDF(page, of), [page], "left", 512)
    return rows.withColumn(name, F.arrow_udf(_texts, "string")(column(html), column(of))).select(
        *[column(c) for c in pages.columns], column(name))
