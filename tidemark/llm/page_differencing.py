"""Main text of web pages: nearest-URL page differencing.

Pages of one host are put in the order of their paths.  A page's neighbour is the one
before or after it whose path agrees longer.  Their lines outside article elements are
aligned by longest common subsequence, and lines they share, the site's template, are
deleted.  What the page itself marks as menu, footer, advert, notice, form or comments
goes too.  So that a large host falls into many blocks, pages whose hash says so start
one, and the NEAR pages on each side of a border are shown to both blocks.

A page that has an article or main element has its main text there.  Its lines are
aligned with those in the elements of the NEAR pages before and after it, and a line
is template if all of them share it, two at least: two articles may quote the same
line, and a page may be a copy of its neighbour, so copies don't count.  A page without
is judged by the nearest page that doesn't share nearly all its lines.  Where all do,
those that both have lines of their own decide, and what all of them share is template;
where there are none either, it is a copy and keeps its lines.

Defined cases: a null or empty page has an empty text; a null URL has no neighbour,
nor has the only page of a host; pages with equal paths are ordered by id; repeated
rows stay; extra columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .html_blocks import blocks
from .tables import small_batches
from .worker import begin

#: The share of a page's lines from which a neighbour that has them too is a copy.
COPY = 0.9
#: Pages on each side by which lines are judged.
NEAR = 2
#: Pages to a block of a host, about; most blocks of all hosts, about.
BLOCK, BLOCKS = 64, 16_384
#: Stands for a null id, which comes first.
LEAST_ID = -(1 << 63)


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, found by the increasing subsequences of equal pairs."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # the least end in b of a common subsequence of each length
    links: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def parsed_pages(pages: DataFrame, borders: Broadcast) -> DataFrame:
    """page_id, url, the lines that may be main text, whether they stand in an article, and checksums of those in and of all outside articles.  Rows are given once more, without lines, to the blocks at whose border they stand."""

    def checksum(text: str) -> int:
        return zlib.crc32(text.encode("utf-8", "surrogatepass"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pages")
        for batch in batches:
            lines, inside, inner, outer = [], [], [], []
            for page in batch.column(2).to_pylist():
                found = blocks(page or "")
                article = any(b.inside and not b.beside for b in found)
                own = [b for b in found if not b.beside and b.inside == article]
                lines.append([b.text for b in own])
                inside.append(article)
                # an article's headings equal no other page's: several articles may well have the same
                alone = checksum(page or "") << 24
                inner.append([-1 - (alone + k) if b.heading else checksum(b.text) for k, b in enumerate(own)] if article else [])
                outer.append([checksum(b.text) for b in found if not b.inside and (article or not b.beside)])
            places = [place(borders.value, *x) for x in zip(*(batch.column(k).to_pylist() for k in (3, 4, 0)), strict=True)]
            rows = pa.array([k for k, (_, shown) in enumerate(places) for _ in range(1 + len(shown))], pa.int64())
            blocks_of = [b for own, shown in places for b in (own, *shown)]
            guest = [g for _, shown in places for g in (False, *(True for _ in shown))]
            lines = [[] if g else lines[k] for k, g in zip(rows.to_pylist(), guest, strict=True)]
            inside, inner, outer = ([x[k] for k in rows.to_pylist()] for x in (inside, inner, outer))
            batch = batch.take(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(blocks_of, pa.int32()), pa.array(guest, pa.bool_()), pa.array(lines, pa.list_(pa.string())), pa.array(inside, pa.bool_()), pa.array(inner, pa.list_(pa.int64())), pa.array(outer, pa.list_(pa.int64()))], names=["page_id", "url", "host", "path", "block", "guest", "lines", "marked", "inner", "outer"])

    return pages.select("page_id", "url", "html", "host", "path").mapInArrow(parsed, "page_id long, url string, host string, path string, block int, guest boolean, lines array<string>, marked boolean, inner array<long>, outer array<long>")


def place(borders: dict[str, tuple[list, dict]], host: str | None, path: str | None, page_id: int | None) -> tuple[int, list[int]]:
    """A page's block in its host, and the other blocks that it is shown to."""
    starts, shown = borders.get(host, ((), {}))
    key = (path, LEAST_ID if page_id is None else page_id)
    return bisect.bisect_right(starts, key), shown.get(key, [])


def block_borders(pages: DataFrame) -> dict[str, tuple[list, dict]]:
    """By host of several blocks where they start, and the pages near a border with the blocks that they are shown to."""
    spark = pages.sparkSession
    keys = pages.select("host", "path", F.coalesce("page_id", F.lit(LEAST_ID)).alias("id"))
    every = max(BLOCK, -(-keys.count() // BLOCKS))
    starts: dict[str, list] = {}
    for host, path, i in keys.filter(F.pmod(F.xxhash64("host", "path", "id"), F.lit(every)) == 0).distinct().collect():  # BLOCKS rows, about
        starts.setdefault(host, []).append((path, i))
    for own in starts.values():
        own.sort()
    sent = spark.sparkContext.broadcast({host: (own, {}) for host, own in starts.items()})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each block's first and last pages, so many as are shown
        found: dict[tuple[str, int], tuple[list, list]] = {}
        for batch in batches:
            for host, path, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host in sent.value:
                    low, high = found.setdefault((host, place(sent.value, host, path, i)[0]), ([], []))
                    low[:] = sorted({*low, (path, i)})[:NEAR]
                    high[:] = sorted({*high, (path, i)})[-NEAR:]
        out = [(h, b, p, i) for (h, b), sides in found.items() for p, i in sorted({*sides[0], *sides[1]})]
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["host", "block", "path", "id"])

    one = F.struct("path", "id")
    found = keys.mapInArrow(ends, "host string, block int, path string, id long").distinct()
    up, down = Window.partitionBy("host", "block").orderBy("path", "id"), Window.partitionBy("host", "block").orderBy(F.desc("path"), F.desc("id"))
    kept = found.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).filter((F.col("_up") <= NEAR) | (F.col("_down") <= NEAR))
    near: dict[str, list] = {}
    for host, block, (path, i) in kept.select("host", "block", one).collect():  # 2 * NEAR rows a block
        near.setdefault(host, []).append((path, i, block))
    out = {}
    for host, own in starts.items():
        shown: dict[tuple, list[int]] = {}
        ordered = sorted(near.get(host, []))
        for k, (path, i, block) in enumerate(ordered):
            others = {b for _, _, b in ordered[max(0, k - NEAR) : k + NEAR + 1]} - {block}
            if others:
                shown[path, i] = sorted(others)
        out[host] = (own, shown)
    return out


def with_neighbours(pages: DataFrame) -> DataFrame:
    """Parsed pages and the checksums of their neighbours before and after, nearest first, with the paths."""
    bare = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    pages = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lower(F.regexp_extract(bare, "^[^/?#]*", 0)).alias("host"), F.regexp_extract(F.regexp_replace(bare, "^[^/?#]*", ""), "^[^?#]*", 0).alias("path"))
    addressed = pages.filter("url IS NOT NULL")
    borders = pages.sparkSession.sparkContext.broadcast(block_borders(addressed))
    order = Window.partitionBy("host", "block").orderBy("path", "page_id")
    one = F.struct("path", "inner", "outer")
    known = parsed_pages(addressed, borders)
    known = known.withColumns({"before": F.array(*(F.lag(one, k).over(order) for k in range(1, NEAR + 1))), "after": F.array(*(F.lead(one, k).over(order) for k in range(1, NEAR + 1)))}).filter("NOT guest").drop("guest", "block", "host")
    none = F.lit(None).cast("array<struct<path:string,inner:array<bigint>,outer:array<bigint>>>")
    unknown = parsed_pages(pages.filter("url IS NULL"), borders).withColumns({"before": none, "after": none}).drop("guest", "block", "host")
    return known.unionByName(unknown)


def agreement(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def repeated(inner: list[int], near: list[list[int]]) -> set[int]:
    """Places of an article's lines that the articles near it share, all that aren't copies and two at least."""
    found = [set(common_subsequence(inner, other)) for other in near if other]
    telling = [places for places in found if len(places) < COPY * len(inner)]
    return set.intersection(*telling) if len(telling) > 1 else set()


def template(outer: list[int], near: list[list[int]]) -> set[int]:
    """Places of the lines of a page without article that are template, by the pages near it, nearest first."""
    crowded = []
    for other in near:
        found = set(common_subsequence(outer, other))
        if other and len(found) < COPY * len(outer):
            return found
        if len(found) < min(len(outer), len(other)):
            crowded.append(found)
    return set.intersection(*crowded) if crowded else set()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, and n_shared: template lines found by its neighbour."""

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared_lines = [], []
            for row in batch.to_pylist():
                before, after = ([x for x in row[side] or () if x] for side in ("before", "after"))
                near = sorted(before + after, key=lambda x: -agreement(row["path"], x["path"]))
                shared = common_subsequence(row["outer"], near[0]["outer"]) if near else []
                gone = repeated(row["inner"], [x["inner"] for x in near]) if row["marked"] else template(row["outer"], [x["outer"] for x in near])
                # of a page without article the lines are the outer lines
                lines = [line for k, line in enumerate(row["lines"]) if k not in gone]
                texts.append("\n".join(lines))
                shared_lines.append(len(shared))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shared_lines, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    return with_neighbours(pages).mapInArrow(differenced, "page_id long, url string, text string, n_chars long, n_shared long")
