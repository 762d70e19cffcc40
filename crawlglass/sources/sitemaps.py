"""Sitemap documents, and the walk from sitemap indexes to page URLs."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlglass.functions import html as H, text as T, urls
from crawlglass.operators.edges import Edges, store_edges
from crawlglass.operators.skew import first_per_key, with_group_position
from crawlglass.storage import materialize_counted

# Fixed value: where a sitemap names its URLs.
LOC_REGEX = r"(?is)<loc>\s*(.*?)\s*</loc>"
GZIP_MAGIC = "1F8B"


# Bytes of a zipped body that are unpacked at a time, and of its unpacked text.
ZIPPED_CHUNK, CHUNK = 64_000, 1_000_000
_LOC = re.compile(LOC_REGEX.encode())
_OPEN, _INDEX = b"<loc>", b"<sitemapindex"


def unzip_chunks(body: bytes) -> Iterator[bytes]:
    """The unpacked body, at most ``CHUNK`` bytes at a time; several members follow each other.

    Raises ``zlib.error`` or ``EOFError`` where the body is damaged or cut off.
    """
    left, at, member, members = b"", 0, None, 0
    while True:
        if not left:
            left, at = body[at : at + ZIPPED_CHUNK], at + ZIPPED_CHUNK
        if member is None:
            left = left.lstrip(b"\0") if members else left  # zeros may pad the end of a member
            if not left:
                if at >= len(body):
                    return
                continue
            member = zlib.decompressobj(wbits=31)
        if not left and at >= len(body):
            raise EOFError("cut off")
        yield member.decompress(left, CHUNK)
        left = member.unconsumed_tail
        if member.eof:
            left, member, members = member.unused_data, None, members + 1


def _is_whole(body: bytes) -> bool:
    try:
        for _ in unzip_chunks(body):
            pass
    except (EOFError, zlib.error):
        return False
    return True


def _unzipped(body: bytes) -> bytes:
    """The unpacked body; what only looked like gzip, is cut off or damaged is passed on as it is."""
    return b"".join(unzip_chunks(body)) if body and _is_whole(body) else body


def scan_chunks(chunks: Iterable[bytes]) -> Iterator[tuple[bytes | None, bool]]:
    """The ``<loc>`` texts of a body that comes in chunks, as ``(text, False)``; last ``(None, whether it is an index)``.

    What is kept from one chunk to the next starts at the last ``<loc>`` that is still open, or holds the few bytes in
    which a tag may have begun.
    """
    held, index = b"", False
    for chunk in chunks:
        text = held + chunk
        index = index or _INDEX in text.lower()
        end = 0
        for found in _LOC.finditer(text):
            yield found[1], False
            end = found.end()
        opened = text.lower().find(_OPEN, end)
        held = text[opened:] if opened >= 0 else text[max(end, len(text) - len(_INDEX) + 1) :]
    yield None, index


def _zipped() -> Column:
    """Bodies that carry the gzip mark, or whose URL ends in ``.gz``."""
    marked = F.hex(F.substring("body", 1, 2)) == GZIP_MAGIC
    return F.coalesce(marked | F.lower("sitemap_url").endswith(".gz"), F.lit(False))


def sitemap_docs(fetched: DataFrame) -> DataFrame:
    """``(sitemap_url, status, body binary)`` to ``(sitemap_url, body string)``.

    Failed fetches are dropped.  Only zipped bodies go through Arrow to be unpacked, whole: where only their entries
    are wanted, :func:`document_locations` reads them chunk by chunk.
    """
    ok = fetched.filter("status = 200").select("sitemap_url", "body")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one unpacked body at a time is held
                body = batch.column("body")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sitemap_url").slice(i, 1), pa.array([None if body is None else _unzipped(body)], pa.binary())],
                    names=["sitemap_url", "body"],
                )

    unpacked = ok.filter(_zipped()).mapInArrow(unpack, "sitemap_url string, body binary")
    both = ok.filter(~_zipped()).unionByName(unpacked)
    return both.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))


def zipped_locations(zipped: DataFrame) -> DataFrame:
    """``(sitemap_url, is_index, pos, loc)`` of zipped bodies, whatever size they unpack to.

    A body is unpacked three times, a chunk at a time: to see that it is whole, to see whether it is an index, and to
    read its entries.  One that is not whole counts as the text it is, as in :func:`sitemap_docs`.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                url, body = batch.column("sitemap_url")[i].as_py(), batch.column("body")[i].as_py() or b""
                chunks = (lambda: unzip_chunks(body)) if _is_whole(body) else (lambda: [body])  # noqa: B023
                index = any(last for text, last in scan_chunks(chunks()) if text is None)
                found, pos = [], 0
                for text, _ in scan_chunks(chunks()):
                    if text is not None:
                        found.append(text)
                    if found and (text is None or len(found) == 10_000):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([url] * len(found), pa.string()), pa.array([index] * len(found)),
                             pa.array(range(pos, pos + len(found)), pa.int32()), pa.array(found, pa.binary())],
                            names=["sitemap_url", "is_index", "pos", "loc"],
                        )
                        pos, found = pos + len(found), []

    rows = zipped.select("sitemap_url", "body").mapInArrow(read, "sitemap_url string, is_index boolean, pos int, loc binary")
    return rows.withColumn("loc", urls.xml_unescape(F.make_valid_utf8(F.col("loc").cast("string"))))


def read_sitemap_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """``(sitemap_url, status, body)`` of stored sitemap files; the URL is ``base_url`` and the file's name."""
    files = spark.read.format("binaryFile").load(path)
    file_name = T.url_decode(F.element_at(F.split("path", "/"), -1))
    return files.select(F.concat(F.lit(base_url), file_name).alias("sitemap_url"), F.lit(200).alias("status"), F.col("content").alias("body"))


def locations(body: Column) -> Column:
    """Unescaped ``<loc>`` texts in document order."""
    return F.transform(H.extract_all(body, LOC_REGEX, 1), urls.xml_unescape)


def is_index(body: Column) -> Column:
    return F.contains(F.lower(body), F.lit("<sitemapindex"))


def _cap_per_group(
    df: DataFrame, groups: list[str], order: list[str], cap: int, taken: DataFrame | None, label: str
) -> DataFrame:
    """Keep rows while the group's total, earlier rows included, stays within ``cap``."""
    ranked = with_group_position(df, groups, order, "_pos", label)
    if taken is not None:
        used = taken.groupBy(*groups).agg(F.count(F.lit(1)).alias("_used"))
        ranked = ranked.join(used, groups, "left")
    else:
        ranked = ranked.withColumn("_used", F.lit(0))
    return ranked.filter(F.col("_pos") + F.coalesce("_used", F.lit(0)) < cap).drop("_pos", "_used")


def document_locations(docs: DataFrame) -> Edges:
    """``(sitemap_url, is_index, pos, loc)`` of all documents, stored by document, so bodies are read once.

    ``docs`` is :func:`sitemap_docs`, or the fetched ``(sitemap_url, status, body binary)`` themselves: then zipped
    bodies are never unpacked as a whole.
    """
    texts, zipped = docs, None
    if "status" in docs.columns:
        ok = docs.filter("status = 200")
        zipped = zipped_locations(ok.filter(_zipped()))
        texts = ok.filter(~_zipped()).withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))
    found = texts.select(
        "sitemap_url", is_index(F.col("body")).alias("is_index"), F.posexplode(locations(F.col("body"))).alias("pos", "loc")
    )
    return store_edges(found if zipped is None else found.unionByName(zipped), "sitemap_url", "sitemap-locations")


def sitemap_walk(
    seeds: DataFrame, locs: Edges, max_sitemaps: int | None = None
) -> DataFrame:
    """Sitemap documents reached from ``seeds(site, sitemap_url, pos)``, level by level.

    ``locs`` is :func:`document_locations`.

    Returns ``(site, sitemap_url, level, path)``; ``path`` holds the positions on
    the way down, so (level, path) is the breadth-first order.  A document counts
    for the cap of its site even when it could not be collected.  Every level is
    one job and one written table, and a document is visited once, so the walk
    ends on cyclic indexes.
    """
    frontier = seeds.select(
        "site",
        T.strip(F.col("sitemap_url")).alias("sitemap_url"),
        F.lit(0).alias("level"),
        F.array(F.col("pos").cast("bigint")).alias("path"),
    )
    reached, total, level = None, 0, 0
    while True:
        frontier = first_per_key(frontier, ["site", "sitemap_url"], ["path"])
        if reached is not None:
            frontier = frontier.join(reached, ["site", "sitemap_url"], "left_anti")
        frontier, n = materialize_counted(frontier, "sitemap-level")
        if n and max_sitemaps is not None and n + total > max_sitemaps:
            frontier, n = materialize_counted(
                _cap_per_group(frontier, ["site"], ["path"], max_sitemaps, reached, "sitemap-rank"), "sitemap-level"
            )
        if n == 0 and reached is not None:
            return reached
        reached = frontier if reached is None else reached.unionByName(frontier)
        if n == 0:
            return reached
        total, level = total + n, level + 1
        frontier = locs.follow(frontier, "is_index").select(
            "site",
            T.strip(F.col("loc")).alias("sitemap_url"),
            F.lit(level).alias("level"),
            F.array_append("path", F.col("pos").cast("bigint")).alias("path"),
        )


def page_locations(reached: DataFrame, locs: Edges, same_domain: bool = True) -> DataFrame:
    """Page URLs of the reached urlset documents: ``(site, url, level, path)``, first occurrence only."""
    found = (
        locs.follow(reached, "NOT is_index")
        .select("site", "level", "path", "pos", "loc")
        .filter(urls.has_web_scheme(F.col("loc")))
    )
    if same_domain:
        found = found.filter(urls.same_site(F.col("loc"), F.col("site")))
    found = found.select(
        "site",
        urls.normalize(F.col("loc")).alias("url"),
        "level",
        F.array_append("path", F.col("pos").cast("bigint")).alias("path"),
    )
    return first_per_key(found, ["site", "url"], ["level", "path"])


def sitemap_expand(
    seeds: DataFrame,
    docs: DataFrame,
    max_sitemaps: int | None = None,
    max_urls: int | None = None,
    same_domain: bool = True,
) -> DataFrame:
    """Walk ``seeds(site, sitemap_url, pos)`` to page URLs; ``site`` is a root host.

    Nothing is capped unless asked; caps hold for each site.
    """
    locs = document_locations(docs)
    pages = page_locations(sitemap_walk(seeds, locs, max_sitemaps), locs, same_domain)
    if max_urls:
        pages = _cap_per_group(pages, ["site"], ["level", "path"], max_urls, None, "sitemap-urls")
    return pages


# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
