"""Main text of pages by nearest-URL page differencing.

Within a host, each page is paired with the page nearest to it in the order of URL paths. Their text lines are aligned
by longest common subsequence, and lines that both share are deleted as parts of the site's template. A line inside an
element that the page itself marks as its article is text of the page, also if a neighbour has it too (a quote, a
licence, a copy), so it is put back; what the markup names as menu, header, footer, sidebar, notice, advert, form or
comment goes even if the neighbour lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.blocks import OPEN, TEMPLATE, lines
from parcelweave.llm.frames import carried, chunks, materialize, released, restored, schema_of, ship_package

# Bits of the alignment table that are kept at once; longer pages are aligned half by half.
TABLE_BITS = 1 << 27


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of `a` a number whose bit j is 0 where the common length grows with b[j]."""
    where: dict[int, int] = {}
    for j, value in enumerate(b):
        where[value] = where.get(value, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for value in a:
        hit = row & where.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common length of `a` with each prefix of `b`, the empty one first."""
    last = (1 << len(b)) - 1
    for last in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[:len(b)].astype(np.int64))))


def common(a: list[int], b: list[int], base: int = 0) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`, rising."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    first, last = list(range(base, base + head)), list(range(base + len(a) - tail, base + len(a)))
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    base += head
    if not a or not b:
        return first + last
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        split = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return first + common(a[:half], b[:split], base) + common(a[half:], b[split:], base + half) + last
    size = -(-len(b) // 8)
    table = [row.to_bytes(size, "little") for row in _rows(a, b)]
    i, j, inner = len(a), len(b), []
    while i and j:
        at, bit = (j - 1) // 8, 1 << (j - 1) % 8
        if table[i - 1][at] & bit:
            j -= 1
        elif i > 1 and not table[i - 2][at] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            inner.append(base + i)
    return first + inner[::-1] + last


def shared_lines(own: list[int], other: list[int], kinds: list[int]) -> list[int]:
    """Undecided lines that the alignment with the other page shares; none if nothing would be left of the page."""
    loose = [i for i, kind in enumerate(kinds) if kind == OPEN]
    if not loose:
        return []
    gone = set(common(own, other)).intersection(loose)
    return sorted(gone) if len(gone) < len(loose) else []


def _keyed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """`_host _path _digest _html` and the other columns; `_host` is '' for a URL without one."""
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return pages.select(
        F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("_host"),
        F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("_path"),
        F.unhex(F.md5(F.coalesce(F.col(html), F.lit("")).cast("binary"))).alias("_digest"),
        F.col(html).alias("_html"), carried(pages, html))


KEY = ("_host", "_path", "_digest")


def _line_table(keyed: DataFrame) -> DataFrame:
    """(_host, _path, _digest, hashes, kinds), once for each different page of a host; no text travels."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_html"):
                    found = [lines(x or "") for x in rows.column("_html").to_pylist()]
                    hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in page] for page in found]
                    yield pa.RecordBatch.from_arrays(
                        [*rows.select(KEY).columns, pa.array(hashes, pa.list_(pa.int64())),
                         pa.array([[k for _, k in page] for page in found], pa.list_(pa.int32()))],
                        names=[*KEY, "hashes", "kinds"])

    slim = keyed.where("_host <> ''").select(*KEY, "_html")
    found = slim.mapInArrow(read, schema_of(slim, ("_html",), "hashes array<bigint>, kinds array<int>"))
    one = F.first(F.struct("hashes", "kinds")).alias("one")  # the same for all pages of a key
    return materialize(found.groupBy(*KEY).agg(one).select(*KEY, "one.*"), "page-lines")


def _common_start(a: Column, b: Column) -> Column:
    """Number of leading characters two paths share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.length(a))


def paired(table: DataFrame) -> DataFrame:
    """(_host, _path, _digest, path2, digest2): each page and the page of its host that is nearest in path order.

    Of the pages before and after it the one whose path shares the longer beginning, the one before in a tie. Ranges of
    the order are tasks, so a host of any size is spread over them; a row for each range tells the pages at its borders.
    """
    spark = table.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    me = F.struct(*KEY)
    ranged = materialize(table.select(*KEY).repartitionByRange(n, *KEY).withColumn("_part", F.spark_partition_id()), "page-order")
    order = Window.orderBy("_part")  # over a row a range
    edges = ranged.groupBy("_part").agg(F.min(me).alias("low"), F.max(me).alias("high")).select(
        "_part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    inside = Window.partitionBy("_part").orderBy(*KEY)
    near = ranged.join(F.broadcast(edges), "_part").select(
        *KEY, F.coalesce(F.lag(me).over(inside), "before").alias("prev"), F.coalesce(F.lead(me).over(inside), "after").alias("next"))
    score = {side: F.when(F.col(side)["_host"] == F.col("_host"), _common_start(F.col("_path"), F.col(side)["_path"]))
             for side in ("prev", "next")}
    chosen = F.when(F.coalesce(score["next"], F.lit(-1)) > F.coalesce(score["prev"], F.lit(-1)), F.col("next")).when(
        score["prev"].isNotNull(), F.col("prev"))
    return near.withColumn("other", chosen).where("other IS NOT NULL").select(
        *KEY, F.col("other._path").alias("path2"), F.col("other._digest").alias("digest2"))


def _deleted(table: DataFrame) -> DataFrame:
    """(_host, _path, _digest, gone): numbers of the lines that a page shares with its nearest one."""
    other = table.select(F.col("_host").alias("host2"), F.col("_path").alias("path2"), F.col("_digest").alias("digest2"),
                         F.col("hashes").alias("hashes2"))
    met = paired(table).join(table, list(KEY)).withColumn("host2", F.col("_host")).join(other, ["host2", "path2", "digest2"])
    slim = met.select(*KEY, "hashes", "kinds", "hashes2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [shared_lines(a.as_py(), b.as_py(), k.as_py()) for a, b, k in zip(
                batch.column("hashes"), batch.column("hashes2"), batch.column("kinds"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(KEY).columns, pa.array(gone, pa.list_(pa.int32()))], names=[*KEY, "gone"])

    out = slim.mapInArrow(compare, schema_of(slim.select(*KEY), (), "gone array<int>"))
    return materialize(out.where(F.size("gone") > 0), "deleted-lines")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` without its html, with `text` (blocks of the main text joined by line feeds) and `n_chars`.

    Null html is the empty page: ''. A page without a host, or alone on its host, has no partner and keeps all lines
    that its markup does not name as template; so does a page all of whose undecided lines its partner has, as then
    nothing tells text from template. Pages of one host that agree in path and html are one page to their neighbours and
    have the same text. Text lines meet by 64-bit hash, texts do not leave their rows. An empty table gives none; an input
    column named like a new one is replaced.
    """
    ship_package(pages.sparkSession)
    keyed = _keyed(pages, url, html)
    gone = _deleted(_line_table(keyed))
    met = keyed.join(gone, list(KEY), "left").drop(*KEY)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_html"):
                    texts = []
                    for page, cut in zip(rows.column("_html").to_pylist(), rows.column("gone").to_pylist(), strict=True):
                        cut = set(cut or ())
                        texts.append("\n".join(
                            [t for i, (t, kind) in enumerate(lines(page or "")) if kind != TEMPLATE and i not in cut]))
                    yield pa.RecordBatch.from_arrays([rows.column("_rest"), pa.array(texts, pa.string())], names=["_rest", "_text"])

    slim = met.select("_rest", "_html", "gone")
    out = slim.mapInArrow(extract, schema_of(slim, ("_html", "gone"), "_text string"))
    return restored(out, pages.drop(html), {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")})
