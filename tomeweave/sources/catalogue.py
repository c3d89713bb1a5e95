"""Folders and archives as tables.

Files are read with Spark's own ``binaryFile`` source, so any store that Spark can open will do, and
listings don't read contents. Archives are opened inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave.functions import columns as C
from tomeweave.functions.title import parse_title, parsed
from tomeweave.plans.storage import materialize
from tomeweave.sources.backends import BackendError, Fallback
from tomeweave.sources.images import image_header

LEAST_IMAGES, MOST_ROUNDS = 3, 5
#: Bytes of a loose image that are looked at for its size.
HEAD_BYTES = 1 << 18
ENTRY = "container string, name string, size bigint, is_dir boolean, error string"
PAGE = "container string, name string, size_bytes bigint, width int, height int, image_format string, n_pages int, size bigint, error string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path and size of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    return found.withColumn("rel_path", _relative(root)).select("rel_path", "size", "path")


def _relative(root: str):
    tail = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.element_at(F.split(plain, F.lit(_quoted(tail)), 2), -1)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _contents(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, kind and content of every file; of a single archive as root, of its members."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if not _kind(root):
        return found.withColumn("rel_path", _relative(root)).withColumn("kind", C.kind_of(F.col("rel_path"))).select("rel_path", "kind", F.col("length").alias("size"), "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (content,) in batch.itertuples(index=False):
                archive = Fallback(bytes(content), _kind(root))
                for name, data in archive.read([e[0] for e in archive.entries() if not e[2]]):
                    yield pd.DataFrame([(name, _kind(name), len(data), data)], columns=["rel_path", "kind", "size", "content"])

    return found.select("content").mapInPandas(members, "rel_path string, kind string, size bigint, content binary").withColumn("rel_path", C.safe_member(F.col("rel_path")))


def _archives(spark: SparkSession, root: str, backend: str, expand: bool) -> DataFrame:
    """rel_path, kind and content of every archive; with ``expand`` inner volumes in place of archives titled as a range."""
    rows = expand_ranges(spark, root, backend) if expand else _contents(spark, root).where("kind <> ''")
    return rows.select("rel_path", "kind", "content")


def archive_entries(spark: SparkSession, root: str, backend: str = "auto", expand: bool = False) -> DataFrame:
    """Members of every archive below ``root``; an archive that can't be read gives one row with the error. ``expand``: see ``_archives``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in batch[["rel_path", "kind", "content"]].itertuples(index=False):
                try:
                    rows = [(path, n, s, d, None) for n, s, d in Fallback(bytes(content), kind, backend).entries()]
                except BackendError as e:
                    rows = [(path, None, None, False, str(e))]
                yield pd.DataFrame(rows, columns=["container", "name", "size", "is_dir", "error"]).astype({"size": "Int64"})

    return _archives(spark, root, backend, expand).mapInPandas(run, ENTRY).withColumn("name", C.safe_member(F.col("name")))


def archive_pages(spark: SparkSession, root: str, sample: int = 16, backend: str = "auto", expand: bool = False) -> DataFrame:
    """Measured pages of every archive below ``root``: at most ``sample`` a container, by place in natural order.

    Each row has the container's number of pages and its size too, so that one read of an archive tells all of it.
    """
    import re

    digits = re.compile(r"(\d+)", re.ASCII)

    def order(name: str) -> list:
        return [(0, int(p), "") if p.isdigit() and p.isascii() else (1, 0, p.lower()) for p in digits.split(name) if p]

    image = re.compile(r"\.(jpg|jpeg|jpe|png|gif|bmp|webp|tif|tiff|avif|jxl)$", re.IGNORECASE)

    def wanted(entries: list[tuple]) -> tuple[list[tuple], int]:
        pages = [e for e in entries if not e[2] and image.search(e[0]) and not e[0].lower().startswith("__macosx/") and "/__macosx/" not in e[0].lower()]
        pages.sort(key=lambda e: order(e[0]))
        n = len(pages)
        if n > sample:
            places = [0] if sample == 1 else sorted({round(i * (n - 1) / (sample - 1)) for i in range(sample)})
            pages = [pages[i] for i in places]
        return pages, n

    def measured(archive) -> tuple[int, list[tuple]]:
        pages, n = wanted(archive.entries())
        return n, [(name, len(data), head) for name, data in archive.read([e[0] for e in pages]) if (head := image_header(data))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in batch[["rel_path", "kind", "content"]].itertuples(index=False):
                rows, n, size = [], None, len(content)
                try:
                    n, heads = Fallback(bytes(content), kind, backend).attempt(measured)
                    rows = [(path, name, length, head.width, head.height, head.format, n, size, None) for name, length, head in heads]
                    if not rows:
                        rows = [(path, None, None, None, None, None, n, size, "no readable page")]
                except BackendError as e:
                    rows = [(path, None, None, None, None, None, n, size, str(e))]
                yield pd.DataFrame(rows, columns=["container", "name", "size_bytes", "width", "height", "image_format", "n_pages", "size", "error"]).astype({"size_bytes": "Int64", "width": "Int32", "height": "Int32", "n_pages": "Int32"})

    return _archives(spark, root, backend, expand).mapInPandas(run, PAGE)


def discover(listing: DataFrame, duplicates_folder: str = "_重複") -> DataFrame:
    """Items of a listing (rel_path, size): archives, folders of images, and sets of images of one volume in a folder.

    A folder with LEAST_IMAGES images or more is a volume and nothing below it is looked at; it is split
    into sets if every image's name tells a volume, there are several, and each has LEAST_IMAGES images. A folder
    whose own name has no volume takes an explicit one from its first such image. Columns: rel_path, kind, name,
    title, total_bytes, page_count (null for archives).
    """
    rows = listing.where(~F.array_contains(F.split("rel_path", "/"), duplicates_folder))
    parent = F.when(F.contains("rel_path", F.lit("/")), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("")
    rows = rows.withColumn("folder", parent).withColumn("kind", C.kind_of(F.col("rel_path")))
    images = rows.where(C.is_image(F.col("rel_path")) & ~C.is_ignored(F.col("rel_path")))
    counts = images.groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where(F.col("n") >= LEAST_IMAGES)
    # a volume folder inside another is part of it
    above = counts.select("folder", "n", "bytes", F.explode(F.filter(C.ancestors(F.col("folder")), lambda a: a != F.col("folder"))).alias("a"))
    inner = above.join(counts.select(F.col("folder").alias("a")), "a", "left_semi").select("folder").distinct()
    volumes = counts.join(inner, "folder", "left_anti")
    under = rows.where("kind <> ''").withColumn("a", F.explode(F.filter(C.ancestors(F.col("folder")), lambda a: a != F.col("folder")))).join(volumes.select(F.col("folder").alias("a")), "a", "left_semi")
    archives = rows.where("kind <> ''").join(under.select("rel_path").distinct(), "rel_path", "left_anti")
    archives = archives.select("rel_path", "kind", C.base_name(F.col("rel_path")).alias("name"), parsed(C.base_name(F.col("rel_path"))).alias("title"), F.col("size").alias("total_bytes"), F.lit(None).cast("int").alias("page_count"))

    inside = images.join(volumes.select("folder"), "folder", "left_semi").select("folder", "size", C.base_name(F.col("rel_path")).alias("image"))
    told = inside.withColumn("t", parsed(F.col("image"))).select("folder", "size", "image", F.col("t.volume").alias("volume"), F.col("t.volume_kind").alias("volume_kind"), F.col("t.series").alias("series"))
    sets = told.groupBy("folder", "volume", "volume_kind").agg(F.count("*").cast("int").alias("n"), F.sum("size").alias("bytes"), F.min_by("series", "image").alias("series"), F.min("image").alias("first"))
    w = Window.partitionBy("folder")
    sets = sets.withColumn("ok", (F.count("volume").over(w) == F.count("*").over(w)) & (F.count("*").over(w) > 1) & (F.min("n").over(w) >= LEAST_IMAGES))
    split = sets.where("ok").withColumn("t", parsed(C.base_name(F.col("folder"))))
    series = F.when(F.col("t.series") != "", F.col("t.series")).otherwise(F.min_by("series", "first").over(w))
    split = split.withColumn("s", series)
    made = F.struct(F.col("s").alias("series"), "volume", "volume_kind", F.col("t.editions").alias("editions"), F.col("t.display").alias("display"))
    split = split.select(F.format_string("%s#第%s巻", "folder", "volume").alias("rel_path"), F.lit("imageset").alias("kind"), C.base_name(F.col("folder")).alias("name"), made.alias("title"), F.col("bytes").alias("total_bytes"), F.col("n").alias("page_count"))

    whole = volumes.join(sets.where("ok").select("folder").distinct(), "folder", "left_anti")
    explicit = inside.withColumn("t", parsed(F.col("image"), bare=False)).where("t.volume is not null").groupBy("folder").agg(F.min_by("t", "image").alias("child"))
    whole = whole.join(explicit, "folder", "left").withColumn("t", parsed(C.base_name(F.col("folder"))))
    adopt = F.col("t.volume").isNull() & F.col("child").isNotNull()
    made = F.struct(
        F.when(adopt & (F.col("t.series") == ""), F.col("child.series")).otherwise(F.col("t.series")).alias("series"), *(F.when(adopt, F.col(f"child.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in ("volume", "volume_kind")),
        F.col("t.editions").alias("editions"), F.col("t.display").alias("display"),
    )
    whole = whole.select(F.col("folder").alias("rel_path"), F.lit("folder").alias("kind"), C.base_name(F.col("folder")).alias("name"), made.alias("title"), F.col("bytes").alias("total_bytes"), F.col("n").cast("int").alias("page_count"))
    return archives.unionByName(split).unionByName(whole)


def numbered(items: DataFrame) -> DataFrame:
    """Adds item_id, the place from 1 on in natural order of rel_path: ranks within ranges, and the ranges' sizes before them."""
    order = (F.array_join("__key", "\x00"), F.col("rel_path"))
    placed = items.withColumn("__key", C.natural_key(F.col("rel_path"))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()).drop("__key"))  # range << 33 | place in it
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__range")).count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    nth = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return placed.join(F.broadcast(before), F.shiftright("__at", 33) == F.col("__range")).withColumn("item_id", nth).select(*items.columns, "item_id")


def expand_ranges(spark: SparkSession, root: str, backend: str = "auto") -> DataFrame:
    """Archives inside archives that are titled as a range, to MOST_ROUNDS levels: container, rel_path, kind, content, error.

    An archive whose members can't be read stays as one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, todo = [], [(p, p, k, bytes(c), 0) for p, k, c in batch[["rel_path", "kind", "content"]].itertuples(index=False)]
            while todo:
                top, path, kind, content, level = todo.pop()
                if parse_title(path.rsplit("/", 1)[-1]).volume_kind != "range" or level == MOST_ROUNDS:
                    out.append((top, path, kind, content, None))
                    continue
                try:
                    archive = Fallback(content, kind, backend)
                    names = [e[0] for e in archive.entries() if not e[2]]
                    inner = [(n, data) for n, data in archive.read([n for n in names if _kind(n)])]
                except BackendError as e:
                    out.append((top, path, kind, content, str(e)))
                    continue
                if not inner:
                    out.append((top, path, kind, content, None))
                todo += [(top, f"{path}/{n}", _kind(n), data, level + 1) for n, data in inner]
            yield pd.DataFrame(out, columns=["container", "rel_path", "kind", "content", "error"])

    rows = _contents(spark, root).where("kind <> ''").select("rel_path", "kind", "content")
    return rows.mapInPandas(run, "container string, rel_path string, kind string, content binary, error string")


def _kind(name: str) -> str:
    low = name.lower()
    return next((k for k, s in (("zip", (".zip", ".cbz")), ("rar", (".rar", ".cbr")), ("7z", (".7z", ".cb7"))) if low.endswith(s)), "")


def load_aliases(text: str) -> dict[str, str]:
    """A JSON object {canonical: [variants] or variant} as a map from variant to canonical series key; later ones win."""
    import json

    from tomeweave.functions.title import normalized, series_key

    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"aliases are no JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError("aliases must be a JSON object")
    table: dict[str, str] = {}
    for name, variants in raw.items():
        if not isinstance(variants, (str, list)):
            raise ValueError(f"variants of {name} must be a string or a list")
        if target := series_key(normalized(str(name))):
            for v in (name, *([variants] if isinstance(variants, str) else variants)):
                if key := series_key(normalized(str(v))):
                    table[key] = target
    return table


def read_catalogue(spark: SparkSession, root: str, sample: int = 16, backend: str = "auto") -> DataFrame:
    """Titled, measured items below ``root``, a folder or a single archive, ready for the engine.

    Every archive is read once, and of loose images the heads. Of folders, sets and archives alike at most ``sample`` pages
    are measured, by place in natural order.
    """
    from tomeweave.operators.measure import item_metrics, sampled

    pages = materialize(archive_pages(spark, root, sample, backend, expand=True))  # inner volumes of range archives are items
    volumes = pages.groupBy(F.col("container").alias("rel_path")).agg(F.max("size").alias("size"))
    loose = _contents(spark, root).where(C.is_image(F.col("rel_path"))).select("rel_path", "size", F.substring("content", 1, HEAD_BYTES).alias("head"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *((h.width, h.height) if (h := image_header(bytes(c))) else (None, None))) for p, n, c in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    singles = materialize(loose.mapInPandas(heads, "path string, size_bytes bigint, width int, height int"))
    items = numbered(discover(singles.select(F.col("path").alias("rel_path"), F.col("size_bytes").alias("size")).unionByName(volumes)))
    folders = items.where("kind in ('folder', 'imageset')").withColumn("folder", C.place_of(F.col("rel_path"), F.col("kind")))
    placed = singles.withColumn("folder", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).withColumn("volume", parsed(C.base_name(F.col("path")))["volume"])
    same = (F.col("kind") == "folder") | (placed["volume"] == folders["title.volume"])
    of_folders = placed.join(folders, "folder").where(same).withColumn("natural", C.natural_key(F.col("path")))
    of_folders = sampled(of_folders, sample, ["natural", "path"]).where("width is not null").select("item_id", "size_bytes", "width", "height")
    of_archives = pages.where("error is null").join(items.select("item_id", F.col("rel_path").alias("container")), "container").select("item_id", "size_bytes", "width", "height")
    told = pages.groupBy(F.col("container").alias("rel_path")).agg(F.max("error").alias("measure_error"), F.max("n_pages").alias("inner_pages"))
    metrics = item_metrics(of_folders.unionByName(of_archives)).select("item_id", "median_pixels", "median_bpp")
    out = items.join(metrics, "item_id", "left").join(told, "rel_path", "left")
    return out.select(
        "item_id", "rel_path", "kind", "name", F.col("name").alias("label"), *(F.col(f"title.{c}").alias(c) for c in ("series", "volume", "volume_kind", "editions", "display")),
        C.scope_of(F.col("rel_path"), F.col("kind")).alias("scope"), F.coalesce("page_count", "inner_pages", F.lit(0)).alias("page_count"), "total_bytes",
        F.coalesce("median_pixels", F.lit(0.0)).alias("median_pixels"), F.coalesce("median_bpp", F.lit(0.0)).alias("median_bpp"),
        F.col("median_pixels").isNotNull().alias("measured"), F.coalesce("measure_error", F.lit("")).alias("measure_error"),
    )
