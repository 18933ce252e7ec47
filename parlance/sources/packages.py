"""Zip-based document packages as tables of members, relationships and elements.

All three readers take a DataFrame of files (path, content), so they work on a folder
(`read_files`) as well as on packages another job produced.
"""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 20_000

# XML namespaces, the legacy file signature and workbook content types.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATIONSHIPS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE_RELATIONSHIPS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CONTENT_TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
LEGACY_MAGIC = "D0CF11E0A1B11AE1"
WORKBOOK_TYPES = {
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml": ".xlsx",
    "application/vnd.ms-excel.sheet.macroEnabled.main+xml": ".xlsm",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.template.main+xml": ".xltx",
    "application/vnd.ms-excel.template.macroEnabled.main+xml": ".xltm",
}

#: What a damaged archive, stream, checksum, encoding or XML part raises.
DAMAGED = (
    zipfile.BadZipFile, zlib.error, ElementTree.ParseError, NotImplementedError, RuntimeError,
    EOFError, LookupError, ValueError, OSError,
)

ELEMENT_TAGS = {
    "ins", "del", "moveFrom", "moveTo", "pPrChange", "rPrChange", "tblPrChange", "tblGridChange",
    "trPrChange", "tcPrChange", "sectPrChange", "numberingChange", "comment",
    "commentRangeStart", "commentRangeEnd", "commentReference", "sldId", "axId",
    "catAx", "valAx", "dateAx", "serAx",
}


def read_files(
    spark: SparkSession, path: str, pattern: str = "*", max_bytes: int | None = None
) -> DataFrame:
    """Package files under a path. Of files above `max_bytes` the content is not read but null,
    which the readers below report as `too_large`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if max_bytes is None:
        return files.select("path", "content")
    large = files.filter(F.col("length") > max_bytes)
    return files.filter(F.col("length") <= max_bytes).select("path", "content").unionByName(
        large.select("path", F.lit(None).cast("binary").alias("content"))
    )


def _per_file(
    files: DataFrame, schema: str, names: list[str], rows_of: Callable[..., Iterator[tuple]]
) -> DataFrame:
    """Run a row generator over every file; an unreadable package gives one row with `error`."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        if content is None:
            yield (path, *[None] * (len(names) - 2), "too_large")
            return
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except DAMAGED:
            yield (path, *[None] * (len(names) - 2), "bad_package")
            return
        with archive:
            for row in rows_of(archive):
                yield path, *row

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows(path, content):
                    held.append(row)
                    if len(held) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
        yield pd.DataFrame(held, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(read, schema)


def package_members(files: DataFrame) -> DataFrame:
    """(path, idx, name, size, is_symlink, is_dir, error) of every archive member."""

    def rows(archive):
        for idx, info in enumerate(archive.infolist()):
            mode = (info.external_attr >> 16) & 0xFFFF
            yield idx, info.filename, info.file_size, stat.S_ISLNK(mode), info.is_dir(), None

    return _per_file(
        files,
        "path string, idx int, name string, size long, is_symlink boolean, is_dir boolean, error string",
        ["path", "idx", "name", "size", "is_symlink", "is_dir", "error"],
        rows,
    )


def _xml_parts(archive, wanted: Callable[[str], bool]) -> Iterator[tuple]:
    """(name, root or None when it cannot be read as XML) of each wanted part, the first of equal names."""
    for name in dict.fromkeys(archive.namelist()):
        if wanted(name):
            try:
                root = ElementTree.fromstring(archive.read(name))
            except DAMAGED:
                root = None
            yield name, root


def _target_place(part: Column, target: Column) -> Column:
    """struct(names, outside): the path of a relationship target from the package root.

    A relationship part lies in the folder `_rels` beside its source; targets without a leading
    slash start at the folder of the source. A path that climbs above the root is outside.
    """
    steps = F.split(part, "/")
    depth = F.size(steps) - 2
    beside = F.when(F.get(steps, depth) == "_rels", F.slice(steps, F.lit(1), F.greatest(depth, F.lit(0))))
    nowhere = F.array().cast("array<string>")
    # `+` is an ordinary character in a package path; broken escapes stay as they are.
    plain = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    plain = F.translate(plain, "\\", "/")
    start = F.when(plain.startswith("/"), nowhere).otherwise(F.coalesce(beside, nowhere))

    def walk(at: Column, step: Column) -> Column:
        up = F.slice(at["names"], F.lit(1), F.greatest(F.size(at["names"]) - 1, F.lit(0)))
        names = F.when(step == "..", up).when(step.isin("", "."), at["names"])
        return F.struct(
            names.otherwise(F.concat(at["names"], F.array(step))).alias("names"),
            (at["outside"] | ((step == "..") & (F.size(at["names"]) == 0))).alias("outside"),
        )

    root = F.struct(nowhere.alias("names"), F.lit(False).alias("outside"))
    return F.aggregate(F.concat(start, F.split(plain, "/")), root, walk)


def resolved_target(part: Column, target: Column) -> Column:
    """struct(resolved, escapes): the member a target points to, and whether it leaves the package."""
    place = _target_place(part, target)
    inner = (target != "") & ~target.startswith("#")
    name = F.when(inner & ~place["outside"], F.array_join(place["names"], "/"))
    return F.struct(name.alias("resolved"), F.coalesce(inner & place["outside"], F.lit(False)).alias("escapes"))


def package_edges(files: DataFrame) -> DataFrame:
    """(path, part, kind, seq, rel_id, type, target, mode, resolved, escapes, nth, error).

    `nth` counts the occurrences of the same relationship id or part name inside its part. Kind
    `relationship` is a row of a `.rels` part, kind `override` one of the content types, kind
    `broken` any XML part that cannot be read.
    """

    def rows(archive):
        for name, root in _xml_parts(archive, lambda n: n.endswith((".rels", ".xml"))):
            seen: Counter = Counter()
            if root is None:
                yield name, "broken", 0, None, None, None, None, 1, None
            elif name.endswith(".rels"):
                for seq, node in enumerate(root.findall(f"{RELATIONSHIPS}Relationship")):
                    get = node.attrib.get
                    key = get("Id", "")
                    seen[key] += 1
                    yield (name, "relationship", seq, key, get("Type", ""), get("Target", ""),
                           get("TargetMode"), seen[key], None)
            elif name == "[Content_Types].xml":
                for seq, node in enumerate(root.findall(f"{CONTENT_TYPES}Override")):
                    part = node.attrib.get("PartName", "")
                    key = part.lstrip("/")
                    seen[key] += 1
                    yield (name, "override", seq, None, node.attrib.get("ContentType", ""), part,
                           None, seen[key], None)

    read = _per_file(
        files,
        "path string, part string, kind string, seq int, rel_id string, type string, "
        "target string, mode string, nth int, error string",
        ["path", "part", "kind", "seq", "rel_id", "type", "target", "mode", "nth", "error"],
        rows,
    )
    relation = (F.col("kind") == "relationship") & ~F.col("mode").eqNullSafe("External")
    place = F.when(relation, resolved_target(F.col("part"), F.col("target")))
    declared = F.nullif(F.regexp_replace("target", "^/+", ""), F.lit(""))
    return read.withColumn("_place", place).select(
        "path", "part", "kind", "seq", "rel_id", "type", "target", "mode",
        F.when(F.col("kind") == "override", declared).otherwise(F.col("_place.resolved")).alias("resolved"),
        F.coalesce("_place.escapes", F.lit(False)).alias("escapes"),
        "nth", "error",
    )


def package_elements(files: DataFrame) -> DataFrame:
    """(path, part, seq, tag, namespace, parent, id, rel_id, author, date, val, error): revision,
    comment, slide and axis elements of the XML parts. `rel_id` is an id that names a relationship.
    A part that cannot be read gives one row with the error `invalid_xml`."""

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def rows(archive):
        for name, root in _xml_parts(archive, lambda n: n.endswith(".xml")):
            if root is None:
                yield (name, *[None] * 9, "invalid_xml")
                continue
            parents = {id(child): local(node.tag) for node in root.iter() for child in node}
            for seq, node in enumerate(root.iter()):
                tag = local(node.tag)
                if tag in ELEMENT_TAGS:
                    related = node.attrib.get(f"{OFFICE_RELATIONSHIPS}id")
                    got = {
                        local(key): value for key, value in node.attrib.items()
                        if not key.startswith(OFFICE_RELATIONSHIPS)
                    }
                    yield (name, seq, tag, node.tag[: -len(tag)], parents.get(id(node)), got.get("id"), related,
                           got.get("author"), got.get("date"), got.get("val"), None)

    return _per_file(
        files,
        "path string, part string, seq int, tag string, namespace string, parent string, id string, "
        "rel_id string, author string, date string, val string, error string",
        ["path", "part", "seq", "tag", "namespace", "parent", "id", "rel_id", "author", "date", "val", "error"],
        rows,
    )


def unsafe_member(name: Column) -> Column:
    """Absolute, empty, drive-prefixed or parent-climbing archive name."""
    parts = F.filter(F.split(name, "/"), lambda x: (x != "") & (x != "."))
    return (
        name.startswith("/")
        | (F.size(parts) == 0)
        | F.array_contains(parts, "..")
        | F.coalesce(F.get(parts, F.lit(0)).endswith(":"), F.lit(False))
    )


def format_error(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, detected, error): legacy workbooks by signature, others by declared content type."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in WORKBOOK_TYPES.items() for x in pair])
    declared = (
        edges.filter((F.col("kind") == "override") & (F.col("target") == "/xl/workbook.xml"))
        .groupBy("path")
        .agg(F.min_by("type", "seq").alias("_type"))
        .select("path", F.element_at(types, F.col("_type")).alias("_declared"))
    )
    heads = files.select("path", F.hex(F.substring("content", 1, 8)).alias("_magic"))
    rows = heads.join(declared, "path", "left").withColumn("_suffix", suffix)
    legacy = F.col("_suffix") == ".xls"
    detected = F.when(legacy & (F.col("_magic") == LEGACY_MAGIC), ".xls").when(
        ~legacy, F.col("_declared")
    )
    error = F.when(detected.isNull(), F.when(legacy, "not_legacy").otherwise("not_workbook")).when(
        detected != F.col("_suffix"), "suffix_mismatch"
    )
    return rows.select("path", detected.alias("detected"), error.alias("error"))
