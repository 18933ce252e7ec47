"""Audits over package members, relationship edges and elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import cap_per_group, missing_names
from parlance.sources.packages import WORD, unsafe_member

# Limits, required parts and tags.
MAX_MEMBERS = 20_000
MAX_TOTAL_BYTES = 512 * 1024 * 1024
MAX_MEMBER_BYTES = 128 * 1024 * 1024
REQUIRED_DOCUMENT_PARTS = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
REQUIRED_SLIDE_PARTS = (
    "[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels",
)
PROPERTY_CHANGES = (
    "pPrChange", "rPrChange", "tblPrChange", "tblGridChange", "trPrChange", "tcPrChange",
    "sectPrChange", "numberingChange",
)
AXIS_TAGS = ("catAx", "valAx", "dateAx", "serAx")
TOLERATED_AXES = ("2094734556",)
BASELINE_CODES = ("invalid_xml", "shape_out_of_bounds", "python_pptx_open_failed")
ISSUE_LIMIT = 200


def package_profile(
    members: DataFrame,
    required: Sequence[str] = REQUIRED_DOCUMENT_PARTS,
    media_prefix: str = "word/media/",
    max_members: int = MAX_MEMBERS,
    max_total: int = MAX_TOTAL_BYTES,
    max_member: int = MAX_MEMBER_BYTES,
) -> DataFrame:
    """Totals, missing required parts and the first broken limit per package; of one that cannot
    be read, its error and no members."""
    name = F.col("name")
    totals = members.groupBy("path").agg(
        F.count("name").alias("member_count"),
        F.max("error").alias("_unreadable"),
        F.sum("size").alias("uncompressed_bytes"),
        F.count_if(name.endswith(".xml") | name.endswith(".rels")).alias("xml_part_count"),
        F.count_if(name.startswith(media_prefix) & ~F.col("is_dir")).alias("media_count"),
        F.bool_or(unsafe_member(name)).alias("_unsafe"),
        F.bool_or("is_symlink").alias("_link"),
        F.max("size").alias("_largest"),
        # Only required names are collected, so the set is as small as the requirement.
        F.array_sort(
            F.array_except(
                F.array(*[F.lit(x) for x in required]),
                F.collect_set(F.when(name.isin(*required), name)),
            )
        ).alias("missing_required_parts"),
    )
    error = (
        F.when(F.col("_unreadable").isNotNull(), F.col("_unreadable"))
        .when(F.col("member_count") > max_members, "too_many_members")
        .when(F.col("_unsafe"), "unsafe_name")
        .when(F.col("_link"), "symbolic_link")
        .when(F.col("_largest") > max_member, "member_too_large")
        .when(F.col("uncompressed_bytes") > max_total, "package_too_large")
    )
    return totals.withColumn("error", error).drop("_unsafe", "_link", "_largest", "_unreadable")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, or whose last column is missing or empty, with their count."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    last = F.col(keys[-1])
    empty = last.isNull() | (last.cast("string") == "")
    problem = F.when(empty, "missing").when(F.col("n") > 1, "duplicate")
    return groups.withColumn("problem", problem).filter("problem IS NOT NULL")


def dangling_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose resolved target is no member of their package."""
    inner = edges.filter(F.col("resolved").isNotNull())
    have = members.select("path", F.col("name").alias("resolved")).distinct()
    return inner.join(have, ["path", "resolved"], "left_anti")


def edge_issues(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(path, code, part, slide, message) of packages and parts that cannot be read, relationships
    and content types, in one pass: a key is reported for every occurrence after its first, a
    missing key for each occurrence."""
    relation = F.col("kind") == "relationship"
    override = F.col("kind") == "override"
    have = members.filter(F.col("name").isNotNull()).select(
        "path", F.col("name").alias("resolved"), F.lit(True).alias("_present")
    ).distinct()
    checked = edges.join(have, ["path", "resolved"], "left")
    lost = F.col("resolved").isNotNull() & F.col("_present").isNull()
    no_part = F.col("resolved").isNull()

    def found(test: Column, code: str, message: Column) -> Column:
        item = F.struct(F.lit(code).alias("code"), message.cast("string").alias("message"))
        return F.when(F.coalesce(test, F.lit(False)), item)

    codes = F.array(
        found(relation & (F.col("rel_id") == ""), "relationship_missing_id", F.lit("")),
        found(
            relation & (F.col("rel_id") != "") & (F.col("nth") > 1),
            "duplicate_relationship_id",
            F.col("rel_id"),
        ),
        found(F.col("escapes"), "unsafe_relationship_target", F.col("target")),
        found(relation & lost, "missing_relationship_target", F.col("resolved")),
        found(override & no_part, "content_type_missing_part", F.lit("")),
        found(
            override & ~no_part & (F.col("nth") > 1),
            "duplicate_content_type_override",
            F.col("resolved"),
        ),
        found(override & lost, "missing_content_type_part", F.col("resolved")),
        found(F.col("kind") == "broken", "xml_parse_error", F.col("part")),
        found(F.col("error").isNotNull(), "unreadable_package", F.col("error")),
    )
    issues = checked.select("path", "part", F.explode(F.array_compact(codes)).alias("_issue"))
    return issues.select(
        "path", "_issue.code", "part", F.lit(None).cast("int").alias("slide"), "_issue.message"
    )


def undefined_refs(refs: DataFrame, defs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """References without a definition; swap the arguments for definitions nobody refers to."""
    return missing_names(refs.select(*keys).distinct(), defs, keys)


def undeclared_axes(elements: DataFrame) -> DataFrame:
    """Axis ids a chart uses but does not declare, in charts that declare any axis at all."""
    axes = elements.filter((F.col("tag") == "axId") & (F.col("val") != ""))
    axes = axes.select("path", "part", "parent", "val")
    declared = axes.filter(F.col("parent").isin(*AXIS_TAGS))
    used = axes.filter(~F.col("val").isin(*TOLERATED_AXES))
    charts = declared.select("path", "part").distinct()
    lost = undefined_refs(used, declared, ["path", "part", "val"])
    return lost.join(charts, ["path", "part"], "left_semi")


def _in_document(elements: DataFrame) -> DataFrame:
    """Elements of the word processing namespace in parts below `word/`."""
    return elements.filter(F.col("part").startswith("word/") & (F.col("namespace") == WORD))


def revision_summary(elements: DataFrame) -> DataFrame:
    """Tracked changes per package: counts by kind, total, missing author or date."""
    tag = F.col("tag")
    tracked = tag.isin("ins", "del", "moveFrom", "moveTo")
    changed = tag.isin(*PROPERTY_CHANGES)
    no_author = F.coalesce(F.col("author"), F.lit("")) == ""
    no_date = F.coalesce(F.col("date"), F.lit("")) == ""
    return _in_document(elements).filter(tracked | changed).groupBy("path").agg(
        F.count_if(tag == "ins").alias("insertions"),
        F.count_if(tag == "del").alias("deletions"),
        F.count_if(tag == "moveFrom").alias("moves_from"),
        F.count_if(tag == "moveTo").alias("moves_to"),
        F.count_if(changed).alias("property_changes"),
        F.count("*").alias("total"),
        F.count_if(tracked & no_author).alias("missing_author_count"),
        F.count_if(tracked & no_date).alias("missing_date_count"),
    )


def revision_authors(elements: DataFrame) -> DataFrame:
    """Distinct (path, author) of tracked changes."""
    tracked = F.col("tag").isin("ins", "del", "moveFrom", "moveTo", *PROPERTY_CHANGES)
    return _in_document(elements).filter(tracked & (F.col("author") != "")).select("path", "author").distinct()


def comment_balance(elements: DataFrame) -> DataFrame:
    """Comment ids with uneven range marks, without a reference, or without a definition."""
    marks = ("commentRangeStart", "commentRangeEnd", "commentReference")
    tag = F.col("tag")
    in_body = (F.col("part") == "word/document.xml") & tag.isin(*marks)
    defined = (F.col("part") == "word/comments.xml") & (tag == "comment")
    ids = elements.filter((in_body | defined) & (F.col("id") != "")).groupBy("path", "id").agg(
        F.count_if(tag == "commentRangeStart").alias("starts"),
        F.count_if(tag == "commentRangeEnd").alias("ends"),
        F.count_if(tag == "commentReference").alias("refs"),
        F.count_if(tag == "comment").alias("defs"),
    )
    used = ids.filter("starts + ends + refs > 0")
    codes = F.array_compact(
        F.array(
            F.when(F.col("defs") == 0, F.lit("undefined_comment_reference")),
            F.when(F.col("starts") != F.col("ends"), F.lit("unbalanced_comment_range")),
            F.when(F.col("refs") == 0, F.lit("missing_comment_reference")),
        )
    )
    return used.select("path", "id", F.explode(codes).alias("code"))


def new_issues(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues not already in the baseline, which counts for three codes only; null equals null."""
    keys = ["path", "code", "part", "slide", "message"]
    known = baseline.filter(F.col("code").isin(*BASELINE_CODES))
    return missing_names(current, known, keys)


def issue_rollup(
    issues: DataFrame, packages: DataFrame, n: int = ISSUE_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(the first n issues per package, status and counts of every package)."""
    kept, totals = cap_per_group(issues, ["path"], ["code", "part", "slide", "message"], n)
    status = packages.select("path").distinct().join(totals, "path", "left").select(
        "path",
        F.when(F.col("total").isNull(), "valid").otherwise("invalid").alias("status"),
        F.coalesce("total", F.lit(0)).alias("issue_count"),
        F.coalesce("truncated", F.lit(0)).cast("long").alias("issues_truncated"),
    )
    return kept, status
