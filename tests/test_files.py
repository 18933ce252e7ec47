"""Sources and sinks on real files, and HTML branches."""

import csv
import glob
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from parlance import fixtures as fx
from parlance.functions.html import read_page
from parlance.operators import grids, messages
from parlance.operators import packages as audits
from parlance.operators.web import extract_content, page_digest
from parlance.plans.chat_export import chat_export, exportable_messages
from parlance.sources import delimited, export, packages, tables

SF = "/root/testdata/sf0.001"


def test_read_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffx,\"q\"\"1\nline2\"\r\n\r\n1,2,3\n".encode())
    (tmp_path / "b.tsv").write_text("a\tb,c\n")
    (tmp_path / "c.csv").write_bytes("编号,名称\n".encode("gb18030"))
    rows = delimited.read_delimited(spark, str(tmp_path / "*.[ct]sv")).collect()
    got = {(r.path.rsplit("/", 1)[-1], r.row): r.cells for r in rows if r.error is None}
    assert got == {
        ("a.csv", 1): ["x", 'q"1\nline2'], ("a.csv", 2): [], ("a.csv", 3): ["1", "2", "3"],
        ("b.tsv", 1): ["a", "b,c"],
    }
    assert [r.path[-5:] for r in rows if r.error] == ["c.csv"]
    chinese = delimited.read_delimited(spark, str(tmp_path / "c.csv"), encoding="gb18030").first()
    assert chinese.cells == ["编号", "名称"]
    profile = grids.delimited_profile(delimited.read_delimited(spark, str(tmp_path / "a.csv"))).first()
    assert (profile.row_count, profile.max_column_count) == (3, 3)
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path), encoding="latin-1")


def test_write_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'say "x"\n')], "id int, t string")
    out = str(tmp_path / "out")
    delimited.write_delimited(df.coalesce(1), out, sep="\t", encoding="gb18030")
    text = open(glob.glob(f"{out}/part-*")[0], encoding="gb18030", newline="").read()
    assert list(csv.reader(io.StringIO(text), delimiter="\t")) == [
        ["1", "a,b"], ["2", ""], ["3", 'say "x"\n'],
    ]
    delimited.write_delimited(df.filter("id < 3"), str(tmp_path / "flat"))
    back = delimited.read_rectangular(spark, str(tmp_path / "flat"), ["id", "t"])
    assert {(r.id, r.t or "") for r in back.collect()} == {("1", "a,b"), ("2", "")}


def test_sniff(spark):
    files = [b"", b"\xff\xfea\x00,\x00", b"a\x00b", "é,ü".encode(), "价格".encode("gb18030"),
             b" \n <!DOCTYPE HTML>", b"\xef\xbb\xbf \n", b"\xff\xff\xff", ("a" + "价" * 700_000).encode(), None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(files)], "i int, content binary")
    got = [tuple(r.s) for r in df.select("i", delimited.sniff_delimited(F.col("content")).alias("s")).orderBy("i").collect()]
    assert got == [(None, "empty"), ("utf-16", None), (None, "binary"), ("utf-8-sig", None), ("gb18030", None),
                   (None, "markup"), (None, "blank"), (None, "undecodable"), ("utf-8-sig", None), (None, "empty")]


def test_export_files(spark, tmp_path):
    log, roster = fx.messages(spark, SF), fx.members(spark, SF)
    rows = chat_export(log, roster, "u3", 0, 2_000_000_000)
    manifest = messages.export_manifest(
        exportable_messages(log, roster, "u3", 0, 2_000_000_000), fx.contacts(spark, SF), 0, 2_000_000_000, 0)
    out = str(tmp_path / "export")
    export.write_export(rows, manifest, out)
    counts = {}
    for name in glob.glob(f"{out}/manifest/*.json"):
        for line in open(name):
            record = json.loads(line)
            counts[record["room"]] = record["message_count"]
    assert counts
    for room, count in counts.items():
        numbers = []
        for name in sorted(glob.glob(f"{out}/rooms/room={room}/*.csv")):
            with open(name, newline="") as handle:
                lines = list(csv.reader(handle))
            assert lines[0] == list(export.HEADER.values())
            numbers += [int(line[0]) for line in lines[1:]]
        assert numbers == list(range(1, count + 1))


def test_export_is_whole_or_not_there(spark, tmp_path):
    rows = spark.createDataFrame([("r1", k, "t", "n", "w", f'line "{k}"\nnext, {k}') for k in range(1, 40)] + [("r/2 é", 1, "t", "n", None, "")],
                                 "room string, seq int, sent_at string, sender_name string, sender_wxid string, message string")
    manifest = spark.createDataFrame([("r1", 39), ("r/2 é", 1)], "room string, message_count long")
    out = str(tmp_path / "export")

    @F.udf("string")
    def fails(seq):
        if seq == 30:
            raise RuntimeError("task fails")
        return "x"

    broken = rows.withColumn("message", fails("seq"))
    with pytest.raises(Exception, match="task fails"):
        export.write_export(broken, manifest, out)
    assert os.listdir(tmp_path) == []
    with pytest.raises(export.ExportError):
        export.write_export(rows, manifest.filter("room = 'r1'"), out)
    with pytest.raises(export.ExportError):
        export.write_export(rows.filter("seq <> 7"), manifest, out)
    assert os.listdir(tmp_path) == []
    export.write_export(rows, manifest, out)
    assert {(r["room"], r["message_count"]) for r in export.written_counts(spark, f"{out}/rooms").collect()} == {("r1", 39), ("r/2 é", 1)}
    with pytest.raises(Exception, match="task fails"):
        export.write_export(broken, manifest, out)
    assert os.listdir(tmp_path) == ["export"] and export.written_counts(spark, f"{out}/rooms").count() == 2
    export.write_export(rows.limit(0), manifest.limit(0), out)
    assert os.listdir(tmp_path) == ["export"] and not glob.glob(f"{out}/rooms/room=*")


def test_export_limit(spark):
    log, roster = fx.messages(spark, SF), fx.members(spark, SF)
    every = exportable_messages(log, roster, "u3", 0, 2_000_000_000)
    sizes = {r.room: r["count"] for r in every.groupBy("room").count().collect()}
    cut = chat_export(log, roster, "u3", 0, 2_000_000_000, 3)
    parts = {(r.room, r.part): r["count"] for r in cut.groupBy("room", "part").count().collect()}
    assert parts == {
        (room, k + 1): min(3, n - 3 * k) for room, n in sizes.items() for k in range(-(-n // 3))
    }


def test_table_scans(spark, tmp_path):
    path = str(tmp_path / "messages")
    fx.messages(spark, SF).write.parquet(path)
    assert tables.read_messages(spark, path).columns == list(tables.MESSAGE_COLUMNS)
    assert tables.read_pages(spark, f"{SF}/pages.parquet").columns == ["page_id", "url", "html"]
    assert tables.read_dim(spark, f"{SF}/customer.parquet", "contacts").count() > 0


def make_zip(path, parts):
    with zipfile.ZipFile(path, "w") as archive:
        for name, body in parts:
            archive.writestr(name, body)


def test_packages_on_disk(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    rels = lambda body: f'<Relationships xmlns="{rel}">{body}</Relationships>'
    link = zipfile.ZipInfo("word/link")
    link.external_attr = 0o120777 << 16
    make_zip(tmp_path / "a.docx", [
        ("[Content_Types].xml", "<broken"), ("word/media/", ""), ("word/document.xml", "<a/>"),
        ("word/_rels/document.xml.rels", rels(
            '<Relationship Id="" Target="media/a%20b.png"/><Relationship Id="x" Target="..\\theme.xml"/>'
            '<Relationship Id="x" Target="/word/document.xml#t"/><Relationship Id="y" Target="../../up"/>')),
        ("word/media/a b.png", "x"), (link, "t"),
    ])
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    files = packages.read_files(spark, str(tmp_path), "*.docx")
    members = packages.package_members(files)
    assert members.filter("error = 'bad_package'").count() == 1
    good = members.filter("error IS NULL")
    profile = audits.package_profile(good).first()
    assert (profile.member_count, profile.media_count, profile.error) == (6, 1, "symbolic_link")
    assert profile.missing_required_parts == ["_rels/.rels"]
    edges = packages.package_edges(files).filter("error IS NULL")
    resolved = {(r.rel_id, r.resolved, r.escapes) for r in edges.filter("kind = 'relationship'").collect()}
    assert resolved == {("", "word/media/a b.png", False), ("x", "theme.xml", False),
                        ("x", "word/document.xml#t", False), ("y", None, True)}
    codes = sorted(r.code for r in audits.edge_issues(edges, good).collect())
    assert codes == ["duplicate_relationship_id", "missing_relationship_target", "missing_relationship_target",
                     "relationship_missing_id", "unsafe_relationship_target", "xml_parse_error"]


def test_damaged_packages_are_issues(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    make_zip(tmp_path / "odd.zip", [
        ("word/a.xml", b'<?xml version="1.0" encoding="no-such"?><a/>'), ("customXml/item1.xml", "<a><ins/><del/></a>"),
        ("word/b.xml", f'<w:a xmlns:w="{word}"><w:ins w:author="A"/></w:a>'),
        ("ppt/p.xml", f'<p xmlns:r="{office}"><sldId id="256" r:id="rId2"/></p>'),
        ("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r" Target=".rels.d/x%2.xml"/></Relationships>'),
    ])
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/c.xml", "<a>" + "text " * 500 + "</a>")
    raw = bytearray(stream.getvalue())
    raw[45:60] = b"\xff" * 15
    (tmp_path / "torn.zip").write_bytes(raw)
    files = packages.read_files(spark, str(tmp_path))
    members, edges = packages.package_members(files), packages.package_edges(files)
    issues = {(r.path.rsplit("/", 1)[-1], r.code, r.message) for r in audits.edge_issues(edges, members).collect()}
    assert issues == {
        ("bad.zip", "unreadable_package", "bad_package"), ("odd.zip", "xml_parse_error", "word/a.xml"),
        ("odd.zip", "missing_relationship_target", ".rels.d/x%2.xml"), ("torn.zip", "xml_parse_error", "word/c.xml"),
    }
    profile = {r.path.rsplit("/", 1)[-1]: (r.member_count, r.error) for r in audits.package_profile(members).collect()}
    assert profile == {"bad.zip": (0, "bad_package"), "odd.zip": (5, None), "torn.zip": (1, None)}
    elements = packages.package_elements(files)
    slide = elements.filter("tag = 'sldId'").first()
    assert (slide.id, slide.rel_id) == ("256", "rId2")
    assert [(r.insertions, r.deletions, r.total) for r in audits.revision_summary(elements).collect()] == [(1, 0, 1)]
    assert packages.package_members(packages.read_files(spark, str(tmp_path), "bad.zip", 3)).first().error == "too_large"


def test_unsafe_names(one):
    names = ["a/b", "/a", "../a", "a/../b", "C:/x", "", ".", "a:b/c", "./a"]
    assert one(names, "string", packages.unsafe_member) == [
        False, True, True, True, True, True, True, False, False,
    ]


def test_html_roots_and_blocks():
    long = "word " * 40
    page = read_page(
        f"<html lang='de'><head><title> A  b </title><meta property='og:description' content=' og '>"
        f"<script>x</script></head><body><nav>menu</nav><div class='post x'><h2>Head</h2><p>{long}<br>tail"
        f"<p>second</div><main>tiny</main><noscript>no</noscript><a href='../q?a=b#c'>link  text</a>"
        f"<a href='mailto:x@y'>mail</a><a href='/ü'></a></body></html>", "https://h.example/d/e")
    assert page["title"] == "A b" and page["lang"] == "de" and page["description"] == "og"
    assert page["text"] == "Head\n\n" + long.strip() + "\ntail\n\nsecond"
    assert page["headings"] == ["Head"]
    assert page["links"] == [("link text", "https://h.example/q?a=b#c")]


@pytest.mark.parametrize("mark", [
    "<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", "<div id='content'>{}</div>",
    "<div class='a content'>{}</div>", "<div class='article'>{}</div>", "<div class='entry-content'>{}</div>",
])
def test_html_root_selectors(mark):
    assert read_page("<body>aaa " + mark.format("inside text") + "</body>", "")["text"] == "inside text"


def test_html_short_root_and_plain_text():
    html = "<body>" + "x" * 100 + "<article>" + "y" * 30 + "</article></body>"
    assert read_page(html, "")["text"].startswith("xxx")
    assert read_page("just text", "")["text"] == "just text"
    assert read_page("", "")["text"] == ""


def test_extract_content_caps(spark):
    links = "".join(f"<a href='https://h/{i % 25}'>t{i % 25}</a>" for i in range(45))
    heads = "".join(f"<h1>h{i % 24}</h1>" for i in range(35))
    pages = spark.createDataFrame([(1, "https://h/", f"<body>{heads}{links}</body>"), (2, None, None)],
                                  "page_id long, url string, html string")
    out = {r.page_id: r for r in extract_content(pages, 10).collect()}
    assert [h for h in out[1].headings] == [f"h{i}" for i in range(20)]
    assert [x.text for x in out[1].links] == [f"t{i}" for i in range(20)]
    assert out[1].text.endswith("\n\n[内容过长，已截断到 10 字]")
    digest = {r.page_id: r.digest for r in page_digest(extract_content(pages)).collect()}
    assert digest[2] == "标题：(无标题)\n\nURL：\n\n正文：\n(未抽取到可见正文)"
