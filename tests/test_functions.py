"""Branches and boundaries of the Column functions on hand-built values."""

import math
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from parlance.functions import boxes, cells, clock, numbers, pages, text, urls

MIDNIGHT = 1785254400  # 2026-07-29 00:00 in Shanghai


def test_safe_cell(one):
    long = "=" + "x" * 32767
    got = one(
        [None, "@成员", '=HYPERLINK("https://example.test")\0', "a" * 32766, "a" * 32767,
         "a" * 32768, long, "\x01=1", "tab\tok\n"],
        "string", text.safe_cell,
    )
    assert got[0] == ""
    assert got[1] == "'@成员"
    assert got[2] == '\'=HYPERLINK("https://example.test")'
    assert got[3] == "a" * 32766 and got[4] == "a" * 32767
    assert len(got[5]) == 32767 and got[5].endswith(text.TRUNCATED_SUFFIX)
    assert len(got[6]) == 32767 and got[6].startswith("'=") and got[6].endswith(text.TRUNCATED_SUFFIX)
    assert got[7] == "'=1"
    assert got[8] == "tab\tok\n"


def test_safe_name(one):
    got = one([' a/b:c*?"<>|d ', "._. ", "x" * 50, "a \t b", ""], "string", text.safe_name)
    assert got == ["a_b_c______d", "群聊", "x" * 40, "a___b", "群聊"]


def test_clean_lines(one):
    got = one([" a \t b\r\n\r\n c\rd \0", None, "\x1f\x85"], "string", text.clean_lines)
    assert got == ["a b\nc\nd", "", ""]


def test_clean_web(one):
    raw = "\n\n first\u00a0 line \n\n \n\nsecond\n"
    assert one([raw, "", None], "string", text.clean_web) == ["first line\n\nsecond", "", ""]


def test_match_key(one):
    assert one(["Ｆｕｌｌ ｗｉｄｔｈ!", "Straße-ﬁ", "_ ", None], "string", text.match_key) == [
        "fullwidth", "strassefi", "", None,
    ]


def test_expand_list(one):
    got = one(
        ['["a", " b ", ""]', " plain ", "", None, "[1]", "[", '{"a":1}', "[]"],
        "string", text.expand_list,
    )
    assert got == [["a", "b"], ["plain"], [], [], None, None, ['{"a":1}'], []]
    named = lambda c: text.expand_list(c, bracketed_names=True)
    assert one(["[开心]", '["[开心]", "x"]', "[1]", "[a"], "string", named) == [
        ["[开心]"], ["[开心]", "x"], None, ["[a"],
    ]


def test_emoji(one):
    got = one([" [生气] ", "生气", None], "string", text.emoji)
    assert got[0] is None and got[1] is None and got[2] is None
    assert one(["[生气]"], "string", text.emoji)[0].total_length == 59990


def test_bools_and_ints(one):
    assert one([" YES", "off", "2", None, "TRUE"], "string", lambda c: text.coerce_bool(c, True)) == [
        True, False, True, True, True,
    ]
    assert one([0.0, 2.5, None], "double", text.coerce_bool_number) == [False, True, False]
    assert one(
        ["5", " 1_000 ", "4.7", None, "-" + "9" * 60, "9" * 60, "+3"],
        "string", lambda c: text.clamp_int(c, 50, 1, 100),
    ) == [5, 100, 50, 50, 1, 100, 3]


def test_settings(one):
    got = one(['{"a": {"b": 1}, "c": 2}', "[1]", "", None, "{", "{}"], "string", text.decode_settings)
    assert got == [{"a": '{"b":1}', "c": "2"}, {}, {}, {}, {}, {}]
    assert one(['{"a":1}', "{", " ", None], "string", text.malformed_json) == [
        False, True, False, False,
    ]


def test_emotion_and_size(one):
    assert one(["happy ", "vocal - fry", "HAPPY", None], "string", text.emotion) == [
        "happy", "vocal-fry", "", "",
    ]
    size = lambda c: text.drawing_size(c, F.lit(" 4 K"))
    assert one(["16 : 9", "5:4", None], "string", size) == ["3840x2160", "auto", "auto"]
    assert one([" 7x7 ", " "], "string", lambda c: text.drawing_size(F.lit("1:1"), F.lit("1k"), c)) == [
        "7x7", "1024x1024",
    ]


def test_literal_pattern(one):
    whole = text.literal_pattern("a.b", whole_word=True)
    assert one(["a.b", "xa.b", "a.bé", "(a.b)", "axb"], "string", lambda c: c.rlike(whole)) == [
        True, False, False, True, False,
    ]
    folded = text.literal_pattern("É$", match_case=False)
    assert one(["é$", "e$"], "string", lambda c: c.rlike(folded)) == [True, False]


def test_placeholder(one):
    assert one(
        ["Lorem", "todos", "xxxx", "xx", "[Insert", "this slide has a layout", None],
        "string", text.has_placeholder,
    ) == [True, False, True, False, True, True, False]


def test_local_time(one, spark):
    # Summer time was kept in Shanghai until 1991.
    values = [0, None, MIDNIGHT, 577811400, 1710052200, 662688000, -1]
    zone = ZoneInfo(clock.ZONE)
    want = [datetime.fromtimestamp(v or 0, zone).strftime("%Y-%m-%d %H:%M:%S") for v in values]
    for session_zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        assert one(values, "long", clock.local_time) == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_local(one, spark):
    values = ["2026-07-29 00:00", " 2026-7-29T0:00:00 ", "2026-07-29", "2026-02-30 10:00",
              "2026-07-29 10:00:60", None, "2026-07-29   00:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    got = one(values, "string", clock.local_epoch)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [MIDNIGHT, MIDNIGHT, None, None, None, None, MIDNIGHT]


def test_resolve_range():
    day = 86400
    assert clock.resolve_range(day="2026-07-28") == (MIDNIGHT - day, MIDNIGHT)
    now = datetime.fromisoformat("2026-07-29T15:30:00+08:00")
    assert clock.resolve_range(now=now) == (MIDNIGHT, MIDNIGHT + 15 * 3600 + 1800)
    assert clock.resolve_range(start="2026-07-29 00:00", end="2026-07-29T01:00:00") == (
        MIDNIGHT, MIDNIGHT + 3600,
    )
    for bad in (
        dict(day="2026-07-28", start="2026-07-28 00:00", end="2026-07-28 01:00"),
        dict(start="2026-07-28 00:00"),
        dict(start="2026-07-28 02:00", end="2026-07-28 02:00"),
        dict(day="28.07.2026"),
    ):
        with pytest.raises(ValueError):
            clock.resolve_range(**bad)


def python_value(value):
    """Plain-Python reading of a delimited cell, for comparison."""
    short = value.strip()
    if short == "":
        return "blank", ""
    if short.lower() in ("true", "false"):
        return "bool", short.lower() == "true"
    zero = "." not in short and (
        (short[:1] == "0" and len(short) > 1) or (short[:2] == "-0" and len(short) > 2)
    )
    if not zero:
        try:
            number = int(short)
            return ("int", number) if abs(number) < 2**63 else ("bigint", short)
        except ValueError:
            pass
    try:
        return "float", float(short)
    except ValueError:
        return "text", value


def test_coerce_cell_like_python(one):
    values = ["", "  ", "007", "0", "-0", "-01", "+007", "1_000", "1__0", "1.5", "1.", ".5", ".", "1e3",
              "1e", "1d", "1f", "nan", "-inf", "Infinity", "TRUE", "False ", " 12 ", "12 3", "0x10",
              "9223372036854775807", "9223372036854775808", "99999999999999999999", "0.0", "00.5",
              "1_0.5_0e1_0", "\u00a05\u00a0", "text ", "--1", "+-1", "1,5", "0e0", "-0.0"]
    for value, got in zip(values, one(values, "string", cells.coerce_cell)):
        kind, want = python_value(value)
        assert got["kind"] == kind, value
        shown = {"blank": got["s"], "bool": got["b"], "int": got["i"], "float": got["d"]}.get(
            kind, got["s"]
        )
        if kind == "float" and math.isnan(want):
            assert math.isnan(shown)
        else:
            assert shown == want, value


def test_references(one):
    assert one(["a1", " XFD1048576 ", "AA10", "A0", "ABCD1", "A12345678"], "string", cells.parse_a1) == [
        (1, 1), (1048576, 16384), (10, 27), None, None, None,
    ]
    assert one(["$B$2", "a1:$c3", "A1:B", "C3:A1"], "string", cells.parse_range) == [
        (2, 2, 2, 2), (1, 1, 3, 3), None, (3, 3, 1, 1),
    ]
    numbers_ = [1, 26, 27, 52, 53, 702, 703, 16384]
    assert one(numbers_, "int", cells.column_letters) == [
        "A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD",
    ]


def test_formula_errors(one):
    assert one([f" {e.lower()} " for e in cells.FORMULA_ERRORS], "string", cells.formula_error) == list(
        cells.FORMULA_ERRORS
    )
    assert one(["#OOPS!", None], "string", cells.formula_error) == [None, None]
    assert one(["=xlookup (1)", "=MYFILTER(1)", "XLOOKUP(1)", "=A1+SORT(B:B)"], "string",
               cells.is_risky_formula) == [True, False, False, True]


def test_page_quality_boundaries(spark):
    word = "a" * 19
    rows = [
        ("", 0.0, "empty", 0), ("", 0.3, "empty", 0), (word, 0.0, "sparse", 38),
        (word + "b", 0.0, "good", 100), ("a" * 99, 0.5, "sparse", 50), ("a" * 100, 0.5, "good", 100),
        ("a" * 99, 0.49, "good", 100),
        ("a" * 1000 + "(cid:1)" * 2, 0.0, "good", 84), ("a" * 1000 + "(CID:1)" * 3, 0.0, "poor", 76),
        ("a" * 93 + "(cid:1)", 0.0, "poor", 92), ("a" * 94 + "(cid:1)", 0.0, "good", 92),
        ("a" * 1000 + "\ufffd" * 2, 0.0, "good", 84), ("a" * 99 + "\ufffd", 0.0, "poor", 92),
        ("a" * 597 + "\u2e80" * 3, 0.0, "poor", 94), ("a" * 598 + "\u2e80" * 3, 0.0, "good", 94),
        ("a" * 1000 + "\x01\x02\x03", 0.0, "poor", 88), ("\n 3 / 12 \n" + "a" * 19, 0.0, "sparse", 38),
        ("3 of 12 x" + "a" * 19, 0.0, "good", 100), ("a" * 50 + "\t\f\n", 0.0, "good", 100),
        ("\ufffd" * 20, 0.0, "poor", 0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, t string, c double, status string, score int")
    out = df.withColumn("q", pages.page_quality(F.col("t"), F.col("c"))).orderBy("i").collect()
    for r in out:
        assert (r.q.status, r.q.score) == (r.status, r.score), r.i
    assert out[1].q.reasons == ["未提取到可见文字", "页面包含图像对象"]
    assert out[4].q.reasons[0].startswith("页面图像覆盖约 50%")
    assert len(out[0].q.reasons) == 1 and out[3].q.reasons == []


def test_parse_pages(one):
    got = one([" 2, 5-6,2", "", "x,99", "9,x", "3-2", ",", "0", "1-10", "1-11", "-3", "1-2-3"], "string",
              lambda c: pages.parse_pages(c, F.lit(10)))
    assert got == [
        ([2, 5, 6], None), (list(range(1, 11)), None), (None, "format"), (None, "format"),
        (None, "order"), (None, "empty"), (None, "bounds"), (list(range(1, 11)), None),
        (None, "bounds"), (None, "format"), (None, "format"),
    ]


def test_weekdays(one):
    got = one(['[7, "1", 1.9]', "3,1,3", "8", "[true]", "", "[x", "a", "[[1]]"], "string", pages.parse_weekdays)
    assert got == [([1, 7], None), ([1, 3], None), (None, "bounds"), (None, "type"), (None, "empty"),
                   (None, "format"), (None, "type"), (None, "type")]


def test_page_window(spark):
    df = spark.createDataFrame(
        [(10, 1, None, 8), (10, 9, None, 8), (10, 2, 4, 3), (10, 2, 4, 2), (0, 1, None, 1), (10, 11, None, 1),
         (10, 3, 2, 1), (10, 1, None, 0)], "n int, s int, e int, m int")
    got = [tuple(r.w) for r in df.select(
        pages.page_window(F.col("n"), F.col("s"), F.col("e"), F.col("m")).alias("w")).collect()]
    assert got == [(1, 8, 9, None), (9, 10, None, None), (2, 4, None, None), (2, 3, 4, None),
                   (None, None, None, "no_pages"), (None, None, None, "start"), (None, None, None, "end"),
                   (None, None, None, "max_pages")]


def test_urls(one):
    values = ["https://a.example/x", "HTTP://A", "ftp://a", "https://", None, "https://u@h/", "https://h:99999/",
              "https://h:/", " https://h/a b", "https://[::1]:8443/", "https://h?x=@y", "https://h:-1/"]
    assert one(values, "string", urls.is_web_url) == [
        True, True, False, False, False, True, True, True, True, True, True, True,
    ]
    assert one(values, "string", urls.attachment_url_error) == [
        None, "scheme", "scheme", "scheme", "blank", "userinfo", "port", None, "space", None, None, "port",
    ]
    family = lambda c: urls.is_host_family(c, "weixin.qq.com")
    assert one(["https://WEIXIN.qq.com/", "http://mp.weixin.qq.com:80/", "https://xweixin.qq.com", None],
               "string", family) == [True, True, False, False]


def test_size_gate(spark):
    limit = urls.SIZE_LIMIT
    rows = [(limit, None, limit, None), (limit + 1, None, 1, "response_too_large"),
            (None, limit + 1, 1, "probe_too_large"), (None, None, limit + 1, "received_too_large"),
            (5, None, 0, "empty"), (-1, 7, 7, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r long, p long, a long, want string")
    out = df.withColumn("g", urls.size_gate(F.col("r"), F.col("p"), F.col("a"))).orderBy("i").collect()
    assert [r.g.error for r in out] == [r[3] for r in rows]
    assert [(r.g.declared, r.g.source) for r in (out[0], out[3], out[5])] == [
        (limit, "get-content-length"), (None, "stream"), (7, "head-content-length"),
    ]


def test_media_type_and_name(one, spark):
    assert one(["video/MP4; charset=binary", ";", None], "string", urls.media_type) == ["video/mp4", None, None]
    df = spark.createDataFrame(
        [('attachment; filename="a b.MP4"', None, "image"), ("", "image/png", "image"), (None, None, "voice"),
         ("attachment; filename*=UTF-8''%E4%BD%A0.jpg", None, "video"), (None, "x/none", "image")],
        "d string, c string, m string")
    got = [tuple(r.n) for r in df.select(urls.attachment_name(
        F.col("d"), F.col("c"), F.col("m"), F.lit(9)).alias("n")).collect()]
    octet = "application/octet-stream"
    assert got == [("a b.MP4", octet, ".mp4"), ("9.png", "image/png", ".png"), ("9.bin", octet, ".bin"),
                   ("你.jpg", octet, ".jpg"), ("9.jpg", "x/none", ".jpg")]


def test_round_half_even_like_python(one):
    values = [0.09145, 0.05535, 2.675, 1.005, 0.5, 1.5, -2.5, -0.12345, 1 / 3, 12345.67895, 0.00005, 0.00015]
    for digits in (0, 2, 4):
        got = one(values, "double", lambda c: numbers.round_half_even(c, digits))
        assert got == [float(round(v, digits)) for v in values]


def test_boxes(spark):
    df = spark.createDataFrame(
        [(-5.0, 0.0, 50.0, 20.0), (120.0, 0.0, 130.0, 20.0), (10.0, 5.0, 10.0, 9.0), (None, 0.0, 1.0, 1.0)],
        "x0 double, top double, x1 double, bottom double")
    box = boxes.norm_box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"), F.lit(100.0), F.lit(40.0))
    got = [r.b for r in df.select(box.alias("b")).collect()]
    assert got == [(0.0, 0.0, 0.5, 0.5), None, None, None]
    df = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0], [10.0, 4.0], [0.0, 4.0]],), (None,)],
                               "p array<array<double>>")
    got = [r.c for r in df.select(boxes.centre(F.col("p"), F.lit(100), F.lit(40)).alias("c")).collect()]
    assert got == [(0.05, 0.05), None]
