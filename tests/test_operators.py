"""Operators against brute-force twins on small generated inputs, hot keys included."""

import collections
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import grids, matching, members, messages, ocr, ordered, pages, settings, textedit


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- ordered -------------------------------------------------------------------------------


def test_running_total_hot_and_null_keys(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice(["a", None]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, v long")
    got = ordered.running_total(df, ["k"], ["i"], F.expr("i DIV 64"), F.col("v"), out="t")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "i") == rows(df.withColumn("t", F.sum("v").over(w)), "i")
    numbered = ordered.running_total(df, ["k"], ["i"], F.expr("i DIV 64"))
    assert rows(numbered.filter("k = 'hot'").select("seq"), "seq") == [(i,) for i in range(1, 2001)]


def test_exact_percentile(spark):
    rng = random.Random(2)
    data = [("a", rng.choice([1.0, 2.5, rng.random() * 100])) for _ in range(501)]
    data += [("b", float(v)) for v in (-1e300, -2, 3, 1e9)] + [("c", 7.0), ("c", 7.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r.percentile for r in ordered.exact_percentile(df, ["k"], "v", share).collect()}
        for key in "abc":
            values = sorted(v for k, v in data if k == key)
            at = (len(values) - 1) * share
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert got[key] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))
        assert "d" not in got


def test_cap_and_missing(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 2)], "k string, i int")
    kept, totals = ordered.cap_per_group(df, ["k"], ["i"], 3)
    assert rows(kept.filter("k = 'a'").select("i"), "i") == [(0,), (1,), (2,)]
    assert {r.k: r.truncated for r in totals.collect()} == {"a": 2, "b": 0, None: 0}
    have = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(ordered.missing_names(df, have, ["k"])) == [("b", 1)]


# --- matching ------------------------------------------------------------------------------


def test_containing_is_literal(spark):
    hay = [(1, "r", "50% off"), (2, "r", "a_b"), (3, "r", "axb"), (4, "s", "a_b"), (5, "r", None)]
    needles = [("r", "%"), ("r", "a_b"), ("r", "a"), ("s", "b"), ("r", "longer than any text")]
    for whole in (None, 2):
        got = matching.containing(
            spark.createDataFrame(needles, "room string, kw string"),
            spark.createDataFrame(hay, "id int, room string, name string"),
            ["room"], "kw", ["name"], whole,
        )
        want = sorted(
            (kw, i) for room, kw in needles for i, r, name in hay if r == room and name and kw in name
        )
        assert sorted((r.kw, r.id) for r in got.collect()) == want


def test_in_any_box_like_brute_force(spark):
    rng = random.Random(3)
    boxes, points = [], []
    for _ in range(120):
        x, y = rng.random(), rng.random()
        w, h = rng.choice([(1.0, 1.0), (0.02, 0.02), (0.3, 0.1)])
        boxes.append((rng.randint(0, 4), x, y, min(1.0, x + w), min(1.0, y + h)))
    boxes += [(5, 0.0, 0.0, 1.0, 1.0), (6, 0.25, 0.25, 0.5, 0.5)]
    for i in range(900):
        points.append((rng.randint(0, 7), i, rng.uniform(-0.03, 1.03), rng.uniform(-0.03, 1.03)))
    points += [(6, 901, 0.245, 0.25), (6, 902, 0.2449, 0.25), (6, 903, 0.505, 0.505), (5, 904, None, None)]
    lines = spark.createDataFrame(points, "page int, i int, cx double, cy double")
    frame = spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double")
    pad = 0.005
    want = {
        i for page, i, x, y in points if x is not None
        and any(p == page and x0 - pad <= x <= x1 + pad and y0 - pad <= y <= y1 + pad
                for p, x0, y0, x1, y1 in boxes)
    }
    inside = [r.i for r in matching.in_any_box(lines, frame, ["page"], pad).collect()]
    outside = [r.i for r in matching.in_any_box(lines, frame, ["page"], pad, inside=False).collect()]
    assert sorted(inside) == sorted(want)
    assert sorted(outside) == sorted(i for _, i, _, _ in points if i not in want)


# --- chat ----------------------------------------------------------------------------------


def test_app_messages(spark):
    data = [
        (1, "plain", "plain"),
        (49, "<msg><appmsg><title>T &amp; t</title><type>57</type></appmsg></msg>", "T & t"),
        (49, "<msg><appmsg><title> a </title><des/><type>5</type></appmsg></msg>",
         "网页分享消息，标题:  a ，描述："),
        (49, "<msg><appmsg><title>x</title><title>y</title><type>6</type></appmsg></msg>",
         "文件消息，文件名: x y"),
        (49, "<msg><appmsg><title><![CDATA[<b>]]></title><type>57</type></appmsg></msg>", "<b>"),
        (49, "<msg><appmsg><des>d</des><type>33</type></appmsg></msg>", "d"),
        (49, "<msg><appmsg><title>x", None),
        (49, None, None),
        (49, "<msg></msg>", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, type int, content string, want string")
    app = messages.app_fields(F.col("type"), F.col("content"))
    out = df.withColumn("app", app).withColumn(
        "got", messages.render_message(F.col("type"), F.col("content"), F.col("app"))
    )
    out = out.withColumn("ok", messages.is_exportable(F.col("type"), F.col("app.type"))).orderBy("i").collect()
    for r in out:
        assert r.got == r.want, r
    assert [bool(r.ok) for r in out] == [True, True, True, True, True, False, False, False, False]


def test_windows_and_media(spark):
    df = spark.createDataFrame([(1, 1000), (2, 400), (3, 399), (4, 1001)], "id int, created_at long")
    assert rows(messages.recent_window(df, 1000).select("id"), "id") == [(1,), (2,)]
    assert messages.media_codes(["voice", "ALL"]) == [34, 3, 43]
    for bad in ([], ["gif"]):
        with pytest.raises(ValueError):
            messages.media_codes(bad)


ROSTER = [
    (1, "r", "w1", "Ann", "x", None), (2, "r", "w2", None, "ann", 0), (3, "r", "w3", "Annabel", "b", 0),
    (4, "r", "w4", "Bob", "Bobby", 1), (5, "r", "w5", " Bob ", "n%_", 0), (6, "s", "w6", "Ann", "", 0),
    (7, "r", "w7", "", "Zoe", 0), (8, "r", "w8", "", "Zoe", 0), (9, "r", "w7", "", "Zoe", 0),
]
ROSTER_SCHEMA = "id long, chat_room_id string, wechat_id string, remark string, nickname string, is_leaved int"


def test_members(spark):
    roster = spark.createDataFrame(ROSTER, ROSTER_SCHEMA)
    names = ["ANN", "annab", "bob", "%_", "nobody", "zoe", "n"]
    asked = spark.createDataFrame([("r", m) for m in names], "room string, mention string")
    first = {r.mention: r.wechat_id for r in members.resolve_members(asked, roster).collect()}
    assert first == {"ANN": "w1", "annab": "w3", "bob": "w5", "%_": "w5", "nobody": None, "zoe": "w7", "n": "w1"}
    unique = {
        r.mention: (r.wechat_id, r.display_name, r.error, r.labels)
        for r in members.resolve_members_unique(asked, roster).collect()
    }
    assert unique["ANN"] == ("w1", "Ann", None, None)
    assert unique["%_"] == ("w5", "Bob", None, None)
    assert unique["nobody"] == (None, None, "not_found", None)
    assert unique["zoe"] == (None, None, "ambiguous", "Zoe、Zoe")
    assert unique["n"][2:] == ("ambiguous", "Ann（昵称：x）、Annabel（昵称：b）")


def test_member_pool_is_the_lowest_ids(spark):
    crowd = [(i, "r", f"w{i}", f"Sam {i}", "", 0) for i in range(1, 60)] + [(60, "r", "w60", "Sam", "", 0)]
    asked = spark.createDataFrame([("r", "sam")], "room string, mention string")
    roster = spark.createDataFrame(crowd, ROSTER_SCHEMA)
    assert members.resolve_members(asked, roster).first().wechat_id == "w1"
    assert members.resolve_members_unique(asked, roster).first().wechat_id == "w60"


def test_mentions(spark):
    requests = spark.createDataFrame(
        [(1, "r", '["Ann", "ANN", "nobody"]', False), (2, "r", "", True), (3, "r", "Ann", True),
         (4, "r", "[3]", False), (5, "r", None, False)],
        "request_id int, room string, mentions string, mention_all boolean")
    out = members.mentions(requests, spark.createDataFrame(ROSTER, ROSTER_SCHEMA))
    assert rows(out, "request_id") == [
        (1, ["w1"], ["nobody"], None), (2, ["notify@all"], [], None), (3, [], [], "all_with_names"),
        (4, [], [], "bad_list"), (5, [], [], None),
    ]


def test_settings_layers(spark):
    convs = spark.createDataFrame([("a@chatroom",), ("b@chatroom",), ("f",), ("g",)], "wx_id string")
    whole = "image_ai_enabled int, image_ai_settings string"
    globals_ = spark.createDataFrame([(1, '{"image_recognition_model": "m0"}')], whole)
    rooms = spark.createDataFrame([("a@chatroom", 0, "{}"), ("b@chatroom", None, " ")], f"chat_room_id string, {whole}")
    friends = spark.createDataFrame([("f", None, '{"imageRecognitionModel": " m1 "}')], f"wechat_id string, {whole}")
    drawing = rows(settings.overlay_drawing(convs, globals_, rooms, friends), "wx_id")
    base = '{"image_recognition_model": "m0"}'
    assert drawing == [
        ("a@chatroom", False, "{}", None), ("b@chatroom", True, base, None),
        ("f", True, '{"imageRecognitionModel": " m1 "}', None), ("g", True, base, None),
    ]
    # The model column is missing everywhere, so models come from the settings.
    models = rows(settings.overlay_understanding(convs, globals_, rooms, friends).select("wx_id", "model"), "wx_id")
    assert models == [("a@chatroom", "m0"), ("b@chatroom", "m0"), ("f", "m1"), ("g", "m0")]
    empty = globals_.limit(0)
    assert rows(settings.overlay_drawing(convs, empty, rooms, friends).select("enabled", "settings"))[-1] == (False, "{}")


def test_versioned_url(one):
    values = ["https://a/", "https://a/v12//", "https://a/v1x", ""]
    assert one(values, "string", settings.versioned_url) == [
        "https://a/v1", "https://a/v12", "https://a/v1x/v1", "",
    ]


# --- pages ---------------------------------------------------------------------------------


def test_best_pages_ties_and_whole_documents(spark):
    data = [
        (1, 1, "p", 0, "good", 100, 10), (1, 1, "q", 1, "good", 100, 10),
        (1, 2, "p", 0, "poor", 90, 10), (1, 2, "q", 1, "sparse", 10, 5),
        (2, 1, "p", 0, "good", 100, 99), (2, 2, "p", 0, "empty", 0, 0),
        (2, 1, "q", 1, "good", 92, 10), (2, 2, "q", 1, "good", 92, 10),
    ]
    df = spark.createDataFrame(data, "doc_id int, page int, engine string, engine_order int, status string, score int, visible_chars int")
    chosen = pages.best_pages(df)
    assert rows(chosen.select("doc_id", "page", "engine"), "doc_id", "page") == [
        (1, 1, "p"), (1, 2, "q"), (2, 1, "q"), (2, 2, "q"),
    ]
    assert rows(pages.engine_label(chosen), "doc_id") == [(1, "hybrid"), (2, "q")]


def test_page_by_chars_worked_cases(spark):
    sizes = {1: [700, 900, 20], 2: [900, 700, 20], 3: [2400], 4: [1000, 3000], 5: [0, 10, 0], 6: [300, 200, 600]}
    bad = {(2, 1), (5, 2)}
    data = [(d, k + 1, "e", "poor" if (d, k + 1) in bad else "good", "x" * n) for d, ns in sizes.items() for k, n in enumerate(ns)]
    df = spark.createDataFrame(data, "doc_id int, page int, engine string, status string, text string")
    got = {}
    for r in pages.page_by_chars(df, 1000, 6).orderBy("page").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.offset_start, r.offset_end, r.complete, r.next_page, r.next_offset))
    assert got == {
        1: [(1, 0, 700, True, 2, 0)],  # 300 left, under 500 and under the rest of page 2: skipped
        2: [(1, 0, 0, True, None, 0), (2, 0, 700, True, None, 0), (3, 0, 20, True, None, 0)],  # the poor page costs nothing
        3: [(1, 0, 1000, False, 1, 1000)],
        4: [(1, 0, 1000, True, 2, 0)],  # nothing left
        5: [(1, 0, 0, True, None, 0), (2, 0, 0, True, None, 0), (3, 0, 0, True, None, 0)],
        6: [(1, 0, 300, True, 3, 500), (2, 0, 200, True, 3, 500), (3, 0, 500, False, 3, 500)],  # just 500 left: cut
    }
    starts = spark.createDataFrame([(3, 1, 1900), (4, 2, 500), (1, 3, 20)], "doc_id int, start_page int, start_offset int")
    rest = pages.page_by_chars(df, 1000, 6, starts).filter("doc_id IN (1, 3, 4)")
    assert rows(rest.select("doc_id", "page", "offset_start", "offset_end", "next_page", "next_offset"), "doc_id") == [
        (1, 3, 20, 20, None, 0), (3, 1, 1900, 2400, None, 0), (4, 2, 500, 1500, 2, 1500),
    ]


def test_page_cursor_errors(spark):
    df = spark.createDataFrame([(1, 1, "e", "good", "abc"), (2, 1, "e", "poor", "abc")],
                               "doc_id int, page int, engine string, status string, text string")
    starts = spark.createDataFrame([(1, 1, 4), (2, 1, 1)], "doc_id int, start_page int, start_offset int")
    got = rows(pages.page_by_chars(df, 100, 8, starts).select("doc_id", "error"), "doc_id")
    assert got == [(1, "offset_past_end"), (2, "offset_on_unusable_page")]


def test_reorder_and_drop(spark):
    df = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in (1, 2, 3)], "doc_id int, page int")
    orders = spark.createDataFrame([(1, [3, 1, 2]), (2, [1, 2]), (3, [1, 2, 2])], "doc_id int, `order` array<int>")
    moved, bad = pages.reorder(df, orders)
    assert rows(moved.select("page", "position"), "position") == [(3, 1), (1, 2), (2, 3)]
    assert rows(bad.select("doc_id"), "doc_id") == [(2,), (3,)]
    drops = spark.createDataFrame([(1, [2, 2]), (2, [1, 2, 3]), (3, [4])], "doc_id int, positions array<int>")
    kept, rejected = pages.drop_positions(df, drops)
    assert rows(kept.filter("doc_id = 1").select("page", "position"), "page") == [(1, 1), (3, 2)]
    assert kept.count() == 8
    assert rows(rejected.select("doc_id", "error"), "doc_id") == [(2, "all"), (3, "bounds")]


# --- OCR -----------------------------------------------------------------------------------


def test_line_reasons_on_worked_pages(spark):
    base = "".join(chr(0x4E00 + i) for i in range(50))
    like = lambda n: base[:n] + "".join(chr(0x5E00 + i) for i in range(50 - n))  # shares n of 50 characters
    far, here = (0.9, 0.9, 0.95, 0.95), (0.4, 0.4, 0.6, 0.6)
    # Lines around (0.5, 0.5); native (key, box); images; the reason of each line.
    pages_ = [
        ([base], [(base, far)], [], ["native"]),
        ([base], [(like(41), far)], [], ["native"]),
        ([base], [(like(40), far)], [], ["kept"]),
        ([base], [(like(34), here)], [], ["native"]),
        ([base], [(like(33), here)], [], ["kept"]),
        ([base], [(like(34), (0.509, 0.4, 0.6, 0.6))], [], ["native"]),
        ([base], [(like(34), (0.512, 0.4, 0.6, 0.6))], [], ["kept"]),
        (["Alpha, beta"], [("alphabetagammadelta", far)], [], ["native"]),
        (["ab"], [("abc", here)], [], ["kept"]),
        (["ab"], [("ab", far)], [], ["native"]),
        (["some line"], [], [(0.0, 0.0, 0.496, 0.6)], ["kept"]),
        (["some line"], [], [(0.0, 0.0, 0.494, 0.6)], ["outside"]),
        (["some line", "Some  LINE!", "!!", "!!"], [], [here], ["kept", "duplicate", "kept", "kept"]),
    ]
    box = [[450.0, 490.0], [550.0, 490.0], [550.0, 510.0], [450.0, 510.0]]
    line_rows, native_rows, image_rows, want = [], [], [], {}
    for page, (texts, native, images, reasons) in enumerate(pages_):
        line_rows += [(1, page, i, t, 0.9, box, 1000, 1000) for i, t in enumerate(texts)]
        native_rows += [(1, page, k, *b) for k, b in native]
        image_rows += [(1, page, *b) for b in images]
        want |= {(page, i): r for i, r in enumerate(reasons)}
    judged = ocr.line_reasons(
        spark.createDataFrame(line_rows, "doc_id int, page int, idx int, text string, confidence double, "
                              "box array<array<double>>, page_width int, page_height int"),
        spark.createDataFrame(native_rows, "doc_id int, page int, key string, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(image_rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"),
    )
    assert {(r.page, r.idx): r.reason for r in judged.collect()} == want
    counts = ocr.ocr_filter_counts(judged).agg(F.sum("raw_ocr_line_count"), F.sum("image_line_count")).first()
    assert tuple(counts) == (len(want), sum(r == "kept" for r in want.values()))


def test_similar_pairs_miss_nothing(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdef", k=rng.randint(3, 40))) for _ in range(40)]

    def mutate(s):
        out = []
        for c in s:
            r = rng.random()
            out.append("" if r < 0.08 else rng.choice("abcdef") + c if r < 0.16 else c)
        return "".join(out)

    left = sorted({mutate(s) for s in base if rng.random() < 0.9} | set(base))
    right = sorted({mutate(s) for s in base})
    frame = lambda xs: spark.createDataFrame([(1, 1, x) for x in xs], "doc_id int, page int, key string")
    found = {(r.key, r.other) for r in ocr._similar_pairs(frame(left), frame(right), 0.82).collect()}
    for a in left:
        for b in right:
            if min(len(a), len(b)) >= 3 and SequenceMatcher(None, a, b).ratio() >= 0.82:
                assert (a, b) in found


def test_group_words_on_worked_pages(spark):
    # Words (text, x0, top) and the lines (text, x0, top of the lowest word) they make.
    pages_ = [
        ([("a", 5.0, 10.0), ("b", 50.0, 13.0)], [("a b", 5.0, 13.0)]),
        ([("a", 5.0, 10.0), ("b", 50.0, 13.1)], [("a", 5.0, 10.0), ("b", 50.0, 13.1)]),
        ([("a", 5.0, 10.0), ("b", 30.0, 12.5), ("c", 60.0, 14.2)], [("a b c", 5.0, 14.2)]),
        ([("a", 5.0, 10.0), ("b", 30.0, 12.5), ("c", 60.0, 14.3)], [("a b", 5.0, 12.5), ("c", 60.0, 14.3)]),
        ([("b", 50.0, 10.0), ("a \t x", 20.0, 11.5)], [("a x b", 20.0, 11.5)]),
        ([("-", 5.0, 10.0), ("y", 5.0, 100.0), ("x", 4.0, 200.0)], [("y", 5.0, 100.0), ("x", 4.0, 200.0)]),
    ]
    data, want = [], []
    for page, (words, lines) in enumerate(pages_):
        data += [(1, page, i, t, x, y, x + 9, y + 5, 200.0, 300.0) for i, (t, x, y) in enumerate(words)]
        want += [(page, t, round(x / 200, 9), round((y + 5) / 300, 9)) for t, x, y in lines]
    df = spark.createDataFrame(data, "doc_id int, page int, idx int, text string, x0 double, top double, "
                               "x1 double, bottom double, width double, height double")
    got = [(r.page, r.text, round(r.x0, 9), round(r.y1, 9)) for r in ocr.group_words(df).collect()]
    assert sorted(got) == sorted(want)


def test_scale_position_keeps_all_rows(spark):
    data = [("a", 1.0), ("a", 3.0), ("a", 5.0), ("a", None), (None, 2.0), (None, 4.0), ("z", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = sorted(((r.k, r.v, r.position) for r in grids.scale_position(df, ["k"], "v").collect()), key=str)
    assert got == sorted([("a", 1.0, 0.0), ("a", 3.0, 0.5), ("a", 5.0, 1.0), ("a", None, None), (None, 2.0, 0.0),
                          (None, 4.0, 1.0), ("z", None, None)], key=str)


@pytest.mark.parametrize("most", [100_000, 1])
def test_scale_position_shuffles_no_rows_of_few_groups(spark, monkeypatch, most):
    monkeypatch.setattr(grids, "BROADCAST_SCALES", most)
    df = spark.range(400).selectExpr("id", "id % 2 AS k", "cast(id AS double) AS v")
    out = grids.scale_position(df, ["k"], "v")
    join = out._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert join.rstrip().endswith("BroadcastHash") == (most > 1)
    got = dict((r.id, r.position) for r in out.collect())
    assert len(got) == 400 and all(got[i] == pytest.approx((i // 2) / 199) for i in range(400))


def test_ocr_summary_statuses(spark):
    box = None
    data = [(1, 1, 0, "abcd", 0.9, box), (1, 2, 0, "abcde", 0.6, box), (1, 3, 0, "abcde", 0.59, box),
            (1, 4, 0, "abcdefghi", 1.7, box), (1, 4, 1, "x", None, box), (1, 5, 0, " \t", 0.9, box)]
    df = spark.createDataFrame(data, "doc_id int, page int, idx int, text string, confidence double, box array<array<double>>")
    out = ocr.ocr_page_summary(ocr.prepared_lines(df), df.select("doc_id", "page"))
    assert rows(out.select("page", "status", "mean_confidence", "low_confidence_line_count"), "page") == [
        (1, "sparse", 0.9, 0), (2, "good", 0.6, 0), (3, "low_confidence", 0.59, 1), (4, "good", 0.9, 1), (5, "empty", 0.0, 0),
    ]


# --- text edits ----------------------------------------------------------------------------


def test_replace_with_limit_worked_cases(spark):
    data = [(1, 0, "cat Cat concat cat."), (1, 1, "cat $1 cat"), (2, 5, "none"), (2, 7, "cat_cat cat-cat")]
    df = spark.createDataFrame(data, "doc_id int, pos int, text string")
    new = r"\$2"
    cases = {
        ("cat", True, False, 3): [("\\$2 Cat con\\$2 \\$2.", 3), ("cat $1 cat", 0), ("none", 0), ("\\$2_\\$2 \\$2-cat", 3)],
        ("cat", False, True, 4): [("\\$2 \\$2 concat \\$2.", 3), ("\\$2 $1 cat", 1), ("none", 0), ("cat_cat \\$2-\\$2", 2)],
        ("$1", True, False, 0): [("cat Cat concat cat.", 0), ("cat \\$2 cat", 1), ("none", 0), ("cat_cat cat-cat", 0)],
        ("cat.", True, True, 1): [("cat Cat concat \\$2", 1), ("cat $1 cat", 0), ("none", 0), ("cat_cat cat-cat", 0)],
    }
    for (find, case, word, count), want in cases.items():
        got = textedit.replace_literal(df, find, new, case, word, count)
        assert rows(got.select("text", "replaced", "doc_id", "pos"), "doc_id", "pos") == [(*w, d, p) for w, (d, p, _) in zip(want, data)]


def test_edit_arguments(spark):
    df = spark.createDataFrame([(1, 0, "a")], "doc_id int, pos int, text string")
    with pytest.raises(ValueError):
        textedit.replace_literal(df, "", "x")
    with pytest.raises(ValueError):
        textedit.replace_literal(df, "a", "x", count=10_001)
    with pytest.raises(ValueError):
        textedit.remove_matching(df, "a", "regex")
    got = textedit.insert_after(df, "a", ["b"], mode="exact")
    assert rows(got, "pos") == [(1, 0, "a"), (1, 1, "b")]


def test_group_words_like_collected_pages(spark):
    """Pages larger than an Arrow batch, against lines built from each page held whole."""
    rng = random.Random(12)
    data = []
    for page in range(6):
        for i in range(3000 if page == 0 else 40):
            top, left = round(rng.uniform(0, 900 if page % 2 else 60), 1), round(rng.uniform(0, 500), 1)
            data.append((1, page, i, rng.choice(["ab", "Cd", "é", "-", "x y"]), left, top, left + 9, top + 5, 600.0, 1000.0))
    df = spark.createDataFrame(data, "doc_id int, page int, idx int, text string, x0 double, top double, x1 double, bottom double, width double, height double")
    want = collections.Counter()
    for page in range(6):
        words = sorted((w for w in data if w[1] == page), key=lambda w: (round(w[5] / 2.5), w[4], w[2]))
        lines = [[words[0]]]
        for w in words[1:]:
            mean = sum(x[5] for x in lines[-1]) / len(lines[-1])
            if abs(w[5] - mean) > 3.0 or round(w[5] / 2.5) - round(lines[-1][-1][5] / 2.5) >= 3:
                lines.append([])
            lines[-1].append(w)
        for held in lines:
            text = " ".join(w[3] for w in sorted(held, key=lambda w: (w[4], round(w[5] / 2.5), w[2])))
            if any(c.isalnum() for c in text):
                want[page, text, round(min(w[4] for w in held) / 600, 9), round(max(w[7] for w in held) / 1000, 9)] += 1
    got = collections.Counter((r.page, r.text, round(r.x0, 9), round(r.y1, 9)) for r in ocr.group_words(df.repartition(3)).collect())
    assert got == want


def test_few_letter_pairs_are_shuffled_and_none_is_lost(spark):
    import random
    from difflib import SequenceMatcher

    from parlance.operators import ocr

    r = random.Random(3)
    texts = ["".join(r.choice("eeettanois") for _ in range(r.randrange(3, 40))) for _ in range(40)]
    near = ["".join(r.choice("xyz") if r.random() < 0.12 else c for c in t) for t in texts]
    keyed = "doc_id int, page int, key string"
    left = spark.createDataFrame([(k % 3, 1, t) for k, t in enumerate(texts)], keyed).distinct()
    right = spark.createDataFrame([(k % 3, 1, t) for k, t in enumerate(near)], keyed).distinct()
    got = {tuple(x) for x in ocr._similar_pairs(left, right, 0.82).collect()}
    want = {
        (a, 1, s, t) for i, s in enumerate(texts) for j, t in enumerate(near)
        if (a := i % 3) == j % 3 and SequenceMatcher(None, s, t, autojunk=False).ratio() >= 0.82
    }
    assert want and want <= got
    first = left.select("key", ocr._first_pairs({"et": 9}, 0.82)("key").alias("pairs")).collect()
    assert all(len(x["pairs"]) <= max(len(x["key"]) - 1, 2) * 0.65 + 2 for x in first)


def _odd_pages(spark, rng):
    """Lines, native lines and images of small pages, with nulls, repeated indices and repeated rows."""
    texts = ["", "!!", "ab", "some line", "Some LINE", "a longer line of words", "a longer lime of words", "another text", "a longer line of words and more"]
    line_rows, native_rows, image_rows = [], [], []
    for page in [*range(60), None]:
        for i in range(rng.randint(0, 8)):
            x, y = rng.randint(0, 1000) * 1.0, rng.randint(0, 1000) * 1.0
            box = None if rng.random() < 0.2 else [[x, y], [x + 20, y], [x + 20, y + 10], [x, y + 10]]
            line = (rng.choice([1, 1, None]) if page == 7 else 1, page, rng.choice([i, i, 0, None]), rng.choice([*texts, None]), 0.9, box, 1000, 1000)
            line_rows += [line] * rng.choice([1, 1, 2])
        native_rows += [(1, page, rng.choice(["", None, "ab", "someline", "alongerlineofwords", "alangerlyneofwordsx", "anothertexts"]), *((0.0, 0.0, rng.choice([1.0, 0.5, None]), 1.0))) for _ in range(rng.randint(0, 3))]
        image_rows += [(1, page, 0.2, rng.choice([0.0, None]), rng.random(), 0.9) for _ in range(rng.randint(0, 2))]
    box = "x0 double, y0 double, x1 double, y1 double"
    return (
        spark.createDataFrame(line_rows, "doc_id int, page int, idx int, text string, confidence double, box array<array<double>>, page_width int, page_height int"),
        spark.createDataFrame(native_rows, f"doc_id int, page int, key string, {box}"),
        spark.createDataFrame(image_rows, f"doc_id int, page int, {box}"),
    )


def test_line_reasons_by_page_like_rule_by_rule(spark, monkeypatch):
    given = _odd_pages(spark, random.Random(11))
    show = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = ocr._reasons_of_long_pages(*given)
    by_page = ocr.line_reasons(*given)
    assert by_page.dtypes == want.dtypes
    assert show(by_page) == show(want)
    assert {r.reason for r in by_page.collect()} == {"native", "outside", "duplicate", "kept"}
    monkeypatch.setattr(ocr, "PAGE_ROWS", 8)
    assert 0 < ocr._long_pages(*given).count() < 60
    assert show(ocr.line_reasons(*given)) == show(want)


def test_line_reasons_shuffle_once(spark):
    plan = ocr.line_reasons(*_odd_pages(spark, random.Random(12)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
