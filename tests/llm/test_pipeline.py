"""The pipeline's stages against what brute force says of a small table with planted cases."""

import corpus_pipeline
from tests.llm.test_operators import near_classes, words


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    letters = str.maketrans("0123456789", "abcdefghij")
    planted = [(9001, "12 34"), (9002, None), (9003, " ".join(words(1, 60)).translate(letters)), (9005, "so it begins " + item)]
    planted.append((9004, planted[2][1] + " end"))
    extra = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in planted], source.schema)
    docs = source.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "encoding"]
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert docs.columns == source.columns
        if name == "near_duplicates":
            given = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, _, c in near_classes(given)})
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not ids[0] & {9001, 9002} and len(ids[0]) == source.count() + 3
    assert {9003, 9004, 9005} <= ids[1] and 9003 in ids[2] and 9004 not in ids[2]
    assert 9005 in ids[2] and 9005 not in ids[3] and ids[3] == ids[4] and 9003 in ids[4]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


CLASHING = "doc_id long, text string, lang string, source string, n_lines int, n_dropped int, __key long, __n long, __marked string, __drop boolean, __judged string, row string, component int"


def clashing(spark, rows):
    """Documents without n_chars, with columns named like those the stages make."""
    return spark.createDataFrame([(i, t, lang, "s", 7, 8, 9, 10, "m", True, "j", "r", 11) for i, t, lang in rows], CLASHING)


ROWS = [
    (1, "the first of the texts is here and it is long enough to be read", "en"),
    (1, "the first of the texts is here and it is long enough to be read", "en"),
    (None, "another of the texts is here and it is also long enough to be read", "en"),
    (None, None, None),
    (3, "", "en"),
    (4, " \n ", None),
]


def test_stages_keep_columns_and_odd_rows(spark):
    docs = clashing(spark, ROWS)
    kept = {"language": 3, "lines": 6, "near_duplicates": 5, "decontamination": 6}
    for name, n in kept.items():
        got = stage(name)(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and got.schema == docs.schema
        rows = got.collect()
        assert len(rows) == n and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    coded = stage("encoding")(spark, docs, "/root/testdata/sf0.001").collect()
    assert len(coded) == 6 and sorted(r["n_tokens"] == 1 for r in coded) == [False] * 4 + [True] * 2


def test_stages_on_empty_tables(spark):
    docs = clashing(spark, ROWS).limit(0)
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_language_stage(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}en" for a in letters for b in "aeiou"]
    learnt = [(k, " ".join(words[k : k + 40] * 100), "en") for k in range(90)]
    odd = [(200, "漢字仮名交じり文章例示用文字列" * 3, None), (201, "12 34 !?", "en"), (202, words[5], None), (203, None, "en")]
    docs = clashing(spark, learnt + odd)
    got = {r["doc_id"] for r in stage("language")(spark, docs, "").collect()}
    assert got == {*range(90), 202}
    unlabelled = clashing(spark, [(i, t, None) for i, t, _ in learnt + odd])
    assert stage("language")(spark, unlabelled, "").count() == 94


def test_lines_stage_sets_lengths(spark):
    line = "this line stands at the foot of many pages of this site"
    letters = str.maketrans("0123456789", "abcdefghij")
    own = [" ".join(words(1000 + k, 12, 10**6)).translate(letters) for k in range(120)]
    rows = [(k, f"{own[2 * k]}\n{line}\n{own[2 * k + 1]}", 5) for k in range(60)]
    docs = spark.createDataFrame([(i, t, n, "x") for i, t, n in rows] + [(99, line, 3, "x")], "doc_id long, text string, n_chars int, n_lines string")
    got = {r["doc_id"]: r for r in stage("lines")(spark, docs, "").collect()}
    assert set(got) == set(range(60))
    for r in got.values():
        assert line not in r["text"] and r["n_chars"] == len(r["text"]) and r["n_lines"] == "x"
