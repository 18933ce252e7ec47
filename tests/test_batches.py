"""All batches of documents: every row is read, limits hold, and each batch goes on where the one before ended."""

import random

import pyarrow as pa
import pytest

from parlance.operators import batches, pages


def documents(r, n, kinds):
    """Rows (doc_id, position, size); one document is empty of rows, one is long."""
    lengths = [r.randrange(1, 30) for _ in range(n)] + [400]
    return [(d, k, r.choice(kinds)) for d, m in enumerate(lengths) for k in range(m)]


@pytest.mark.parametrize("chunk", [batches.CHUNK, 7])
def test_paragraphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(batches, "CHUNK", chunk)
    r = random.Random(chunk)
    data = [(d, 3 * k + d % 2, None if n == 0 and k % 2 else "x" * n) for d, k, n in documents(r, 12, [0, 1, 5, 9, 10, 11, 40])]
    df = spark.createDataFrame(data, "doc_id long, pos int, text string")
    read, cursor = batches.batches_by_paragraphs(df, 6, 10)
    by_doc = {}
    for x in read.collect():
        by_doc.setdefault(x["doc_id"], []).append((x["pos"], x["batch"], len(x["text"] or "")))
    heads = {(x["doc_id"], x["batch"]): x for x in cursor.collect()}
    want = sorted((d, p) for d, p, _ in data)
    assert sorted((d, p) for d, rows in by_doc.items() for p, _, _ in rows) == want  # each paragraph once
    for d, rows in by_doc.items():
        rows.sort()
        groups = {}
        for p, b, n in rows:
            groups.setdefault(b, []).append((p, n))
        assert list(groups) == list(range(len(groups)))
        for b, held in groups.items():
            total = sum(n for _, n in held)
            assert len(held) <= 6 and (total <= 10 or len(held) == 1)
            after = groups.get(b + 1)
            if after:  # the next paragraph would have broken a limit
                assert len(held) == 6 or total + after[0][1] > 10
            x = heads[d, b]
            assert (x["paragraph_count"], x["char_count"], x["next_paragraph"]) == (len(held), total, after[0][0] if after else None)
    assert batches.batches_by_paragraphs(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("chunk", [batches.CHUNK, 5])
def test_tables(spark, monkeypatch, chunk):
    """Tables are read in order, limits hold, and each batch ends for a reason and names the next start."""
    monkeypatch.setattr(batches, "CHUNK", chunk)
    r = random.Random(chunk)
    data = []
    for d in range(25):
        page = 1
        for k in range(r.choice([1, 6, 60])):
            page += r.choice([0, 0, 0, 1, 1, 2, 9])
            data.append((d, page, k, r.choice([0, 1, 4, 9, 10, 10] + [11] * (d % 5 == 0))))
    df = spark.createDataFrame(data, "doc_id long, page int, table_idx int, cells int")
    read, cursor = batches.batches_by_tables(df, 4, 10, 3)
    got, heads = {}, {(x["doc_id"], x["batch"]): x for x in cursor.collect()}
    for x in read.collect():
        got.setdefault((x["doc_id"], x["batch"]), []).append((x["page"], x["table_idx"], x["cells"]))
    for d in range(25):
        rest = sorted((p, k, n) for e, p, k, n in data if e == d)
        start, table = 1 + (rest[0][0] - 1) // 3 * 3, 0
        for b in range(sum(e == d for e, _ in heads)):
            x, held = heads[d, b], sorted(got.get((d, b), []))
            assert x["start_page"] == start and held == rest[: len(held)]
            assert x["table_count"] == len(held) <= 4 and x["cell_count"] == sum(n for _, _, n in held) <= 10
            rest = rest[len(held) :]
            assert all(start <= p < start + 3 for p, _, _ in held)
            if not rest:
                assert x["next_page"] is None and x["next_table"] is None and x["error"] is None
            elif not held:
                assert x["error"] and rest[0][2] == 11 and (x["next_page"], x["next_table"]) == rest[0][:2]
                rest = []
            elif rest[0][0] < start + 3:  # stopped before a table of the window
                assert len(held) == 4 or x["cell_count"] + rest[0][2] > 10
                assert (x["next_page"], x["next_table"]) == rest[0][:2]
                start = rest[0][0]
            else:  # the next window that holds a table
                start += (rest[0][0] - start) // 3 * 3
                assert (x["next_page"], x["next_table"]) == (start, 0)
        assert not rest
    at = [(d, x["next_page"], x["next_table"]) for (d, b), x in heads.items() if b == 0 and x["next_page"] and not x["error"]]
    counts = df.selectExpr("doc_id", "100000 AS page_count").distinct()
    again = pages.page_by_tables(df, counts, 4, 10, 3, spark.createDataFrame(at, "doc_id long, start_page int, start_table int"))[0]
    second = {}
    for x in again.collect():
        second.setdefault(x["doc_id"], []).append((x["page"], x["table_idx"], x["cells"]))
    assert all(sorted(second.get(d, [])) == sorted(got.get((d, 1), [])) for d, _, _ in at)


@pytest.mark.parametrize("chunk", [batches.CHUNK, 9])
def test_tables_by_cells(spark, monkeypatch, chunk):
    monkeypatch.setattr(batches, "CHUNK", chunk)
    r = random.Random(chunk)
    data = documents(r, 15, [0, 1, 3, 7, 10, 25])
    df = spark.createDataFrame(data, "doc_id long, table_idx int, cells int")
    read, cursor = batches.batches_by_cells(df, 4, 10)
    sizes = {(d, k): n for d, k, n in data}
    groups = {}
    for x in read.orderBy("doc_id", "batch", "table_idx").collect():
        groups.setdefault((x["doc_id"], x["batch"]), []).append((x["table_idx"], x["used"], x["truncated"]))
    after = {(x["doc_id"], x["batch"]): (x["table_count"], x["next_table"]) for x in cursor.collect()}
    assert {(d, k) for (d, _), held in groups.items() for k, _, _ in held} == set(sizes) and set(after) == set(groups)
    for (d, b), held in groups.items():
        used = sum(n for _, n, _ in held)
        assert len(held) <= 4 and used <= 10 and not any(cut for _, _, cut in held[:-1])
        last, n, cut = held[-1]
        assert cut == (n < sizes[d, last]) and all(m == sizes[d, k] for k, m, c in held if not c)
        nxt = last if cut and len(held) > 1 else last + 1
        assert after[d, b] == (len(held), nxt if (d, nxt) in sizes else None)
        if (d, b + 1) in groups:
            assert groups[d, b + 1][0][0] == nxt and (cut or used == 10 or len(held) == 4)


def test_long_document_in_many_tasks(spark):
    """100,000 paragraphs in chunks of 65,536: two chunks, whose batches follow one another."""
    df = spark.range(100_000).selectExpr("7L AS doc_id", "cast(id AS int) AS pos", "repeat('x', cast(id % 13 AS int)) AS text")
    read, cursor = batches.batches_by_paragraphs(df, 80, 200)
    rows = sorted((x["pos"], x["batch"]) for x in read.select("pos", "batch").collect())
    want, held, total, batch = [], 0, 0, 0
    for k in range(100_000):
        n = k % 13
        if held == 80 or held and total + n > 200:
            batch, held, total = batch + 1, 0, 0
        held, total = held + 1, total + n
        want.append((k, batch))
    assert rows == want and cursor.count() == batch + 1


def test_chars(spark):
    """Pieces make up the text, no batch is over budget, and a single read from each cursor gives the next batch."""
    r = random.Random(4)
    sizes = [0, 1, 20, 499, 500, 501, 700, 1500, 3000, 9000]
    data = []
    for d in range(40):
        for k in range(r.randint(1, 14)):
            n = r.choice(sizes)
            data.append((d, k + 1, "e", "good" if r.random() > 0.25 else "poor", "".join(r.choice("abé") for _ in range(n))))
    df = spark.createDataFrame(data, "doc_id long, page int, engine string, status string, text string").cache()
    texts = {(d, p): t if status == "good" else "" for d, p, _, status, t in data}
    for budget in (1000, 1500, 24_000):
        read = batches.batches_by_chars(df, budget, 6)
        joined, held, cursors, found = {}, {}, {}, {}
        for x in read.orderBy("doc_id", "batch", "page").collect():
            key = x["doc_id"], x["batch"]
            joined[x["doc_id"], x["page"]] = joined.get((x["doc_id"], x["page"]), "") + x["text"]
            held[key] = held.get(key, 0) + len(x["text"])
            cursors[key] = x["next_page"], x["next_offset"]
            found.setdefault(key, []).append((x["page"], x["text"], x["complete"], x["offset_start"], x["offset_end"]))
        assert joined == texts and max(held.values()) <= budget
        assert {d for d, _ in held} == set(range(40)) and all((d, b - 1) in held for d, b in held if b)
        for b in range(max(b for _, b in held)):
            at = [(d, *cursors[d, b]) for d in range(40) if (d, b) in cursors and cursors[d, b][0]]
            step = pages.page_by_chars(df, budget, 6, spark.createDataFrame(at, "doc_id long, start_page int, start_offset int")) if at and b < 3 else None
            if step is not None:
                one = {}
                for x in step.orderBy("doc_id", "page").collect():
                    one.setdefault(x["doc_id"], []).append((x["page"], x["text"], x["complete"], x["offset_start"], x["offset_end"]))
                assert all(one[d] == found[d, b + 1] for d, _, _ in at)
    assert batches.batches_by_chars(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        batches.batches_by_chars(df, 0)


def test_short_documents_share_arrow_batches():
    """The walk takes an ordered stream: documents that end inside an Arrow batch, and one that spans three of them."""
    rows = [(d, 0, k, 4, 1, n, None, None) for d, n in ((1, 2), (2, 1), (5, 9), (6, 3)) for k in range(n)]
    kinds = [pa.int64()] * 8
    sent = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4]), kinds)], names=batches._WALKED) for a in range(0, len(rows), 4)]
    made = list(batches._walk(batches.Rule(3, 10))(iter(sent)))
    got = [tuple(x.values()) for b in made for x in b.select(["doc_id", "batch", "first", "end", "next"]).to_pylist()]
    want = [(1, 0, 0, 2, None), (2, 0, 0, 1, None), (6, 0, 0, 2, 2), (6, 1, 2, 3, None)]
    want += [(5, k, 2 * k, min(2 * k + 2, 9), 2 * k + 2 if k < 4 else None) for k in range(5)]
    assert sorted(got) == sorted(want) and len(made) < len(sent)
