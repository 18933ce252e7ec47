"""Operators against brute force, round trips and held-out rows, with odd inputs: nulls, empty and long texts, repeats."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers as P
import pytest

from parlance.llm import brown_lm, histogram_sort, language_mixture, line_frequency, line_templates, partenum
from parlance.llm import piece_table, string_tiling, token_attribution, url_markov
from parlance.llm.queries import PIECE_MODEL, RANK_FILE, RULES, read_bytes

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (4, "One."), (None, "a b c d e f"), (5, LONG), (6, "Ünï ▁x  é́ 😀\x00\n\nend ")]


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"v{r.randrange(vocabulary)}" for _ in range(n)]


def test_pieces_equal_the_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    r = random.Random(3)
    made = [(100 + k, "".join(r.choice("abcdethe ingr \n▁éñ😀ßü.,#  \t\x00") for _ in range(r.randrange(80)))) for k in range(300)]
    given = [*ODD, *made, (9, "the" * 5000), (11, "a b " * 400_000), (12, "after it"), (10, " " * 100 + "x")]
    got = piece_table.encode_pieces(docs(given), read_bytes(PIECE_MODEL), ("ids", "n_tokens", "ids_sha256", "decoded"))
    by_id = collections.defaultdict(list)
    for row in got.collect():
        by_id[row["doc_id"]].append(row)
    assert sum(map(len, by_id.values())) == len(given)
    for doc, text in given:
        want = lib.encode(text or "", add_eos=True)
        row = by_id[doc][0]
        assert row["ids"] == want and row["n_tokens"] == len(want) and row["decoded"] == lib.decode(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    again = piece_table.decode_pieces(got, read_bytes(PIECE_MODEL))
    assert sorted(again.select("text").collect()) == sorted(got.select("decoded").collect())


def test_attribution_adds_up(docs):
    given = [*ODD, (7, "one two\n\n\nthree  four\nfive")]
    for rule in token_attribution.RULES:
        got = token_attribution.attribute_tokens(docs(given), read_bytes(RANK_FILE), P.PATTERN, rule)
        total, share, whole = collections.Counter(), collections.Counter(), {}
        for r in got.collect():
            total[r["doc_id"]] += r["n_tokens"]
            share[r["doc_id"]] += r["share"]
            whole[r["doc_id"]] = r["doc_tokens"] * (2 if r["doc_id"] == 4 else 1)  # doc 4 is there twice
        assert dict(total) == whole and share == pytest.approx(whole)
        assert {1, 2, 3, 4, 5, 6, 7, None} == set(total) and total[1] == total[2] == 0


def test_spans_like_decoding_every_token():
    """A token spans the characters whose bytes it holds, found by decoding all tokens before it."""
    encoder = token_attribution._encoder(read_bytes(RANK_FILE), P.PATTERN)
    lib = encoder[0].library
    r = random.Random(6)
    for k in range(200):
        text = "".join(r.choice("abc the é😀ñ\n ▁ﬁ\x00") for _ in range(r.randrange(1, 60)))
        owner = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
        starts, ends, at = [], [], 0
        for token in lib.encode_ordinary(text):
            size = len(lib.decode_single_token_bytes(token))
            starts.append(owner[at])
            ends.append(owner[at + size - 1] + 1)
            at += size
        got = token_attribution.token_spans(text, encoder)
        assert at == len(owner) and got[0].tolist() == starts and got[1].tolist() == ends


def test_very_long_runs_of_one_character():
    encoder = token_attribution._encoder(read_bytes(RANK_FILE), P.PATTERN)
    for char in " \t\n\u2003aé7.":
        text = "x" + char * 5_000_000 + "y"
        starts, ends = token_attribution.token_spans(text, encoder)
        assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all() and (ends[1:] >= ends[:-1]).all()
    few = "a" + " " * 120_000 + "b\n" + "\n" * 110_000 + " c"
    assert encoder[0].encode_ordinary(few) == encoder[0].library.encode_ordinary(few)


def test_crossing_tokens_follow_the_rule():
    import numpy as np

    starts, ends, bounds = np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4, 9])
    assert token_attribution.allot(starts, ends, bounds, "first")[0].tolist() == [2, 1]
    assert token_attribution.allot(starts, ends, bounds, "last")[0].tolist() == [1, 2]
    counts, crossing, share = token_attribution.allot(starts, ends, bounds, "most")
    assert counts.tolist() == [1, 2] and crossing.tolist() == [1, 1] and share.tolist() == [1.2, 1.8]


def test_tiling_finds_reordered_passages(spark, docs):
    item = words(1, 40)
    moved = item[20:] + ["x"] * 30 + item[:20]
    given = [*ODD, (20, " ".join(moved)), (21, " ".join(words(2, 300))), (22, " ".join(item[:15] + words(4, 90)))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (None, "a b c d e f")], "item_id long, text string")
    got = string_tiling.find_leaks(docs(given), bench)
    assert rows(got, "doc_id", "item_id", "coverage", "n_tiles", "longest") == [(20, 0, 1.0, 2, 20)]
    assert string_tiling.find_leaks(docs([]).limit(0), bench).count() == 0
    assert string_tiling.find_leaks(docs(given), bench.limit(0)).count() == 0


def test_all_texts_of_one_item_are_searched(spark, docs):
    long, short, part = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 30), ("z", 8), ("q", 20)))
    bench = spark.createDataFrame([(7, long), (7, short), (8, part), (8, part + " " + long)], "item_id long, text string")
    got = string_tiling.find_leaks(docs([(1, long), (2, short), (3, "x " + part)]), bench)
    assert sorted(rows(got, "doc_id", "item_id", "coverage")) == [(1, 7, 1.0), (1, 8, 0.6), (2, 7, 1.0), (3, 8, 1.0)]


def test_tiles_are_greedy_and_apart():
    r = random.Random(5)
    for _ in range(50):
        import numpy as np

        a, b = (np.array([r.randrange(1, 4) for _ in range(30)]) for _ in range(2))
        hits = [(i, j) for i in range(28) for j in range(28) if (a[i : i + 3] == b[j : j + 3]).all()]
        tiles = string_tiling.tile(a, b, hits, 3)
        assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)
        for side in (0, 1):
            places = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in tiles)


def test_urls_follow_rules_and_models(spark):
    hosts = [("good", "org", "fr"), ("good", "com", "fr"), ("bad", "com", "de")]
    urls = [f"http://{h}{k}.Example.{top}/{lang}/{k}?q#f" for k in range(60) for h, top, lang in hosts]
    urls += [None, "nothing", "http://", "http://x.net", "http://bad7.example.net/de/7", "http://good7.example.net/fr/7", "http://example.org/es/1", "http://" + "a" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", url_markov.F.lit("x"))
    got = {r["page_id"]: r for r in url_markov.filter_urls(pages, RULES).collect()}
    assert len(got) == len(urls)
    n = 180
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("good0.example.org", "/fr/0", "org/", "allow")
    assert got[2]["verdict"] == "block" and got[2]["rule"] == "com/de/"
    assert (got[n]["host"], got[n]["path"], got[n]["rule"]) == ("", "", None)
    assert got[n + 4]["verdict"] == "block" and got[n + 5]["verdict"] == "allow" and got[n + 4]["rule"] is None
    assert got[n + 6]["rule"] == "example.org/es/" and got[n + 6]["verdict"] == "block"
    assert url_markov.filter_urls(pages.limit(0), RULES).count() == 0


def near_classes(given):
    sets = []
    for _, text in given:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(given)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(given)):
        groups[top(i)].append(given[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((given[i][0], len(sets[i]), least[top(i)]) for i in range(len(given))), key=str)


def test_near_duplicates_equal_brute_force(docs):
    r = random.Random(7)
    given = list(ODD)
    for family in range(6):
        base = words(family, r.randrange(30, 250))
        for copy in range(25):
            text = list(base)
            for _ in range(r.randrange(0, 9)):
                text[r.randrange(len(text))] = f"new{r.randrange(10**6)}"
            given.append((1000 - len(given), " ".join(text)))
    given += [(2000 + k, " ".join(words(50 + k, 12))) for k in range(40)] + [(3000, "One."), (3001, "one. two")]
    got = partenum.near_duplicates(docs(given))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id"), key=str) == near_classes(given)
    kept = partenum.keep_one_of_each(docs(given))
    with_words = {(c, n > 0) for _, n, c in near_classes(given) if n}
    assert kept.filter("text rlike '[^ \\n\\t]'").count() == len(with_words)
    assert partenum.near_duplicates(docs([]).limit(0)).count() == 0


def test_languages_of_held_out_texts(spark, docs):
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = language_mixture.predict_languages(table.filter(held), table.filter(~held)).join(table.select("doc_id", "lang"), "doc_id")
    hits = [r["lang"] == r["lang_pred"] for r in got.collect()]
    assert sum(hits) >= 0.95 * len(hits)
    odd = language_mixture.predict_languages(docs([*ODD, (8, "12 34 ...")]), table)
    found = {r["doc_id"]: r for r in odd.collect()}
    assert odd.count() == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in found.values())
    assert {found[k]["lang_pred"] for k in (1, 2, 3, 8)} == {"und"}
    assert rows(language_mixture.predict_languages(docs(ODD), table.limit(0)), "lang_pred") == [("und",)] * len(ODD)


def test_mixture_finds_both_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, model = language_mixture.learn(table)
    text = {r["lang"]: r["text"] for r in table.filter("n_chars between 1500 and 6000").collect()}
    mixed = language_mixture.mixture(text["en"][:1500] + " " + text["de"][:1500], langs, model)
    assert set(mixed) == {"en", "de"} and 0.3 < mixed["en"] < 0.7


def test_class_model_scores(spark, docs):
    import math

    training = [(k, " ".join(words(k, 50))) for k in range(40)]
    given = [*ODD, *training, (99, "V1 unseen-word v2")]
    got = brown_lm.score_documents(docs(given), docs(training))
    counts = collections.Counter(w for _, t in training for w in [*t.encode().lower().split(), b""])
    total = sum(counts.values())
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(given)
    for doc, text in given:
        tokens = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        r = by_id[doc]
        if doc not in (1, 2, 3, 4, 5, 6):  # ids that ODD and the training texts share
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert brown_lm.score_documents(docs(ODD), docs(ODD).limit(0)).count() == len(ODD)


def test_recurring_templates_are_dropped(docs):
    r = random.Random(9)
    letters = str.maketrans("0123456789", "abcdefghij")
    prose = lambda k: " ".join(words(1000 + k, 12, 10**6)).translate(letters)
    given = [(k, f"{prose(3 * k)}\nPrinted on day {r.randrange(99)} for the reader number {k}\n{prose(3 * k + 1)}") for k in range(30)]
    copy = "\n".join(prose(5000 + k) for k in range(6))
    given += [(100 + k, copy) for k in range(20)] + [(200, None), (201, ""), (202, "Short line"), (203, LONG)]
    got = {x["doc_id"]: x for x in line_templates.drop_recurring_lines(docs(given)).collect()}
    assert all("Printed" not in got[k]["text"] and got[k]["n_dropped"] == 1 and got[k]["n_lines"] == 3 for k in range(30))
    assert all(got[100 + k]["text"] == copy for k in range(20))
    assert got[200]["text"] is None and got[201]["text"] == "" and got[203]["text"] == LONG
    assert line_templates.drop_recurring_lines(docs([]).limit(0)).count() == 0


def test_recurring_blocks_are_dropped(docs):
    letters = str.maketrans("0123456789", "abcdefghij")
    prose = lambda k: " ".join(words(1000 + k, 12, 10**6)).translate(letters)
    blocks = {
        "short": ["The whole notice ends with this word", "Les."],
        "two": ["This is the first line of two", "And here the second one follows it"],
        "three": ["Alpha line of a block with three", "Beta line in the middle of it", "Gamma line that closes the whole block"],
        "foot": ["Printed by the office in this town", "All rights of the office are reserved", "Do not copy any of these pages"],
        "head": ["Welcome to the pages of this office", "Please read them all with some care"],
    }
    given, want = [], {}
    for n, (name, block) in enumerate(blocks.items()):
        for k in range(12):
            own = [prose(10_000 * n + 4 * k + j) for j in range(4)]
            low, high = {"foot": (4, 4), "head": (0, 0)}.get(name, (2, 2))
            given.append((100 * n + k, "\n".join(own[:low] + block + own[high:])))
            want[100 * n + k] = "\n".join(own[:low] + block[len(block) - (name == "short") :] + own[high:])
    copy = [prose(90_000 + k) for k in range(9)]
    for k in range(40):
        edited = list(copy)
        edited[k % 9] = prose(91_000 + k)
        given.append((1000 + k, "\n".join(edited)))
        want[1000 + k] = given[-1][1]
    got = {x["doc_id"]: x["text"] for x in line_templates.drop_recurring_lines(docs(given)).collect()}
    assert got == want


def test_busy_leaves_give_every_template(docs):
    letters = str.maketrans("0123456789", "abcdefghij")
    word = lambda k: f"w{k}x".translate(letters)
    forms = [
        ("this is the page that {} wrote for our readers", 8), ("this is the place where {} keeps all old letters", 8),
        ("this is the list of things {} may not sell", 8), ("this is the town in which {} was seen twice", 4),
    ]
    given, want = [], {}
    for n, (form, docs_with) in enumerate([*forms, ("this is the {} {} {} {} {} {} {}", 30)]):
        for k in range(docs_with):
            at = 10_000 * n + 100 * k
            line = form.format(*(word(at + j) for j in range(7)))
            own = [" ".join(word(at + 10 * j + i) for i in range(10)) for j in (2, 3)]
            given.append((100 * n + k, "\n".join([own[0], line, own[1]])))
            want[100 * n + k] = "\n".join(own if n < len(forms) else [own[0], line, own[1]])
    got = {x["doc_id"]: x["text"] for x in line_templates.drop_recurring_lines(docs(given)).collect()}
    assert got == want


def test_shards_are_whole_and_even(spark, docs):
    given = [*ODD[:4], *((1000 + k, "x" * (k % 50)) for k in range(3000)), *((9000 + k, "same text") for k in range(3000))]
    got = histogram_sort.shard_by_bytes(docs(given), shards=7, ranges=3).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in given
    )
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7 + 120
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert histogram_sort.shard_by_bytes(docs([]).limit(0)).count() == 0


def brute_repeats(text):
    w = text.encode().split()
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)})


def test_line_frequency_rules(docs):
    boiler = "this very line stands in many many of the documents of one host"
    given = [(300 + k, "\n".join([boiler, " ".join(words(k, 8))])) for k in range(60)]
    given += [(200 + k, " ".join(words(70 + k, 40, 3))) for k in range(5)] + ODD
    got = {r["doc_id"]: r for r in line_frequency.line_frequency_rules(docs(given)).collect()}
    texts = {i: t or "" for i, t in given}
    for doc in (*range(300, 360), *range(200, 205), 1, 2, 3, 5, 6):
        own = texts[doc].encode().split()
        r = got[doc]
        assert r["n_words"] == len(own) and r["word_chars"] == sum(len(w.decode()) for w in own)
        assert r["n_repeat_words"] == brute_repeats(texts[doc])
        assert r["base_failed"] == (len(own) < 10 or 100 * r["n_repeat_words"] > 20 * len(own))
    assert not got[320]["base_failed"] and not got[320]["kept"] and got[320]["removed_words"] == 13
    assert line_frequency.line_frequency_rules(docs([]).limit(0)).count() == 0


def test_symbols_and_repeated_lines(docs):
    r = random.Random(17)
    lines = ["#a *b", "#a *b ", "", " ", "x", "$%&|<>", "é\r", "\t", "word & word"]
    given = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for k in range(200)] + [(900, None), (901, "##")]
    got = {x["doc_id"]: x for x in line_frequency.line_frequency_rules(docs(given)).collect()}
    for doc, text in given:
        seen, repeated = set(), 0
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                repeated += line in seen
                seen.add(line)
        assert got[doc]["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert got[doc]["n_dup_lines"] == repeated


def test_large_vocabularies_keep_windows_exact():
    text = " ".join([f"u{k}" for k in range(6000)] + [f"u{k}" for k in range(50)])
    assert line_frequency.repeated_words(text.encode().split()) == brute_repeats(text) == 100


def test_members_of_a_leader_that_share_too_little_are_not_paired(spark):
    """All members share 12 elements beyond their leader, far fewer than a link takes; only two are alike."""
    from parlance.llm.partenum import _compared, _further

    leader = list(range(1000, 1100))
    own = lambda k, n: [10_000 * (k + 1) + i for i in range(n)]
    members = {k: [*range(12), *leader[:48], *own(k, 40)] for k in range(1, 9)}
    members[9] = [*members[8][:-2], 900_001, 900_002]
    sets = spark.createDataFrame([(0, leader), *members.items()], "node long, elements array<long>")
    pairs = spark.createDataFrame([(0, k) for k in members], "a long, b long")
    labels = spark.createDataFrame([], "node long, component long")
    assert [tuple(r) for r in _further(_compared(pairs, sets), labels).collect()] == [(8, 9)]


def test_a_worker_keeps_the_tables_of_one_operator():
    from parlance.llm import common

    first = common.kept("one", lambda: [1])
    assert common.kept("one", lambda: [2]) is first
    assert common.kept("two", lambda: [3]) == [3] and "one" not in common._KEPT
    common.forget()
    assert not common._KEPT


def test_lines_shuffle_only_what_their_blocks_ask(spark):
    lines = spark.createDataFrame(
        [(d, n, 10 + n, 20 + n - 1, 20 + n + 1) for d in range(4) for n in range(3)],
        "key long, line int, template long, before long, after long",
    )
    often = line_templates._in_documents(lines, "template", 3)
    around = line_templates._around(lines, often, "template")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(around._jdf.queryExecution(), "formatted")
    sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(key#", plan)
    assert sent and not any("usual_" in s or "_w0" in s for s in sent)
    assert sorted(tuple(r) for r in around.collect()) == sorted((d, 10 + n, None, None) for d in range(4) for n in range(3))


def test_url_models_are_not_planned_again_by_their_readers(spark):
    """The result meets the stored models, not the joins that make them."""
    from parlance.llm import url_markov as um

    rows = [(k, f"http://{host}/{k}") for k, host in enumerate(["a.org", "b.com", "c.net", "d.org"] * 5)]
    rules = [um.parse_rule("allow org/"), um.parse_rule("block com/")]
    judged = um.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and judged.count() == 20
