"""Source divergence, runs of words and byte-level encoding against brute force and the library."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from parlance.llm import byte_transducer, queries, source_divergence, word_runs
from parlance.llm.queries import RANK_FILE, read_bytes

RANKS = byte_transducer.read_ranks(read_bytes(RANK_FILE))
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (4, "One."), (None, "a b c d e f"), (5, LONG), (6, "Ünï ▁x  é́ 😀\x00\n\nend ")]


def slow_runs(words, shortest):
    """Every period is walked through the whole text; of equal stretches the shortest period stays."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        agree = [words[k] == words[k + period] for k in range(len(words) - period)] + [False]
        start = None
        for k, same in enumerate(agree):
            if same and start is None:
                start = k
            elif not same and start is not None:
                if k - start >= period:
                    found.setdefault((start, k - start + period), period)
                start = None
    return sorted(((s, n, p) for (s, n), p in found.items() if n >= shortest), key=lambda r: (r[0], r[2]))


def periodic(r, n, letters):
    words = [b"%d" % r.randrange(letters) for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), r.randrange(1, n + 1)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def test_runs_like_brute_force():
    r = random.Random(7)
    for _ in range(150):
        batch = [periodic(r, r.choice([0, 1, 11, 12, 13, 40, 120]), r.randrange(1, 5)) for _ in range(r.randrange(1, 6))]
        shortest = r.choice([2, 3, 6, 12])
        assert word_runs.batch_runs(batch, shortest) == [slow_runs(w, shortest) for w in batch]
    assert word_runs.batch_runs([], 12) == []


def test_suffixes_are_sorted_and_share_what_lcp_says():
    r = random.Random(8)
    for n in (1, 2, 50, 200):
        given = [r.randrange(3) for _ in range(n)]
        order, inverse, lcp = word_runs.suffix_order(np.array(given, np.int32))
        assert order.tolist() == sorted(range(n), key=lambda k: given[k:])
        assert all(order[inverse[k]] == k for k in range(n))
        for k in range(1, n):
            a, b, d = given[order[k - 1] :], given[order[k] :], lcp[k]
            assert a[:d] == b[:d] and a[d : d + 1] != b[d : d + 1]


def test_runs_of_long_texts_stay_cheap():
    assert word_runs.batch_runs([[b"a"] * 100_000], 12) == [[(0, 100_000, 1)]]
    assert word_runs.batch_runs([[b"%d" % (k % 3001) for k in range(100_000)]], 12) == [[(0, 100_000, 3001)]]


def test_find_runs_on_odd_rows(spark, docs):
    r = random.Random(9)
    given = [*ODD, *((100 + k, b"  ".join(periodic(r, 60, 3)).decode()) for k in range(40))]
    got = word_runs.find_runs(docs(given))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    seen = sorted(((x["doc_id"] or 0, x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in got.collect()))
    want = []
    for doc, text in given:
        words = (text or "").encode().split()
        runs = [(0, 30_000, 977)] if doc == 5 else slow_runs(words, 12)
        dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((doc or 0, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()))
    assert seen == sorted(want)
    assert word_runs.find_runs(docs([]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(docs(ODD), 1)


def test_op12_like_brute_force(spark, tmp_path, docs):
    r = random.Random(10)
    given = [(1000 + k, " ".join(w.decode() for w in periodic(r, r.randrange(60), 4))) for k in range(300)] + ODD
    docs(given).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(tuple(x.asDict().items()) for x in queries.op12_runs(spark, str(tmp_path)).collect())
    want, planted = collections.Counter(), 0
    for doc, text in given:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str("" if doc is None else doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)], planted + 1
        runs = slow_runs(words, 12) if doc != 5 else [(0, 30_000, 977)]
        dropped = {k for s, m, p in runs for k in range(s + p, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        row = {
            "doc_id": doc, "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
            "exponent_milli": 1000 * top[1] // top[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest(),
            "n_words": len(words),
        }
        want[tuple(row.items())] += 1
    assert got == want and planted > 10


@pytest.fixture(scope="module")
def machine():
    return byte_transducer.Transducer(RANKS)


def test_borders_like_merging(machine):
    r = random.Random(11)
    low = sorted(machine.parts)[:1500]
    for _ in range(3000):
        a, b = r.choice(low), r.choice(low)
        merged = machine.merged(machine.token[a] + machine.token[b], 1 << 62)
        assert machine.apart[a * machine.width + b] == (merged == [a, b])


def test_bytes_equal_the_library(docs, monkeypatch):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    r = random.Random(12)
    made = [(100 + k, "".join(r.choice("abcdethe ingr \n▁éñ😀ßü.,#'s  \t\x00012" + chr(r.randrange(32, 0xD7FF))) for _ in range(r.randrange(80)))) for k in range(500)]
    given = [*ODD, *made, (7, "the" * 5000), (8, " " * 3000 + "x"), (9, "é" * 4000), (10, "<|endoftext|>")]
    got = collections.defaultdict(list)
    encoded = byte_transducer.encode_bytes(docs(given), read_bytes(RANK_FILE), P.PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    for row in encoded.collect():
        got[row["doc_id"]].append(row)
    assert sum(map(len, got.values())) == len(given)
    for doc, text in given:
        row, want = got[doc][0], lib.encode_ordinary(text or "")
        assert row["ids"] == want and row["n_tokens"] == len(want) and row["decoded"] == (text or "")
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode_bytes(want)).hexdigest()
    again = byte_transducer.decode_bytes(encoded, read_bytes(RANK_FILE))
    assert sorted(again.select("text").collect()) == sorted(encoded.select("decoded").collect())
    assert byte_transducer.encode_bytes(docs([]).limit(0), read_bytes(RANK_FILE), P.PATTERN).count() == 0


def test_long_words_and_small_memory(machine, monkeypatch):
    monkeypatch.setattr(byte_transducer, "MEMO", 50)
    monkeypatch.setattr(byte_transducer, "STATES", 50)
    small = byte_transducer.Transducer(RANKS)
    r = random.Random(13)
    for _ in range(300):
        word = "".join(r.choice("abcething éß") for _ in range(r.randrange(1, 40)))
        assert small.encode([word]) == machine.encode([word])
        assert b"".join(small.token[t] for t in small.encode([word])) == word.encode()
    assert len(small.states) <= 51
    data = b"abcab" * 100_000
    assert b"".join(machine.token[t] for t in machine.run(data)) == data


def test_tokens_are_given_out_early(machine):
    """After each byte only the bytes of a few tokens are held back."""
    state, given, longest = machine.start, 0, max(map(len, RANKS))
    data = ("internationalisierung" * 200).encode()
    for k, byte in enumerate(data):
        state, out = state[byte]
        given += sum(len(machine.token[t]) for t in out)
        assert k + 1 - given <= 2 * longest
    assert given > len(data) - 2 * longest


def test_ranks_that_cannot_be_compiled():
    with pytest.raises(ValueError):
        byte_transducer.Transducer({b"a": 0})
    with pytest.raises(ValueError):
        byte_transducer.Transducer({**{bytes((b,)): b + 1 for b in range(256)}, b"ab": 0})


def test_streams_of_any_bytes():
    decoder = byte_transducer.StreamDecoder({rank: token for token, rank in RANKS.items()})
    r = random.Random(14)
    for _ in range(3000):
        data = bytes(r.choice([r.randrange(256), *b"\xe2\x82\xac\xf0\x9f\x98\xed\xa0"]) for _ in range(r.randrange(12)))
        parts = list(decoder.stream(RANKS[data[k : k + 1]] for k in range(len(data))))
        assert "".join(parts) == data.decode(errors="replace")


def slow_audit(docs):
    """The contract, cell by cell, over all groups and kept terms."""
    words, by_doc = collections.Counter(), collections.Counter()
    groups = set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words.update((lang, source, t) for t in terms)
        by_doc.update((lang, t) for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), n in by_doc.items():
        if n >= 3:
            kept[lang].append(t)

    def shares(lang, sources):
        n = {t: sum(words[lang, s, t] for s in sources) for t in kept[lang]}
        total = sum(n.values()) + len(n)
        return n, {t: 1 + 10**9 * (n[t] + 1) // total for t in n}

    out = set()
    for lang, source in groups:
        own = sorted(s for g, s in groups if g == lang)
        n, p = shares(lang, [source])
        whole = shares(lang, own)[1]
        others = [(sum((p[t] - q[t]) ** 2 // q[t] for t in p), s) for s in own if s != source for q in [shares(lang, [s])[1]]]
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in p if n[t] and p[t] > whole[t]]
        for part, items, most in (("pair", others, None), ("term", terms, 200)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])}
    return out


@pytest.mark.parametrize("columns, groups, frontier", [(4096, 256, 500_000), (5, 3, 40)])
def test_audit_like_brute_force(spark, monkeypatch, columns, groups, frontier):
    for name, value in (("COLUMNS", columns), ("GROUPS", groups), ("FRONTIER", frontier), ("HELD_TERMS", 20)):
        monkeypatch.setattr(source_divergence, name, value)
    r = random.Random(15)
    vocabulary = [f"{a}{b}" for a in "abcdeéÉ" for b in "xyzXYZ"] + ["the", "ÑU", "ﬁn"]
    docs = [
        (r.choice(["en", "fr", None]), r.choice([f"s{k}" for k in range(9)] + [None]), " ".join(r.choice(vocabulary[: r.randrange(1, 46)]) for _ in range(r.randrange(40))))
        for _ in range(150)
    ]
    docs += [("en", "mute", None), ("en", "dry", "12 .. 3"), ("xx", "a", "only here"), ("xx", "b", ""), ("yy", "alone", "w w w")]
    docs += [("zz", f"t{k}", " ".join(f"{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvw'[j // 100]}" for j in range(260))) for k in range(4)]
    docs += [("zz", "t0", " ".join(f"{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvw'[j // 100]}" for j in range(250)))]
    df = spark.createDataFrame([(*d, k, 7) for k, d in enumerate(docs)], "lang string, source string, text string, doc_id int, n long")
    got = source_divergence.audit_sources(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == slow_audit(docs)
    assert any(x[4] == 0 and x[0] == "xx" for x in rows)
    assert source_divergence.audit_sources(df.limit(0)).count() == 0


def test_shares_of_large_counts():
    for count, total, terms in ((0, 0, 1), (10**13, 10**14, 7), (5, 10**14, 10**9), (10**14, 10**14, 1)):
        assert int(source_divergence.share(np.array([count]), np.array([total]), terms)[0]) == 1 + 10**9 * (count + 1) // (total + terms)


@pytest.mark.parametrize("frontier", [500_000, 30])
def test_tiles_like_all_cells(monkeypatch, frontier):
    """Every column in which one of two rows has a count is priced once, with one tree and with two."""
    monkeypatch.setattr(source_divergence, "FRONTIER", frontier)
    r = random.Random(16)
    for _ in range(40):
        columns, terms = r.randrange(1, 40), 50
        sides = []
        for _ in range(2):
            n = r.randrange(1, 9)
            dense = np.array([[r.choice([0, 0, 0, 1, 5]) for _ in range(columns)] for _ in range(n)])
            rows, across = np.nonzero(dense)
            sides.append((dense, (dense.sum(axis=1) + r.randrange(3), rows, across, dense[rows, across])))
        for other in (None, sides[1]):
            (a, left), (b, right) = sides[0], other or sides[0]
            got = {}
            for x, y, there, back, seen in source_divergence.tile_sums(left, other and right, columns, terms):
                got |= {(int(i), int(j)): (int(u), int(v), int(w)) for i, j, u, v, w in zip(x, y, there, back, seen)}
            for i in range(len(a)):
                for j in range(len(b)):
                    if other is None and j <= i:
                        assert (i, j) not in got
                        continue
                    p, q = (source_divergence.share(m[k], s[0][k], terms) for m, s, k in ((a, left, i), (b, right, j)))
                    on = (a[i] > 0) | (b[j] > 0)
                    want = (((p - q) ** 2 // q)[on].sum(), ((p - q) ** 2 // p)[on].sum(), on.sum())
                    assert got.get((i, j), (0, 0, 0)) == want
