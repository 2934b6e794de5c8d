"""The numbered operators on small made-up tables: brute force, round trips, and rows that are null, empty, tied or repeated."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from derivia.llm import hilbert, jaccard, langid, mixing, packing, perspectives, quality, rollup, rules, warc
from derivia.llm.registry import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, extra int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = sentence(rng, 60)
    rows = [(1, base, "en", "a", 0), (2, base, "en", "a", 0), (3, base + " more", "en", "a", 0), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 0), (7, "one two", "en", "a", 0), (7, "one two", "en", "a", 0), (None, base, "en", "a", 0), (8, sentence(rng, 30_000, 20_000), "en", "b", 1)]
    rows += [(20 + k, sentence(rng, 40), "en", "a", 0) for k in range(10)]
    # a large family: every copy has its own edits, some too many to link
    words = base.split()
    for k in range(150):
        w = list(words)
        for at in rng.sample(range(60), k % 4):
            w[at] = f"x{k}_{at}"
        rows.append((100 + k, " ".join(w), "en", "a", 0))
    return spark.createDataFrame(rows, DOC)


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_groups_equal_brute_force(odd):
    rows = [(r["doc_id"], shingles(r["text"])) for r in odd.where("doc_id is not null").collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = jaccard.groups_of(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, find(i)) for i in root}
    assert jaccard.groups_of(odd.limit(0)).count() == 0
    kept = [r["doc_id"] for r in jaccard.one_of_each(odd).select("doc_id").collect()]
    assert kept.count(7) == 1 and 2 not in kept and {1, 4, 5, 6, 8} <= set(kept)


def test_warc_round_trip_and_damage(spark, tmp_path):
    rng = random.Random(1)
    long_ = sentence(rng, 400)
    rows = [(k, f"http://h/{k}", long_ if k % 3 == 0 else sentence(rng, 50 + k)) for k in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "short"), (53, "u", "short")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == {r[0] for r in rows} and all(r["error"] is None for r in got.values())
    for k, _, html in rows:
        revisit = html == long_ and k != 39
        assert got[k]["record_type"] == ("revisit" if revisit else "response") and got[k]["refers_to"] == (39 if revisit else None)
        assert revisit or bytes(got[k]["payload"]) == (html or "").encode()
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2020-01-01\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")


def test_warc_archives_roll_and_keep_repeated_pages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", sentence(rng, 500)) for k in range(200)] + [(7, "again", None), (7, "again", None), (None, None, "x" * 3000), (None, "u", "x" * 3000), (300, "u", "x" * 3000), (300, "v", "x" * 3000)]
    pages = spark.createDataFrame([(*r, 1, "clash") for r in rows], "page_id long, url string, html string, payload int, error string")
    path = str(tmp_path / "w")
    warc.write_archives(pages.repartition(2), path, archive_bytes=40_000)
    got = warc.read_archives(spark, path).collect()
    per = {}
    for r in got:
        per.setdefault(r["archive"], []).append(r["payload_bytes"])
    assert len(per) > 8 and all(sum(x) - x[-1] < 50_000 for x in per.values())
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted([(r["page_id"], r["url"], r["payload_bytes"]) for r in got], key=key) == sorted([(a, b, len(c or "")) for a, b, c in rows], key=key)
    twins = [r for r in got if r["payload_bytes"] == 3000]
    assert sorted((r["record_type"], r["refers_to"]) for r in twins if r["page_id"] is None) == [("revisit", 300)] * 2
    assert [(r["record_type"], r["refers_to"]) for r in twins if r["page_id"] == 300] == [("response", None)] * 2

    empty = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_streams_long_files_and_bounds_records(spark, tmp_path):
    import zstandard

    rng = random.Random(8)
    rows = [(k, f"http://h/{k}", sentence(rng, 300)) for k in range(300)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    fields = ["page_id", "url", "record_type", "payload_digest", "payload", "error", "archive", "position"]
    read = lambda **o: sorted(map(tuple, warc.read_archives(spark, path, **o).select(*fields).collect()), key=str)
    assert len(read()) == 300 and read(cell_bytes=1000) == read()
    # small frames that hold much
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "bomb.zst").write_bytes(pack(record()) + pack(b"0" * 5_000_000) + pack(record(ident="<urn:page:2>")))
    for o in ({}, {"cell_bytes": 10}):
        got = {r["position"]: (r["page_id"], r["error"]) for r in warc.read_archives(spark, str(tmp_path / "z"), record_bytes=1_000_000, **o).collect()}
        assert sorted(got.values(), key=str) == [(1, None), (2, None), (None, "a record of more than 1000000 bytes")]


def record(date="2020-01-01T00:00:00Z", ident="<urn:page:1>", kind="response", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, "Content-Length": "20", **{k.replace("_", "-"): v for k, v in more.items()}}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n").encode()


def test_warc_damage_becomes_rows(spark, tmp_path):
    import struct

    import zstandard

    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    good = pack(record())
    broken = bytearray(good)
    broken[-1] ^= 1
    lead = lambda x: struct.pack("<II", warc.DICT_FRAME_MAGIC, len(x)) + x
    huge = "9" * 20
    files = {
        "whole": (good + pack(record(ident="<urn:page:2>")), [None, None]),
        "cut": (good + good[:-3], [None, "truncated frame"]),
        "sum": (bytes(broken), ["bad frame"]),
        "foreign": (b"GIF89a, and so on", ["not a Zstandard frame"]),
        "late": (good + lead(b"d" * 16) + good, [None, "a dictionary frame that doesn't lead", None]),
        "dictionary": (lead(struct.pack("<I", warc.ZSTD_MAGIC) + b"no frame") + good, ["bad dictionary"]),
        "skip": (good + struct.pack("<II", 0x184D2A50, 99) + b"x", [None, "truncated skippable frame"]),
        "long": (pack(record(WARC_Payload_Length=huge)) + pack(record(ident=f"<urn:page:{huge}>")), ["bad payload length", None]),
        "date": (pack(record(date="yesterday")) + pack(record(kind="revisit")), ["bad warc-date", "a revisit without a profile"]),
        "head": (pack(b"WARC/1.1\r\n") + pack(record().replace(b"1.1", b"9.9", 1)) + pack(record(WARC_Payload_Digest="md5:00")), ["the header has no end", "unknown version line", "unknown digest"]),
        "empty": (b"", []),
        "large": (good * 40, [None] * 40),
    }
    for name, (content, _) in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in warc.read_archives(spark, str(tmp_path), cell_bytes=len(good) * 39).orderBy("archive", "position").collect():
        got.setdefault(r["archive"].rsplit("/", 1)[1], []).append(r)
    for name, (_, errors) in files.items():
        found = [r["error"] for r in got.get(name, [])]
        assert len(found) == len(errors) and all((a is None) == (b is None) and (b is None or a.startswith(b)) for a, b in zip(found, errors, strict=True)), (name, found)
    assert [r["page_id"] for r in got["whole"]] == [1, 2] and got["long"][1]["page_id"] is None


def test_rules_count_as_brute_force(odd):
    def repeats(words):
        seen = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)})

    twice = odd.union(odd.sparkSession.createDataFrame([(900, "a b c d e f g h i\n" * 3, "en", "a", 0)], DOC))
    for r in rules.word_stats(twice.select("doc_id", "text", F.col("text").alias("t"))).collect():
        words = (r["t"] or "").split()
        lines = [x for x in (r["t"] or "").split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeats(words))


def test_binomial_tail_is_exact(spark):
    from math import comb

    for k, n, p in ((0, 300, 0.02), (3, 500, 0.02), (40, 9000, 0.01), (12, 19, 0.9)):
        got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-6)


def test_binomial_tail_has_all_terms_of_large_counts(spark):
    from math import exp, fsum, lgamma, log

    # just below the mean thousands of terms count
    for k, n, p in ((26_700, 4_000_000, 0.0067), (26_000, 4_000_000, 0.0067), (30_000_000, 60_001_000, 0.5)):
        start = 0 if k < 100_000 else k - 60_000
        want = fsum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(start, k + 1))
        got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-5)


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:100] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (1004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert.neighbours(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((v for v in range(300) if v != q), key=lambda v: (-round(s[v], 9), v))[:5]
        assert [v for _, v in sorted(got[q])] == want
    assert set(got) == set(range(0, 300, 20))


def test_neighbours_widen_their_windows_to_the_target(spark):
    # 3 blocks of 16 rows on 2 curves hold 96 of 3000 rows: windows of a fixed size lose most neighbours of vectors without structure
    x = np.random.default_rng(1).normal(size=(3000, 32)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert.neighbours(df, F.col("vec_id") % 20 == 0, 5, curves=2, block=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (150 * 5) >= 0.95


def test_long_vectors_do_not_widen_the_windows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + rng.normal(scale=0.3, size=(2000, 16))
    far = x.copy()
    far[7] *= 50
    far[[30, 31]] *= 1e150
    far[300:500] /= 40
    widths, real = [], hilbert.fitted
    monkeypatch.setattr(hilbert, "fitted", lambda *a: widths.append(real(*a)) or widths[-1])
    for rows in (x, far):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
        got = {}
        for r in hilbert.neighbours(df, F.col("vec_id") % 20 == 0, 5, block=32).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, 2000, 20):
            s = rows @ rows[q]
            s[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        assert hits / (100 * 5) >= 0.9
    assert widths[1][0] * (2 * widths[1][1] + 1) <= widths[0][0] * (2 * widths[0][1] + 1)


def test_length_classes():
    assert hilbert.length_classes([(0, 1, 9.0), (1, 2, 2.0), (3, 90, 0.5), (4, 3, 0.1), (1000, 8, 0.0)], 10) == ({0: 0, 1: 0, 3: 1, 4: 2, 1000: 2}, [9.0, 0.5, 0.1])


def test_no_cell_of_a_log_normal_table_holds_more_than_its_bound(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) * np.exp(rng.normal(scale=0.6, size=3000))[:, None]
    x[:20] *= 60
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, real = [], hilbert.dealt

    def spy(placed, radius):
        cells = real(placed, radius, 100)
        seen.append((radius, cells.groupBy("curve", "block", "salt").agg(F.sum(F.col("is_query").cast("int")).alias("q"), F.sum((~F.col("is_query")).cast("int")).alias("n")).collect(), placed.where("is_query").groupBy("curve").count().collect()))
        return cells

    monkeypatch.setattr(hilbert, "dealt", spy)
    got = {}
    for r in hilbert.neighbours(df, F.col("vec_id") % 3 == 0, 5, curves=3, block=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    radius, cells, queries = seen[0]
    curves = {r["curve"] for r in queries}
    assert len(curves) >= 6 and all(r["count"] == 1000 for r in queries)  # every query is on every curve of every class
    assert max(r["q"] for r in cells) < 200  # 100 on average, dealt by a hash
    assert all(sum(r["q"] for r in cells if r["curve"] == c) == 1000 * (2 * radius + 1) for c in curves)
    hits = 0
    for q in range(0, 3000, 30):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 500


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, v int, rep string, curve int, asked boolean"
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist(), 1, "x", 2, True) for k in range(60)]
    rows += [rows[20], rows[20], rows[40], (None, [1.0] * 4, 1, "x", 2, True), (70, None, 1, "x", 2, True), (71, [], 1, "x", 2, True), (72, [0.0] * 4, 1, "x", 2, True), (73, [float("nan")] * 4, 1, "x", 2, True), (80, [1.0, 2.0], 1, "x", 2, True), (81, rows[20][1], 1, "x", 2, True)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, hilbert.neighbours(df, F.col("vec_id") % 20 == 0, 5).collect()))
    x = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[0] is not None and r[1] and len(r[1]) == 4 and r[0] not in (72, 73)}
    want = []
    for q in (0, 20, 40):
        near = sorted((-float(x[q] @ y), i) for i, y in x.items() if i != q)[:5]
        want += [(q, k, i) for k, (_, i) in enumerate(near, 1)]
    assert [g[:3] for g in got] == want
    assert hilbert.neighbours(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(3)
    clean = [(k, ". ".join("The " + sentence(rng, 9) + " of it" for _ in range(8)) + ".") for k in range(200)]
    junk = [(1000 + k, " ".join(w + "$$$" for w in sentence(rng, 80).split())) for k in range(40)] + [(2000, None), (2001, "")]
    got = {r["doc_id"]: r["kept"] for r in quality.scored(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert sum(got[k] for k, _ in clean) >= 198 and not any(got[k] for k, _ in junk)


def test_mixing_meets_its_targets(spark):
    p = [[0.9, 0.1]] * 60 + [[0.2, 0.8]] * 40
    members = spark.createDataFrame([(k, 100, x) for k, x in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    rows = mixing.rates(members, [0.4, 0.6]).collect()
    total = np.array([r["rate"] * 100 * np.array(r["p"]) for r in rows]).sum(0)
    assert total / 10_000 == pytest.approx([0.4, 0.6], abs=0.01) and min(r["rate"] for r in rows) >= 0


def test_language_spans_and_undetermined(spark):
    docs = [(k, "the cat and the dog with that", "en") for k in range(8)] + [(10 + k, "der hund und die katze mit nicht", "de") for k in range(8)] + [(20 + k, "кот и собака", "ru") for k in range(8)]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the dog and the cat with that der hund und die katze mit nicht die katze"), (2, "собака"), (3, None), (4, "12 34 !"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.labelled(test, model, spans=True).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and got[1]["lang_pred"] == "de" and got[2]["lang_pred"] == "ru"
    assert {got[k]["lang_pred"] for k in (3, 4, 5)} == {"und"}


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    score = rng.normal(size=(11, 3)) * 3
    path = langid.viterbi(score, np.array([0, 5, 5]), np.array([5, 0, 6]), 2.0)
    for a, n in ((0, 5), (5, 6)):
        cost = lambda s: sum(score[a + t, x] for t, x in enumerate(s)) - 2.0 * sum(x != y for x, y in zip(s, s[1:], strict=False))  # noqa: B023, E731
        assert cost(path[a : a + n]) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=n))))


def test_many_languages_are_counted_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"l{k:03d}": ["".join(rng.choice(letters, 7)) for _ in range(12)] for k in range(300)}
    rows = [(k, " ".join(words[x]), x) for k, x in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table, allowed = langid.learn(docs)
    assert names == sorted(words) and table.shape == (langid.GRAMS, 300)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.labelled(docs, (names, table, allowed)).collect()}
    assert got == {k: x for k, _, x in rows}
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 1000)
    whole = langid.learn(docs)
    assert names == whole[0] and (table == whole[1]).all() and (allowed == whole[2]).all()


def test_word_scores_of_long_texts_and_words_come_in_parts():
    import pyarrow as pa

    runs = langid.Runs(pa.array(["ein Wort " * 50, "x" * 3000 + " und noch eins", "", "a"]))
    table = np.random.default_rng(1).normal(size=(langid.GRAMS, 3)).astype(np.float32)
    exact = np.add.reduceat(table[runs.gram].astype(np.float64), runs.begin, axis=0)
    for most in (1, 2, 7, 100, 10_000):
        assert np.allclose(langid.word_scores(table, runs, most), exact, rtol=1e-4, atol=1e-4)
    assert (langid.word_scores(table, runs, 1 << 20) == np.add.reduceat(table[runs.gram], runs.begin, axis=0)).all()


def test_packing_is_whole_gapless_and_tight(odd):
    rows = packing.pack_documents(odd.where("doc_id is not null"), tokenizer_path(), 1024).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    encode = packing.encoder(tokenizer_path())
    want = sum(len(x) + 1 for x in encode([r["text"] or "" for r in odd.where("doc_id is not null").collect()]))
    assert sum(r["length"] for r in rows) == want and len(by) <= want // 1024 + 3


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(9)
    signs = "abcXYZ019 \t\n\r\x0b\x85\xa0'’.,-_$<|>éßııЖ中語ก\u2028\u3000\u200b😀İſ½²"
    texts = ["", "it's we'LL I'M", "<|endoftext|> a<|endoftext|>", "  two  spaces \n\n x", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000))]
    want = [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(tokenizer_path())(texts) == want


def test_ranks_come_from_several_runs(odd, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 7)
    pieces = odd.sparkSession.range(500).select((F.col("id") % 3 * 100 + 24).alias("length"))
    rows = packing.pack(pieces, 1024).collect()
    assert len(rows) == 500 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


def test_best_fit_keeps_every_capacity():
    for rule in ("dot", "norm"):
        for bins, content in packing.best_fit({9: 7, 5: 11, 2: 30, 1: 4}, (16.0, 4.0, 100.0), rule):
            assert bins and sum(a * m for a, m in content) <= 16 and sum(m for _, m in content) <= 4 and sum(a * a * m for a, m in content) <= 100


def test_rotation_masks_the_speaker(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob", None), (1, 2, "Ann", "so"), (None, 0, None, "x"), (2, 0, "system", "alone")]
    got = perspectives.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=2).collect()
    for r in got:
        for span in filter(None, r["mask"].split(",")):
            a, b = map(int, span.split("-"))
            assert r["text"][:a].endswith("<|assistant|>\n") and r["text"][a:b].endswith("<|end|>\n")
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "Ann"), (1, "Bob"), (None, "unknown"), (2, None)}
    assert sum(r["n_turns"] for r in got if r["perspective"] == "Ann") == 4


def test_rollup_commits_once(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    first = spark.createDataFrame([("insert", "a", "en", "t1", 10, None), ("insert", "a", None, "t1", 5, None), ("insert", "a", "en", "t1", None, None)], schema)
    then = spark.createDataFrame([("revise", "a", "en", "t1", 12, 10), ("delete", "a", None, "t1", 5, None)], schema)
    assert r.commit("b1", first) and not r.commit("b1", first) and r.commit("b2", then)
    want = [("a", "en", "t1", 2, 12)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == want and not r.commit("b2", then)


def test_token_rollup_equals_a_plain_count(odd, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    # repeated rows, nulls, an empty and a very long text, text beyond ASCII, a special token's string, extra columns of our own names
    more = odd.sparkSession.createDataFrame([(900, "наука и жизнь " * 20, "ru", "a", 0), (901, "<|endoftext|> <s> " * 15, "en", None, 0), (902, "x" * 40_000, "en", "b", 0), (903, "語" * 300 + " a" * 30, None, "b", 0)], DOC)
    docs = odd.union(more).selectExpr("*", "1 as n", "2 as n_words", "3 as tokens", "'delete' as op")
    bpe, piece = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        if len(text.split()) >= 20:
            for version, n in (("bpe", len(bpe.encode(text, add_special_tokens=False).ids) + 1), ("piece", len(piece.encode(text)))):
                total = want.setdefault((r["source"], r["lang"], version), [0, 0])
                total[0] += 1
                total[1] += n
    files = {"bpe": tokenizer_path(), "piece": tokenizer_path("piece_bpe_32k.model")}
    got = rollup.document_rollup(docs, files, str(tmp_path / "r")).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in got} == want and len(got) == len(want)
    assert rollup.document_rollup(docs.limit(0), files, str(tmp_path / "none")).count() == 0


def test_operators_take_empty_tables(odd):
    none = odd.limit(0)
    labels = odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(none).count() == 0 and rules.judged(none, labels).count() == 0
    assert mixing.mixed(none, mixing.label_domains(labels), {"clean": 1.0}).count() == 0
    assert langid.held_out_languages(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
