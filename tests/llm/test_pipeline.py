"""The pipeline's stages on a small table with odd rows and clashing columns, each against a plain version."""

import random
import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from derivia.llm import jaccard, langid, linear, mixing, packing, quality, rules
from derivia.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, _times int, _row string, _rate double, node long, root long, length long"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    words = [rng.choice(["the", "of", "and", "to"]) if k % 4 == 1 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(30) * 'x'}"[:9] for k in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []

    def add(doc_id, text, lang="en", source="a"):
        rows.append((doc_id, text, lang, source, len(text or ""), False, 0.5, 3, "r", 9.0, 1, 2, 5))

    base = [prose(rng, rng.randrange(40, 120)) for _ in range(120)]
    for k, t in enumerate(base):
        add(k, t, "en" if k % 3 else "de")
    for k in range(20):  # exact and near copies
        add(200 + k, base[k])
        add(300 + k, base[k] + " tail")
    for k in range(30):
        add(400 + k, " ".join(w + "$#" for w in base[k].split()))
    for k in range(5):
        add(500 + k, "again and again we say it is so my friend " * 12)
    add(600, None), add(601, ""), add(602, " \n\t"), add(603, "short one"), add(604, prose(rng, 3000))
    add(None, base[0]), add(None, "nobody knows " + base[1][:200]), add(7, base[7]), add(8, prose(rng, 60))
    labels = [(k, 1, k % 10 == 0) for k in range(0, 120, 2)] + [(400 + k, 0, 0) for k in range(30)] + [(0, 1, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], LABELS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def repeats(words):
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)})


def measured(text):
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.split()]
    n = repeats(words)
    base = len(words) < 20 or 100 * n > 30 * len(words)
    signs = sum(c in rules.SYMBOLS for c in text or "")
    return base, (signs / max(1, sum(map(len, words))), (len(lines) - len(set(lines))) / max(1, len(lines)), n / max(1, len(words)))


def plain_cutoffs(trials, epsilon, alpha):
    """{stratum: (cutoff or None, ...)} from {doc_id: (stratum, shares)}."""
    strata = sorted({s for s, _ in trials.values()})
    out = {}
    for s in strata:
        own = [x for t, x in trials.values() if t == s]
        cuts = []
        for r in range(3):
            cut, p = None, epsilon / 3
            for g in rules.GRID:
                k = sum(x[r] > g for x in own)
                tail = sum(comb(len(own), j) * p**j * (1 - p) ** (len(own) - j) for j in range(k + 1))
                if tail > alpha / (3 * len(strata)):
                    break
                cut = g
            cuts.append(cut)
        out[s] = cuts
    return out


def test_cutoffs_and_verdicts_equal_brute_force(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        words = prose(rng, 30).split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 12] if k % 3 else [0, 3, 4, 4, 4, 12])):  # strata of their own kind
            words[rng.randrange(30)] = "$$$$"
        text = " ".join(words) + "\n" + "\n".join(["same line"] * rng.choice([0, 0, 1, 3]))
        rows.append((k, text, "en" if k % 3 else "de"))
        if k % 9 == 4:
            rows.append((k, text, "en" if k % 3 else "de"))  # the same document twice is one trial
        bad = "$$$$ $$" in text or words.count("$$$$") > 6
        labels += [(k, 0 if bad else 1, 0)] + [(k, 1, 0)] * (k % 5 == 0)
    docs, epsilon, alpha = spark.createDataFrame(rows, "doc_id long, text string, lang string"), 0.3, 0.2
    good = {a for a, q, _ in labels if q == 1} - {a for a, q, _ in labels if q == 0}
    trials = {}
    for k, text, lang in rows:
        base, shares = measured(text)
        if k in good and not base:
            trials[k] = (lang, shares)
    cuts = plain_cutoffs(trials, epsilon, alpha)
    assert any(c is not None for c in cuts["en"]) and any(c is not None for c in cuts["de"]) and cuts["en"] != cuts["de"]
    want = []
    for k, text, lang in rows:
        base, shares = measured(text)
        want.append((k, base, not base and not any(c is not None and x > c for c, x in zip(cuts[lang], shares, strict=True))))
    got = rules.judged(docs, spark.createDataFrame(labels, LABELS), epsilon=epsilon, alpha=alpha).select("doc_id", "base_failed", "kept")
    assert rows_of(got) == sorted(want, key=str)
    assert 0 < sum(not x[1] and not x[2] for x in want) < len(want)


def test_rules_stage_keeps_rows_whole(corpus):
    docs, labels = corpus
    kept = {r for r in rows_of(rules.accepted(docs, labels))}
    verdict = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in rules.judged(docs, labels).collect()}
    want = [r for r in rows_of(docs) if verdict[r[0], len((r[1] or "").split()), sum(map(len, (r[1] or "").split()))]]
    assert sorted(kept, key=str) == sorted(set(want), key=str)


def test_classifier_stage_keeps_what_the_query_keeps(corpus):
    docs, _ = corpus
    verdict = {(r["doc_id"], round(r["score"], 9)): r["kept"] for r in quality.scored(docs).collect()}
    kept = rows_of(quality.accepted(docs))
    assert len(kept) == sum(r["kept"] for r in quality.scored(docs).collect())
    assert all(any(v for (i, _), v in verdict.items() if i == r[0]) for r in kept)
    ids = {r[0] for r in kept}
    assert not ids & {600, 601, 602} and len(ids & set(range(120))) >= 114 and len(ids & set(range(400, 430))) <= 1


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_leave_one_of_each(corpus):
    docs, _ = corpus
    rows = rows_of(docs)
    s = [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    got = rows_of(jaccard.one_of_each(docs))
    left = list(rows)
    for r in got:
        left.remove(r)  # each is a row of the table, as often as there
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k) if s[k] else ("empty", k), []).append(r)
    for members in groups.values():
        stay = [r for r in got if r in members]
        ids = [r[0] for r in members if r[0] is not None]
        assert len(stay) == 1 and stay[0][0] == (min(ids) if ids else None)


def test_mixing_draws_by_the_rates_of_a_plain_descent(corpus, spark):
    docs, labels = corpus
    targets = {"clean": 0.7, "toxic": 0.2, "low": 0.1}
    domains = mixing.label_domains(labels)
    found = [r for r in mixing.mixed(docs, domains, targets, tokenizer=tokenizer_path()).collect()]
    n, p = np.array([r["n_tokens"] for r in found], float), np.array([[r[f"p_{d}"] for d in targets] for r in found])
    assert sorted(map(int, n)) == sorted(len(x) for x in packing.encoder(tokenizer_path())([r["text"] or "" for r in docs.select("text").collect()]))
    total, goal, mu = n.sum(), np.array(list(targets.values())), mixing.MU
    r = y = np.ones(len(n))
    for step in range(20_000):  # the same problem by plain projected gradient steps, document by document
        new = np.maximum(0, y - (p @ ((y * n) @ p / total - goal) + mu * (y - 1)) / (1 + mu))
        y = new + (step / (step + 3)) * (new - r)
        r = new
    r = np.where(n > 0, r, 1.0)
    assert (np.abs(np.array([x["rate"] for x in found]) - r) / np.maximum(1, r)).max() < 0.03  # what 40 steps leave
    cost = lambda q: 0.5 * ((((q * n) @ p / total - goal) ** 2).sum() + mu * (n / total * (q - 1) ** 2).sum())
    assert cost(np.array([x["rate"] for x in found])) <= cost(r) + 1e-4
    assert {x["domain"]: round(x["reached"], 2) for x in mixing.reached(spark.createDataFrame(found), targets).collect()}.keys() == targets.keys()
    drawn = rows_of(mixing.drawn(docs, domains, targets, tokenizer=tokenizer_path()))
    copies = {}
    for x in found:
        copies.setdefault(x["doc_id"], set()).add(x["copies"])
    want = [row for row in rows_of(docs) for _ in range(1 if row[0] is None else 0 if len(copies[row[0]]) > 1 else min(copies[row[0]]))]
    assert [x for x in drawn if x[0] is None or len(copies[x[0]]) == 1] == sorted(want, key=str)


def test_packing_columns_equal_a_plain_version(corpus):
    from tokenizers import Tokenizer

    docs, _ = corpus
    full, want = Tokenizer.from_file(tokenizer_path()), []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = packing.pack_documents(docs, tokenizer_path(), 256).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)


def test_packing_under_binding_document_and_attention_limits(spark):
    pieces = spark.range(600).select((F.col("id") % 7 * 9 + 3).cast("long").alias("length"), F.col("id").alias("_row"), F.lit("x").alias("_bin"))
    for rule in ("dot", "norm"):
        rows = packing.pack(pieces, 128, max_docs=6, max_attention=5000.0, rule=rule).collect()
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append(r["length"])
        assert len(rows) == 600 and sorted(r["_row"] for r in rows) == list(range(600))
        assert all(sum(x) <= 128 and len(x) <= 6 and sum(v * v for v in x) <= 5000 for x in by.values())
        assert any(len(x) == 6 for x in by.values()) and any(sum(v * v for v in x) > 4000 for x in by.values())


def test_em_equals_one_over_rows():
    rng = np.random.default_rng(4)
    k, n = 8, 3000
    good = rng.random(n) < 0.8
    v = np.where(rng.random((n, k)) < 0.3, 0, np.where(rng.random((n, k)) < np.linspace(0.6, 0.95, k), np.where(good, 2, 1)[:, None], np.where(good, 1, 2)[:, None]))
    pats, counts = np.unique(quality.pattern(v), return_counts=True)
    got, _ = quality.posteriors(dict(zip(pats.tolist(), counts.tolist(), strict=True)))
    p = (1.0 + (v == 2).sum(1)) / (2.0 + (v == 2).sum(1) + 3.0 * (v == 1).sum(1))
    for _ in range(200):
        before, z = p, np.log(np.clip(p.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(p.mean(), 1e-3, 1 - 1e-3))) * np.ones(n)
        for j in range(k):
            rate = {c: {x: 1.0 + w[v[:, j] == x].sum() for x in (1, 2)} for c, w in (("g", p), ("b", 1 - p))}
            for x in (1, 2):
                z[v[:, j] == x] += np.log(rate["g"][x] / (rate["g"][1] + rate["g"][2])) - np.log(rate["b"][x] / (rate["b"][1] + rate["b"][2]))
        p = 1 / (1 + np.exp(-z))
        if np.abs(p - before).max() < 1e-6:
            break
    assert np.abs(np.array([got[int(x)] for x in quality.pattern(v)]) - p).max() < 1e-4
    assert ((p > 0.5) == good).mean() > 0.95


def test_linear_model_is_the_minimum_of_its_loss():
    rng = np.random.default_rng(8)
    n, used = 400, 30
    rows, buckets = np.repeat(np.arange(n), 6), rng.integers(0, used, n * 6)
    values, targets = np.full(n * 6, 6**-0.5), rng.random(n)
    targets = np.stack([targets, 1 - targets], axis=1)
    w, b = linear.fitted(rows, buckets, values, targets, bits=5, steps=4000)
    p = linear.probabilities(rows, buckets, values, n, w, b)
    wrong = (p - targets) / n
    gradient = np.stack([np.bincount(buckets, values * wrong[rows, c], 32) for c in range(2)], axis=1) + 1e-4 * w
    assert np.abs(gradient).max() < 1e-4 and np.abs(wrong.sum(axis=0)).max() < 1e-4


def test_held_out_languages_against_a_plain_learner_and_no_leak(spark):
    rng = random.Random(6)
    words = {"en": ["the", "cat", "with", "house", "that", "morning"], "de": ["der", "hund", "nicht", "haus", "und", "morgen"], "ru": ["кот", "собака", "дом", "утро"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 30))), lang, lang) for k in range(150) for lang in [rng.choice(sorted(words))]] + [(900, None, "en", "x"), (901, "12 !", "de", "x"), (902, "the cat that", None, "x"), (902, "the cat that", None, "x")]
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    schema = "doc_id long, text string, lang string, source string"
    got = {r["doc_id"]: r for r in langid.held_out_languages(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["held_out"] for k, r in got.items()} == held
    # a plain learner: how often words were seen in a language
    seen = {}
    for k, text, lang, _ in rows:
        if not held[k] and lang and text:
            for w in text.split():
                seen.setdefault(w, {}).setdefault(lang, 0)
                seen[w][lang] += 1
    for k, text, _, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
        else:
            votes = {}
            for w in text.split():
                for lang in seen.get(w, {}):
                    votes[lang] = votes.get(lang, 0) + len(w)
            assert got[k]["lang_pred"] == max(votes, key=votes.get)
    other = [(k, t, "ru" if held[k] else lang, "other" if held[k] else s) for k, t, lang, s in rows]
    again = {r["doc_id"]: r for r in langid.held_out_languages(spark.createDataFrame(other, schema)).collect()}
    assert all(tuple(again[k]) == tuple(got[k]) for k in got)


def test_stages_run_on_an_empty_table(corpus, spark, tmp_path):
    docs, labels = corpus
    sf = str(tmp_path)
    labels.limit(0).write.parquet(f"{sf}/labels.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns, name


def test_the_pipeline_on_the_odd_table(corpus, spark, tmp_path):
    docs, labels = corpus
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and not ids & {200 + k for k in range(20)} and not ids & {600, 601, 602, 603}
