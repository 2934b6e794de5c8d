"""Operators 11 to 13 against brute force, and on rows that are null, empty, tied, repeated or very long."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from derivia.llm import audit, pii, search
from derivia.llm.common import SLICE_BYTES

#: Columns beside the usual ones, some with names that the operators use themselves.
ODD = "doc_id long, text string, source string, n int, words int, t string, part string, term long, candidates int"


def odd_rows(rows):
    return [(*r, 1, 2, "t", "p", 3, 4) for r in rows]


# --- 11 -------------------------------------------------------------------------------------------


def audited(rows, labels):
    """Plain replay."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    flags = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        flags.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        shapley, rows_ = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                rows_[part, order, step] = [len(left), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[x] += len(gone)
        # what fails x and is neither removed here nor left was removed earlier
        out |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in rows_.items()}
    return out


def test_audit_equals_a_plain_replay(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows = []
    for k in range(150):
        t = " ".join(word() for _ in range(rng.choice([10, 49, 50, 120])))
        t = t.upper() if rng.random() < 0.2 else t
        t += rng.choice(["", "", " #", "\tx|y", " é\x0bé"])
        rows.append((k, t, rng.choice(["a", "b", None, ""])))
    rows += [(200, rows[3][1], "a"), (201, rows[3][1], "b"), (201, rows[3][1], "b"), (-5, rows[9][1], "a"), (None, rows[3][1], "a"), (None, None, None), (202, None, "a"), (203, "", None), (204, " \n", "c"), (205, "word " * (SLICE_BYTES // 2), "a")]
    labels = [(k, rng.randint(0, 1), int(rng.random() < 0.1)) for k in range(0, 210, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    docs, said = spark.createDataFrame(odd_rows(rows), ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.interaction_audit(docs, said).collect()}
    assert got == audited(rows, labels)
    assert audit.interaction_audit(docs.limit(0), said).count() == 0
    assert audit.interaction_audit(docs, said.limit(0)).groupBy().sum("good_lost", "toxic_lost").first()[:] == (0, 0)


# --- 13 -------------------------------------------------------------------------------------------

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in TERM.findall(t or "")]


def searched(rows, items, k):
    found = [(i, Counter(terms(t))) for i, t, *_ in rows if terms(t)]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(13)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 200]))), "a") for k in range(400)]
    rows += [(1000 - k, "rare Words w1-W2_x ünïcode", "a") for k in range(15)] + [(500, "rare", "a")] * 3 + [(None, "rare Words", "a"), (601, None, "a"), (602, " .,- ", "a"), (603, "w3 " * (SLICE_BYTES // 3 + 10), "a")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30])))) for k in range(40)] + [(50, "RARE Ünïcode words"), (51, "rare"), (52, None), (53, "?!"), (54, "nowhere"), (55, "w1"), (55, "w2 w2"), (None, "rare")]
    return rows, items


def test_search_equals_brute_force(spark, library):
    rows, items = library
    docs = spark.createDataFrame(odd_rows(rows), ODD).repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int")
    want = searched(rows, items, 10)
    assert sorted(map(tuple, search.ranked(docs, asked).collect())) == want
    # many blocks of items
    assert sorted(map(tuple, search.ranked(docs, asked, block_pairs=60).collect())) == want
    assert search.ranked(docs.limit(0), asked).count() == 0 and search.ranked(docs, asked.limit(0)).count() == 0


def test_search_stops_early_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(5)
    n, vocabulary = 3000, 50
    per = rng.integers(5, 30, n)
    rows = np.concatenate([[0], np.cumsum(per)])
    term = np.concatenate([rng.choice(vocabulary, p, replace=False) for p in per])
    part = rng.integers(1, 500_000, len(term))
    weights = rng.integers(0, 4000, vocabulary)
    weights[7] = 9000
    shard = search.Shard(np.arange(n), rows, term.astype(np.int32), part, vocabulary)
    full = []
    monkeypatch.setattr(search.Shard, "full", lambda self, doc, t, w, f=search.Shard.full: full.append(doc) or f(self, doc, t, w))
    stopped = 0
    for _ in range(60):
        asked = np.append(rng.choice(vocabulary, 6, replace=False), 7)
        asked = np.unique(asked)
        exact = np.zeros(n, np.int64)
        for d in range(n):
            own = slice(rows[d], rows[d + 1])
            exact[d] = (weights[term[own]] * part[own])[np.isin(term[own], asked)].sum()
        full.clear()
        found, scores = shard.best(asked, weights, 10, 0)
        stopped += bool(full)
        assert (exact[found] == scores).all()
        tenth = np.sort(exact)[-10]
        assert set(np.flatnonzero((exact >= tenth) & (exact > 0))) <= set(found.tolist())
        # a bound from elsewhere leaves out nothing that reaches it
        found, _ = shard.best(asked, weights, 10, int(tenth))
        assert set(np.flatnonzero(exact >= max(tenth, 1))) <= set(found.tolist())
    assert stopped > 10


# --- 12 -------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def with_luhn(rng, n):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, [*d, c])) for c in range(10) if fine("card", "".join(map(str, [*d, c]))))


@pytest.fixture(scope="module")
def private():
    rng = random.Random(12)
    card = lambda: with_luhn(rng, rng.choice([16, 19]))
    spaced = lambda c: " ".join(c[k : k + 4] for k in range(0, len(c), 4))
    forms = [lambda: f"a.b{rng.randrange(99)}@mail.host-{rng.randrange(9)}.com", lambda: "x@y", lambda: "a@b.c_d@e.f@g.h", lambda: f"{rng.randrange(300)}.0{rng.randrange(300)}.7.{rng.randrange(256)}", lambda: "1.2.3.4.5.6.7.8", lambda: card(), lambda: spaced(card()), lambda: "4" + card(), lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(999)}) {rng.randrange(9999)}-{rng.randrange(9999)}", lambda: "+1 2", lambda: "+1((((", lambda: "1-2 3--4", lambda: "é@ü.com +12345678", lambda: "ordinary words", lambda: "v2.0.1"]
    rows = [(k, rng.choice([" ", "\n", "", "é😀 "]).join(rng.choice(forms)() for _ in range(rng.randrange(8))), "a") for k in range(400)]
    rows += [(500, None, "a"), (501, "", "a"), (502, " \n", "a"), (503, rows[7][1], "a"), (503, rows[7][1], "a"), (None, rows[7][1], "a"), (504, "é a1@b.com" * 700 + "x " * SLICE_BYTES, "a"), (505, "1" * 2_000 + "@" * 9 + "a" * 2_000 + ".1" * 2_000, "a")]
    return rows


def test_base_spans_equal_plain_patterns(spark, private):
    got = pii.personal(spark.createDataFrame(odd_rows(private), ODD)).collect()
    assert len(got) == len(private)
    want = []
    for i, t, _ in private:
        found = base(t)
        want.append((i, *[sum(k == x[0] for x in found) for k in PLAIN], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], key=order) == sorted(want, key=order)
    texts = {i: t or "" for i, t, _ in private}
    for r in got:
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
        kept = base(texts[r["doc_id"]])
        assert set(kept) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
        for k, a, b in set(spans) - set(kept):
            assert not any(x < b and a < y for _, x, y in kept)
    assert pii.personal(spark.createDataFrame([], ODD)).count() == 0
    # runs that a plain search tries from each of their places: in proportion to the text here
    runs = "a" * 1_000_000 + " " + "1" * 1_000_000 + " a@b.com"
    assert pii.base_only(spark.createDataFrame([(1, runs)], "doc_id long, text string")).first()["n_email"] == 1
    plain = pii.personal(spark.createDataFrame([(1, "no such thing", "a")], "doc_id long, text string, source string")).first()
    assert plain["spans"] == "" and plain["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_the_fit_adds_other_forms_and_leaves_numbers_alone(spark):
    rng = random.Random(7)
    rows, kinds = [], {}
    for k in range(900):
        area, a, b = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        form = k % 6
        cue = rng.choice(["call", "phone", "tel."])
        text, kind = [(f"please {cue} +49 ({area}) {a}-{b} today", "base"), (f"please {cue} ({area}) {a}-{b} today", "phone"), (f"order {a}{b}{area} was sent", None), (f"write to m{k}@host{k % 7}.com soon", "base"), (f"write to m{k} (at) host{k % 7} (dot) com soon", "email"), (f"section {a}{b}{area}{b} of the index", None)][form]
        rows.append((k, text))
        kinds[k] = kind
    got = {r["doc_id"]: r for r in pii.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = lambda kind: [kind in got[k]["spans"] and hashlib.sha256(got[k]["spans"].encode()).hexdigest() != got[k]["base_sha256"] for k, x in kinds.items() if x == kind]
    assert np.mean(added("phone")) > 0.95 and np.mean(added("email")) > 0.95
    assert all(got[k]["spans"] == "" for k, x in kinds.items() if x is None)


def test_em_finds_reliable_labellers():
    rng = random.Random(3)
    rates = [0.95, 0.9, 0.8, 0.7, 0.6, 0.9]
    counts, truth = Counter(), {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = [(2 if (rng.random() < r) == y else 1) if rng.random() < 0.8 else 0 for r in rates]
        p = sum(v * 3**k for k, v in enumerate(votes))
        counts[p] += 1
        truth.setdefault(p, []).append(y)
    got = pii.posteriors(dict(counts))
    assert sum((got[p] > 0.5) == y for p, ys in truth.items() for y in ys) / 20_000 > 0.94
    error = sum(len(ys) * abs(got[p] - sum(ys) / len(ys)) for p, ys in truth.items() if len(ys) > 100) / sum(len(ys) for ys in truth.values() if len(ys) > 100)
    assert error < 0.05


def test_sums_before_are_exact_over_many_runs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 5000)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", pii.sums_before(F.col("a")).alias("b")).collect():
        assert r["b"] == list(itertools.accumulate(r["a"], initial=0))[: len(r["a"])]
