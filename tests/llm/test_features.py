"""Hashed features and the fit of op3 and op7 against plain versions, and what they take of memory and CPU."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from derivia.llm import linear
from derivia.llm.common import BYTE_KEY, LOWER, PLACE_KEY, Words, mix

MASK = (1 << 64) - 1
ODD = [None, "", " ", "The cat's 12 CATS, the\tcat", "x" * 64 + " " + "y" * 65 + " " + "Ab1é," * 300, "a", "", "Ünï ☃☃ AB12-cd\n\nab", "\t\n", "z"]


def mixed(x):
    return int(mix(np.array([x & MASK], np.uint64))[0])


def word_hash(word):
    keys = [int(PLACE_KEY[i]) if i < len(PLACE_KEY) else mixed(i * 0xD1B54A32D192ED03) | 1 for i in range(len(word))]
    return mixed(sum(int(BYTE_KEY[b]) * k for b, k in zip(word, keys, strict=True)) ^ (len(word) * 0x9E3779B97F4A7C15 & MASK))


def shape_hash(word):
    kinds = [int(linear.CLASS[b]) for b in word]
    runs = [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]
    return mixed(sum(int(BYTE_KEY[k]) * int(PLACE_KEY[min(i, len(PLACE_KEY) - 1)]) for i, k in enumerate(runs)))


def test_features_of_odd_texts_equal_a_plain_version():
    row, bucket, value = linear.features(pa.array(ODD))
    got = {(int(r), int(b)): float(v) for r, b, v in zip(row, bucket, value, strict=True)}
    want = {}
    for k, text in enumerate(ODD):
        words = (text or "").encode().split()
        lower = [word_hash(bytes(LOWER[list(w)])) for w in words]
        shape = [shape_hash(w) for w in words]
        found = [mixed(h ^ 11) for h in lower] + [mixed(s ^ 12) for s in shape]
        found += [mixed(shape[i] * 3 + shape[i + 1] + (lower[i] == lower[i + 1])) for i in range(len(words) - 1)]
        for h in found:
            want.setdefault((k, h >> 64 - linear.BITS), []).append(len(found))
    assert got.keys() == want.keys() and all(abs(got[x] - (len(n) / n[0]) ** 0.5) < 1e-12 for x, n in want.items())


def test_word_and_shape_hashes_take_memory_by_words():
    words = Words(pa.array(["abcdefghijklmnopqrstuvwxyz012345 " * 8192]))
    n = len(words.data)
    for made in (words.hashes, lambda: linear.runs_hash(words)):
        tracemalloc.start()
        made()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * n  # less than two numbers for each byte


def plain_fit(rows, buckets, values, targets, steps, l2=1e-4, rate=4.0):
    n, k = targets.shape
    used, local = np.unique(buckets, return_inverse=True)
    w, b = np.zeros((len(used), k)), np.log(targets.mean(axis=0) + 1e-6)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        wrong = (linear.probabilities(rows, local, values, n, w, b) - targets) / n
        gw = np.stack([np.bincount(local, values * wrong[rows, c], len(used)) for c in range(k)], axis=1) + l2 * w
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * wrong.sum(axis=0)
        w, b = w + vw, b + vb
    return used, w, b


def test_fit_equals_a_plain_one_in_less_cpu():
    rng = np.random.default_rng(4)
    n, each = 6000, 200
    rows = np.repeat(np.arange(n), each)
    rows = rows[(rows % 7 > 0) | (rng.random(len(rows)) < 0.01)]  # rows of few entries, or of none
    rows = rows[rows != 14]
    buckets = (rng.random(len(rows)) ** 2 * (1 << linear.BITS)).astype(np.int64)
    values, targets = rng.random(len(rows)) * 0.1, np.eye(3)[rng.integers(0, 3, n)]
    took = {"new": [], "plain": []}
    for _ in range(2):
        began = time.process_time()
        used, w, b = plain_fit(rows, buckets, values, targets, 20)
        took["plain"].append(time.process_time() - began)
        began = time.process_time()
        got, bias = linear.fitted(rows, buckets, values, targets, steps=20)
        took["new"].append(time.process_time() - began)
    assert np.abs(got[used] - w).max() < 1e-12 and np.abs(bias - b).max() < 1e-12 and not np.delete(got, used, axis=0).any()
    assert min(took["new"]) < 0.85 * min(took["plain"])
    none = np.zeros(0, np.int64)
    got, bias = linear.fitted(none, none, np.zeros(0), targets[:5], steps=3)
    assert not got.any() and got.shape == (1 << linear.BITS, 3)


class Here:
    """As much of a DataFrame as linear.fit_on takes, run in this process."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *names):
        return self

    def repartition(self, n):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return Here(f(self.batches))

    def collect(self):
        return [r for batch in self.batches for r in batch.to_pylist()]


def test_the_task_of_a_fit_takes_memory_by_narrow_entries():
    rng = np.random.default_rng(5)
    words = np.array([f"{'ab'[k % 2]}{k}" for k in range(20000)])
    texts = [" ".join(words[rng.integers(0, len(words), 500)]) for _ in range(1500)]
    column = pa.array([None, "", *texts, *ODD[2:]])
    targets = pa.array([[1.0, 0.0] if k % 3 else [0.25, 0.75] for k in range(len(column))], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([column, targets], ["text", "target"])
    entries = len(linear.features(column)[0])
    tracemalloc.start()
    w, b = linear.fit_on(Here([batch.slice(0, 700), batch.slice(700)]), 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries > 500_000 and most < 60 * entries, most / entries
    # however the rows come, the model is the same, and that of wide numbers
    again = linear.fit_on(Here([batch.slice(900), batch.slice(0, 900)]), 2)
    assert (w == again[0]).all() and (b == again[1]).all()
    row, bucket, value = linear.features(column)
    narrow = linear.fitted(row.astype(np.int32), bucket.astype(np.uint16), value.astype(np.float32), np.array(targets.to_pylist()), steps=9)
    wide = linear.fitted(row, bucket, value.astype(np.float32).astype(float), np.array(targets.to_pylist()), steps=9)
    assert (narrow[0] == wide[0]).all() and (narrow[1] == wide[1]).all()
