"""Hashed text features and a small linear model over them, trained on a bounded sample and applied to all rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from derivia.llm.common import LOWER, PLACED, U64, Words, mix, slices

BITS = 15
#: Entries of a matrix that one numpy step of a fit handles, so that its arrays stay in a core's cache.
BLOCK = 1 << 15


def byte_classes() -> np.ndarray:
    """Class of a byte in a word's shape: lower, upper, digit, beyond ASCII, or the sign itself."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[128:] = 4
    return out


CLASS = byte_classes()


def runs_hash(words: Words) -> np.ndarray:
    """A hash of each word's shape: its byte classes with runs taken as one."""
    if not len(words.starts):
        return np.zeros(0, U64)
    kind = CLASS.take(words.data)
    first = np.zeros(len(kind), bool)
    first[words.starts] = True
    fresh = first.copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(fresh & words.inside)  # where a run begins
    begin = np.flatnonzero(first[at])
    place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
    np.minimum(place, len(PLACED) - 1, out=place)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(PLACED.ravel().take(place * 256 + kind[at]), begin))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the rows' hashed features: lower-cased words, word shapes and pairs of shapes; values are roots of shares, so a row's norm is 1."""
    words = Words(column)
    shape, row = runs_hash(words), words.row
    words.data = LOWER[words.data]
    h = words.hashes()
    with np.errstate(over="ignore"):
        pair = mix(shape[:-1] * U64(3) + shape[1:] + (h[:-1] == h[1:]).astype(U64))
    same = row[:-1] == row[1:]
    parts = [(row, mix(h ^ U64(11))), (row, mix(shape ^ U64(12))), (row[1:][same], pair[same])]
    row = np.concatenate([p[0] for p in parts])
    bucket = np.concatenate([(p[1] >> U64(64 - bits)).astype(np.int64) for p in parts])
    key, count = np.unique(row.astype(np.int64) << bits | bucket, return_counts=True)
    row = key >> bits
    total = np.bincount(row, count, len(column))
    return row, key & ((1 << bits) - 1), np.sqrt(count / total[row])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def probabilities(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(n, classes) softmax scores."""
    return softmax(np.stack([np.bincount(row, value * weights[bucket, k], n) + bias[k] for k in range(len(bias))], axis=1))


class Sums:
    """Sums by group of value * x[at], for one x after another: the entries (group, at, value) are sorted by group once, and kept in the narrow types they come in."""

    def __init__(self, group: np.ndarray, at: np.ndarray, values: np.ndarray, groups: int):
        count = np.bincount(group, minlength=groups)
        if (group[1:] >= group[:-1]).all():
            self.at, self.values = at, values
        else:
            order = np.argsort(group, kind="stable")
            self.at, self.values = at[order], values[order]
        self.groups = groups
        self.some = np.flatnonzero(count)
        self.begin = np.append((np.cumsum(count) - count)[self.some], len(group))
        self.blocks = np.unique(np.append(np.searchsorted(self.begin, np.arange(0, len(group), BLOCK)), len(self.some)))

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.groups)
        for i, j in zip(self.blocks, self.blocks[1:], strict=False):
            a, b = self.begin[i], self.begin[j]
            part = x.take(self.at[a:b], mode="clip")  # all are in range, and clipping is faster than the check
            part *= self.values[a:b]
            out[self.some[i:j]] = np.add.reduceat(part, self.begin[i:j] - a)
        return out


def fitted(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, targets: np.ndarray, bits: int = BITS, steps: int = 150, l2: float = 1e-4, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft targets (n, classes) by accelerated full-batch gradient steps; the same rows give the same model."""
    n, k = targets.shape
    used = np.flatnonzero(np.bincount(buckets, minlength=1 << bits))
    place = np.zeros(1 << bits, np.uint16 if bits <= 16 else np.int32)
    place[used] = np.arange(len(used))
    local = place[buckets]
    by_row, by_bucket = Sums(rows, local, values, n), Sums(local, rows, values, len(used))
    w, b = np.zeros((k, len(used))), np.log(targets.mean(axis=0) + 1e-6)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        p = softmax(np.stack([by_row.of(w[c]) + b[c] for c in range(k)], axis=1))
        wrong = np.ascontiguousarray(((p - targets) / n).T)
        gw = np.stack([by_bucket.of(x) for x in wrong]) + l2 * w
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * wrong.sum(axis=1)
        w, b = w + vw, b + vb
    out = np.zeros((1 << bits, k))
    out[used] = w.T
    return out, b


def fit_on(sample: DataFrame, n_classes: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on the bounded rows sample(text, target array<double>) in one task; None where they are none.

    That task holds two orders of the entries and what they come in, about 40 bytes an entry at most.
    """
    kind = np.uint16 if bits <= 16 else np.uint32

    def hashed(batches):
        for batch in slices(batches):
            r, b, v = features(batch.column("text"), bits)
            at = np.searchsorted(r, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array([b[x:y].astype(kind).tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary()), pa.array([v[x:y].astype(np.float32).tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary()), batch.column("target")], ["b", "v", "target"])

    def fit(batches):
        parts, targets = [], []
        for batch in batches:
            parts += zip(batch.column("b").to_pylist(), batch.column("v").to_pylist(), strict=True)
            targets += batch.column("target").to_pylist()
        if parts:
            # in an order of their own, so that the model doesn't depend on how tasks were dealt
            order = sorted(range(len(parts)), key=lambda k: (zlib.crc32(parts[k][0]), len(parts[k][0]), tuple(targets[k])))
            buckets = np.frombuffer(b"".join([parts[k][0] for k in order]), kind)
            values = np.frombuffer(b"".join([parts[k][1] for k in order]), np.float32)
            rows = np.repeat(np.arange(len(order), dtype=np.int32), [len(parts[k][0]) // kind().itemsize for k in order])
            del parts, batch
            w, b = fitted(rows, buckets, values, np.array([targets[k] for k in order], float), bits)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(w).tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["w", "b"])

    found = sample.select("text", "target").mapInArrow(hashed, "b binary, v binary, target array<double>").repartition(1).mapInArrow(fit, "w binary, b binary").collect()
    return (np.frombuffer(found[0]["w"], float).reshape(1 << bits, n_classes), np.frombuffer(found[0]["b"], float)) if found else None
