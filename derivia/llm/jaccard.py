"""N-gram Jaccard join by T-occurrence search in the manner of DivideSkip, and the groups that its links form.

Two documents link when their sets of word shingles have a Jaccard similarity of at least 75/100, that
is when they share T = ceil(3 (n1 + n2) / 7) shingles. DivideSkip merges a document's short inverted
lists, so that a partner must occur T - L times there, and looks up the L long ones by binary search.
Spread over a cluster:

1. One pass gives every document the hash of its set, so that equal sets are one node, and counts
   shingles in a sketch of fixed size. A shingle whose cell is far above the mean is *long*, all others
   are *short*. Any split gives the same links; the sketch decides only how much work they take. It has
   16 cells for each document up to 2 ** 24; beyond a million documents the mean grows, and what counts
   as short grows with its square root.
2. All shingles have one order: short ones first, by hash, then long ones, the rarer first. A node posts
   its first n - ceil(0.75 n) + 1 in that order. Two linked nodes share the first of their common
   shingles there, so no link is lost. The short lists are merged in buckets of a bounded size (by
   sorting, which takes all entries of a heap at once), occurrences are added up, and pairs that can't
   reach T with all that wasn't merged fall out.
3. The survivors are probed: each shingle of the one set is looked up in the other by binary search, which
   tells whether the other is in that shingle's list, long or not. Sets are written once, for the nodes that
   may link. A node's most promising partner is probed first, then only pairs whose groups are still apart,
   as only the groups matter.
4. A node on long lists has at least three quarters of its shingles there. Such a list first meets its hub,
   the node with the largest share of long shingles, as all that link within a family tend to link with
   it: that takes as many steps as the list has entries. Then lists that lie within one group are done. On
   the others only nodes stay that could reach T with a node of another group there: the long shingles
   of either must suffice, which a table of bands of sizes for each list tells. What is left is merged
   in blocks of BLOCK entries of a list, occurrences on the lists are added up, and survivors are probed.

Nothing is capped or dropped: every link between different sets is probed or lies within a group that
other links have already joined. Where long lists hold many groups that could link and don't, step 4 takes
the square of their number, in blocks over all tasks.

Sets are equal when their sizes and 64-bit hashes are (a billion different sets have one clash with a
chance of 3 per cent); shingles are compared by 48 bits within a pair. Postings compare 32 bits within a
bucket, which can add candidates and loses none.

Defined cases: null, empty and white-space-only texts have an empty set, link with nothing and are their
own group; repeated rows give repeated result rows; rows that share a doc_id and differ in text are nodes
of their own; a null doc_id comes back with the group of the equal sets, or null where it has none; a
text longer than a slice is hashed alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from derivia.llm.common import U64, Scratch, Words, fits_broadcast, mix, plain_keys, shingle_hashes, slices, small_batches, written
from derivia.llm.components import connected
from derivia.llm.slabs import gathered, slab_rows

#: Postings that one bucket should get, and that a task gathers before it sends them.
BUCKET = 1_000_000
FLUSH = 1_200_000
#: Text bytes hashed at once.
SLICE = 1 << 18
#: Entries beyond the expected noise of a sketch cell that make its shingles long.
LONG = 64
#: Entries of a long list that one task compares with one another, or with as many others.
BLOCK = 4096
#: Rows of ids up to which they are sent to all tasks in place of shuffling what they are looked up in.
FEW_IDS = 500_000
#: Growth of the bands of set sizes.
BAND = 1.05
PAIR_SCHEMA = "a long, b long, na int, nb int, ra int, rb int, c int"


def set_arrays(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, rows one after another and each ascending, and the rows' offsets."""
    h, row = shingle_hashes(Words(batch.column("text"), lower=True), words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(batch.num_rows + 1))


def place_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """A cell of a bit set for each id."""
    return (mix(ids.astype(np.int64).view(U64) ^ U64(0x5851F42D4C957F2D)) >> U64(64 - bits)).astype(np.int64)


def id_filter(ids: DataFrame, name: str, bits: int) -> np.ndarray:
    """A packed bit set of fixed size that has every id of the column; it may let others through, which costs time only."""

    def fill(batches):
        cells = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            cells[place_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits)] = 1
        yield slab_rows(cells)

    return np.packbits(gathered(ids.select(name).mapInArrow(fill, "slab int, cells binary"), 1 << bits, np.uint8, fold=np.maximum).astype(bool))


def passes(packed: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    at = place_of(ids, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def least_common(n: np.ndarray) -> np.ndarray:
    """The fewest shingles a set of n shares with any linked set: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def node_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(0x1234567)))])
        return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.diff(at).astype(U64) + U64(1))).view(np.int64)


def first_seen(nodes: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows with a set that the task hasn't met before."""
    keep = []
    for k, (node, size) in enumerate(zip(nodes.tolist(), n.tolist(), strict=True)):
        if size and node not in seen:
            seen.add(node)
            keep.append(k)
    return np.array(keep, np.int64)


def taken(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows, and their offsets."""
    n = np.diff(at)[rows]
    offsets = np.concatenate([[0], np.cumsum(n)])
    return h[np.repeat(at[rows] - offsets[:-1], n) + np.arange(offsets[-1])], offsets


def scan(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row (doc_id, n, node) per document (node null for an empty set), and the slabs of the shingle sketch."""
    names = ["doc_id", "n", "node", "slab", "cells"]

    def run(batches):
        cells = np.zeros(1 << bits, np.uint32)
        held, size, seen = [], 0, set()
        for batch in slices(batches, limit=SLICE):
            h, at = set_arrays(batch, words)
            n, nodes = np.diff(at), node_of(h, at)
            held.append((taken(h, at, first_seen(nodes, n, seen))[0] >> U64(64 - bits)).astype(np.int64))
            size += len(held[-1])
            if size > 1 << 21:
                cells += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(nodes, mask=n == 0), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if held:
            cells += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        slabs = slab_rows(np.minimum(cells, 65535).astype(np.uint16))
        none = [pa.nulls(slabs.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, slabs.column(0), slabs.column(1)], names)

    return docs.mapInArrow(run, "doc_id long, n int, node long, slab int, cells binary")


class Order:
    """The order of shingles: which are long, and their classes of frequency (rarer ones first)."""

    def __init__(self, cells: np.ndarray):
        self.bits = len(cells).bit_length() - 1
        mean = float(cells.mean())
        self.long = np.flatnonzero(cells > mean + 8 * mean**0.5 + LONG)
        self.rank = (1 + np.minimum(254, 8 * np.log2(cells[self.long].astype(float)))).astype(np.uint8)
        self.packed = np.packbits(np.isin(np.arange(len(cells)), self.long))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """0 for short shingles, the class of long ones."""
        cell = (h >> U64(64 - self.bits)).astype(np.int64)
        out = np.zeros(len(h), np.uint8)
        at = np.flatnonzero((self.packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
        out[at] = self.rank[np.searchsorted(self.long, cell[at])]
        return out


def list_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, apart=None):
    """Batches (key, c): pairs of nodes (the smaller index in the key's upper half) and how often they occur in the merged lists.

    Lists are runs of equal tokens; doc indexes n. Pairs whose sizes alone keep them apart are left out,
    and those for which apart(x, y) is false; a node that posts a token twice occurs once.
    """
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[once], doc[once]
    first = np.concatenate([[True], token[1:] != token[:-1]])
    begin = np.flatnonzero(first)
    length = np.diff(np.concatenate([begin, [len(token)]]))
    keep = np.repeat(length > 1, length)
    doc, left = doc[keep], (np.repeat(begin + length, length) - np.arange(len(token)) - 1)[keep]
    held, size = [], 0

    def merged():
        keys, counts = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return keys, np.bincount(counts, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)

    at = np.arange(len(doc))
    step = 0
    while len(at):
        step += 1
        at = at[left[at] >= step]
        x, y = doc[at], doc[at + step]
        fits = 4 * np.minimum(n[x], n[y]).astype(np.int64) >= 3 * np.maximum(n[x], n[y]).astype(np.int64)
        if apart is not None:
            fits &= apart(x, y)
        key = np.minimum(x, y)[fits].astype(np.int64) << 32 | np.maximum(x, y)[fits]
        if len(key):
            held.append((key, np.ones(len(key), np.int64)))
            size += len(key)
        if size > 1_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 500_000:
                yield held.pop()
                size = 0
    if held:
        yield merged()


def by_hub(token: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The order of postings by list, the hub of a list first: the document with the fewest short shingles, which is nearest to what its family has in common."""
    return np.lexsort((mix(ids.view(U64))[doc], (n - rest)[doc], token))


def posted(docs: DataFrame, words: int, order: Order, buckets: int) -> DataFrame:
    """The pairs of merged lists, as rows of PAIR_SCHEMA with tokens null; and with c null a row for each node that posts long shingles."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(order)  # of the sketch's size at most
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "kind", "ids", "n", "rest", "token", "doc"]

    def spread(batches):
        held: list[tuple] = []
        size = base = 0
        seen: set[int] = set()

        def rows(parts):
            """Bundles of (bucket, kind, ids, n, rest, token, index of the node)."""
            return pa.RecordBatch.from_arrays([pa.array([p[k] if k < 2 else p[k].tobytes() for p in parts], t) for k, t in enumerate(kinds)], names)

        def flush():
            ids, n, rest = (np.concatenate([x[k] for x in held]) for k in range(3))
            token, doc, is_long = (np.concatenate([x[k] for x in held]) for k in range(3, 6))
            none = np.zeros(0, U64)
            parts = []

            def bundle(kind, token, doc, stored):
                bucket = (mix(token) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                token, doc = token[order], doc[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    used, local = np.unique(doc[cuts[k] : cuts[k + 1]], return_inverse=True)
                    parts.append((int(k), kind, ids[used], n[used], rest[used], token[cuts[k] : cuts[k + 1]].astype(stored), local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)))

            bundle(0, token[~is_long], doc[~is_long], np.uint32)
            token, doc = token[is_long], doc[is_long]
            if len(token):
                cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    d = doc[a]
                    parts.append((int(ids[d] % buckets), 1, ids[d : d + 1], n[d : d + 1], rest[d : d + 1], token[a:b], none))
                # the hub of each long list here: only it goes on to the hub of all
                order = by_hub(token, doc, ids, n, rest)
                token, doc = token[order], doc[order]
                first = np.concatenate([[True], token[1:] != token[:-1]])
                hub = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
                bundle(2, token[first], doc[first], U64)
                other = hub != doc
                if other.any():
                    key, c = np.unique(np.minimum(hub, doc)[other].astype(np.int64) << 32 | np.maximum(hub, doc)[other], return_counts=True)
                    for k, at in enumerate(np.array_split(np.arange(len(key)), max(1, len(key) // 50_000))):
                        used, local = np.unique(np.concatenate([key[at] >> 32, key[at] & 0xFFFFFFFF]), return_inverse=True)
                        parts.append((int(mix(np.array([ids[0] + k], np.int64).view(U64))[0] % U64(buckets)), 3, ids[used], n[used], rest[used], c[at].astype(U64), local.astype(np.uint32)))
            for k in range(0, len(parts), 64):
                yield rows(parts[k : k + 64])

        for batch in slices(batches, limit=SLICE):
            h, at = set_arrays(batch, words)
            nodes = node_of(h, at)
            keep = first_seen(nodes, np.diff(at), seen)
            if not len(keep):
                continue
            nodes, (h, at) = nodes[keep], taken(h, at, keep)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            rank = shared.value.ranks(h)
            short = n - np.bincount(row[rank > 0], minlength=len(n))
            sorted_ = np.lexsort((h, rank, row))
            prefix = n - least_common(n) + 1
            take = np.arange(len(h)) - at[row] < prefix[row]
            h, rank, row = h[sorted_][take], rank[sorted_][take], row[take]
            held.append((nodes, n.astype(np.int32), (n - np.minimum(short, prefix)).astype(np.int32), h, row + base, rank > 0))
            base += len(n)
            size += len(h)
            if size > FLUSH:
                yield from flush()
                held, size, base = [], 0, 0
        if held:
            yield from flush()

    out_names = ["a", "b", "na", "nb", "ra", "rb", "c", "tokens"]

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light: list[tuple] = []
        hubs: list[tuple] = []
        seen: set[int] = set()
        base = 0
        ids, n, rest = [], [], []
        for batch in batches:
            for kind, *cells in zip(batch.column("kind").to_pylist(), *(batch.column(c) for c in names[2:]), strict=True):
                i, m, r = (np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, (np.int64, np.int32, np.int32), strict=False))
                token = np.frombuffer(cells[3].as_buffer(), np.uint32 if kind == 0 else U64)
                doc = np.frombuffer(cells[4].as_buffer(), np.uint16 if kind in (0, 2) and len(i) <= 1 << 16 else np.uint32)
                if kind == 1:
                    if int(i[0]) in seen:
                        continue
                    seen.add(int(i[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.nulls(1, pa.int64()), pa.array(m), pa.nulls(1, pa.int32()), pa.array(r), *[pa.nulls(1, pa.int32())] * 2, pa.array([token.view(np.int64)], pa.list_(pa.int64()))], out_names)
                elif kind == 3:
                    x, y = np.split(doc.astype(np.int64), 2)
                    yield pairs_batch(i, m, r, x, y, token.astype(np.int32))
                else:
                    (light if kind == 0 else hubs).append((token, doc.astype(np.int64) + base))
                    ids.append(i)
                    n.append(m)
                    rest.append(r)
                    base += len(i)
        if not ids:
            return
        ids, place = np.unique(np.concatenate(ids), return_inverse=True)
        spot = np.zeros(len(ids), np.int64)
        spot[place] = np.arange(len(place))
        n, rest = np.concatenate(n)[spot], np.concatenate(rest)[spot]
        if light:
            for keys, c in list_pairs(np.concatenate([x[0] for x in light]), place[np.concatenate([x[1] for x in light])], n):
                yield pairs_batch(ids, n, rest, keys >> 32, keys & 0xFFFFFFFF, c.astype(np.int32))
        if hubs:
            token, doc = np.concatenate([x[0] for x in hubs]), place[np.concatenate([x[1] for x in hubs])]
            order = by_hub(token, doc, ids, n, rest)
            token, doc = token[order], doc[order]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            hub = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
            other = hub != doc
            key, c = np.unique(np.minimum(hub, doc)[other] << 32 | np.maximum(hub, doc)[other], return_counts=True)
            yield pairs_batch(ids, n, rest, key >> 32, key & 0xFFFFFFFF, c.astype(np.int32))

    def pairs_batch(ids, n, rest, x, y, c):
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(n[x]), pa.array(n[y]), pa.array(rest[x]), pa.array(rest[y]), pa.array(c), pa.nulls(len(x), pa.list_(pa.int64()))], out_names)

    bundles = docs.mapInArrow(spread, "bucket int, kind int, ids binary, n binary, rest binary, token binary, doc binary")
    return bundles.groupBy("bucket").applyInArrow(merge, PAIR_SCHEMA + ", tokens array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, bits: int) -> DataFrame:
    """(node, shingles): the sets of the nodes, 48 bits of each hash, ascending. A bit set of fixed size keeps most others from the shuffle, the join all."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "node", bits))

    def sets(batches):
        seen: set[int] = set()
        for batch in slices(batches, limit=SLICE):
            h, at = set_arrays(batch, words)
            ids = node_of(h, at)
            keep = first_seen(ids, np.diff(at) * passes(wanted.value, ids, bits), seen)
            if len(keep):
                # most significant byte first
                raw = np.ascontiguousarray(h.byteswap().view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([raw[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]).join(nodes, "node", "left_semi")


def unpacked(cell) -> np.ndarray:
    raw = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(U64).ravel().byteswap()


def looked_up(ids: DataFrame) -> DataFrame:
    """ids for a join on them: sent to all tasks where they are few, which a count tells."""
    return F.broadcast(ids) if fits_broadcast(ids, FEW_IDS) else ids


def probed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that link, by binary probes of one set's shingles in the other's."""

    def probe(batches):
        for batch in batches:
            kept, last, large = [], None, None
            for k, (sx, sy, y) in enumerate(zip(batch.column("sx"), batch.column("sy"), batch.column("y").to_pylist(), strict=True)):
                x = unpacked(sx)
                if y != last:
                    last, large = y, unpacked(sy)
                at = np.searchsorted(large, x)
                common = int((large[np.minimum(at, len(large) - 1)] == x).sum())
                if 7 * common >= 3 * (len(x) + len(large)):
                    kept.append(k)
            yield batch.select(["x", "y"]).take(pa.array(kept, pa.int64()))

    pairs = pairs.select("x", "y")
    half = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")).join(looked_up(pairs), "x")
    ends = pairs.select(F.col("y").alias("node")).distinct()
    other = sets.join(looked_up(ends), "node", "left_semi").select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    return half.join(other, "y").select("x", "y", "sx", "sy").mapInArrow(probe, "x long, y long")


def apart(pairs: DataFrame, roots: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs whose ends lie in different groups so far."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    out = pairs.join(side(a), a, "left").join(side(b), b, "left")
    return out.where(F.coalesce(f"root_{a}", a) != F.coalesce(f"root_{b}", b)).drop(f"root_{a}", f"root_{b}")


def joined_up(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after more links(x, y): only groups are connected anew, each as one node."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("root_x", "x").alias("a"), F.coalesce("root_y", "y").alias("b"))
    more = connected(ends).select(F.col("node").alias("group"), F.col("root").alias("top"))
    old = roots.join(more, roots["root"] == more["group"], "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(roots.select(F.col("node").alias("group")), "group", "left_anti").select(F.col("group").alias("node"), F.col("top").alias("root"))
    return old.union(new)


def open_lists(long_: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, x, n, r, root) of the nodes on long lists that could link with a node of another group there: 7 min(r) >= 3 (n1 + n2), r being the shingles that aren't posted as short ones.

    For each list and band of sizes the two groups that reach furthest (7 r - 3 n) are enough to tell.
    """
    now = long_.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").select("x", "n", "r", F.coalesce("root", "x").alias("root"), F.explode("tokens").alias("token"))
    several = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    now = now.join(several, "token", "left_semi")
    reach, band = (7 * F.col("r") - 3 * F.col("n")).alias("reach"), F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int").alias("band")
    best = now.groupBy("token", band, "root").agg(F.max(reach).alias("reach"), F.min("n").alias("least"))
    tops = best.groupBy("token", "band").agg(F.max(F.struct("reach", "root")).alias("top"), F.min("least").alias("least"))
    rest = best.join(tops.select("token", "band", F.col("top.root").alias("taken")), ["token", "band"]).where("root <> taken").groupBy("token", "band").agg(F.max(F.struct("reach", "root")).alias("next"))
    bands = tops.join(rest, ["token", "band"], "left").groupBy("token").agg(F.collect_list(F.struct("least", "top", "next")).alias("bands"))
    could = F.exists("bands", lambda b: (3 * b["least"] <= reach_of()) & ((b["top"]["root"] != F.col("root")) & (b["top"]["reach"] >= 3 * F.col("n")) | F.coalesce((b["next"]["root"] != F.col("root")) & (b["next"]["reach"] >= 3 * F.col("n")), F.lit(False))))
    return now.join(bands, "token").where(could).select("token", "x", "n", "r", "root")


def reach_of():
    return 7 * F.col("r") - 3 * F.col("n")


def met_on_lists(entries: DataFrame) -> DataFrame:
    """Pairs (x, y) of different groups that occur often enough on the lists of entries (token, x, n, r, root).

    The entries of a list are dealt into blocks, and each two blocks meet in one task.
    """
    size = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = entries.join(size, "token").withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "n", "r", "root")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own, ids, n, r, root = (t.column(c).to_numpy() for c in ("own", "x", "n", "r", "root"))
        n, r = n.astype(np.int64), r.astype(np.int64)
        single = key[1].as_py() == key[2].as_py()

        def fits(x, y):
            """Apart, within reach, and of both blocks."""
            return (root[x] != root[y]) & (7 * np.minimum(r[x], r[y]) >= 3 * (n[x] + n[y])) & (single | (own[x] != own[y]))

        for keys, _ in list_pairs(np.zeros(len(ids), np.int64), np.arange(len(ids)), n, fits):
            x, y = keys >> 32, keys & 0xFFFFFFFF
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(n[x]), pa.array(n[y])], ["x", "y", "nx", "ny"])

    found = cells.groupBy("token", "i", "j").applyInArrow(meet, "x long, y long, nx long, ny long")
    # what a node hasn't posted at all is ceil(0.75 n) - 1 shingles
    bound = F.col("c") + F.ceil(0.75 * F.greatest("nx", "ny")) - 1
    return found.groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("c")).where(7 * bound >= 3 * (F.col("nx") + F.col("ny"))).select("x", "y")


def node_groups(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, n, node) of docs(doc_id, text), and (node, root) of the nodes that link; both written."""
    small_batches(docs.sparkSession)
    work = Scratch()
    bits = max(16, min(24, (16 * docs.count()).bit_length()))
    scanned = written(scan(docs, words, bits), "scan")
    rows = scanned.where("slab is null").select("doc_id", "n", "node")
    cells = gathered(scanned.where("slab is not null").select("slab", "cells"), 1 << bits, np.uint16, np.uint32)
    found = work.written(posted(docs, words, Order(cells), max(8, int(cells.sum()) // 4 // BUCKET + 1)), "lists")

    bound = F.col("c") + F.greatest("ra", "rb")
    keys = ["a", "b", "na", "nb", "ra", "rb"]
    pairs = found.where("c is not null").groupBy(*keys).agg(F.sum("c").alias("c")).where(7 * bound >= 3 * (F.col("na") + F.col("nb")))
    pairs = work.written(pairs.select("a", "b", (F.col("c") / (F.least("na", "nb") / 4 + 1)).alias("share")), "pairs")
    long_ = found.where("c is null").select(F.col("a").alias("x"), F.col("na").alias("n"), F.col("ra").alias("r"), "tokens")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long_.select("x")).distinct()
    sets = work.written(sets_of(docs, work.written(nodes, "nodes"), words, bits), "sets")

    # every node's most promising partner; among good ones the same for all, so that a family meets in one
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "share").union(pairs.select("b", "a", "share"))
    ends = ends.select("x", "y", F.least("share", F.lit(0.75)).alias("share"))
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("share", F.xxhash64("y"), "y")).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = work.written(probed(best, sets), "links")
    roots = connected(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    left = work.written(apart(pairs, roots).select(F.col("a").alias("x"), F.col("b").alias("y")), "left")
    if not left.isEmpty():
        links = work.written(probed(left, sets), "links")
        if not links.isEmpty():
            roots = work.written(joined_up(roots, links), "roots")

    met = work.written(met_on_lists(open_lists(long_, roots)), "met")
    if not met.isEmpty():
        links = work.written(probed(met, sets), "links")
        if not links.isEmpty():
            roots = joined_up(roots, links)
    roots = written(roots, "roots")
    work.drop()
    return rows, roots


def of_documents(docs: DataFrame) -> DataFrame:
    return plain_keys(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest doc_id of each node's group; written."""
    firsts = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(roots, "node", "left")
    groups = firsts.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    return written(firsts.join(groups, "root", "left").select("node", F.coalesce("least", "first").alias("component_id")), "named")


def groups_of(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    rows, roots = node_groups(of_documents(docs), words)
    out = rows.join(named(rows, roots), "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs(doc_id, text, ...) without those that another row of their group stands for, with the same columns.

    The row with the group's smallest doc_id stays, one of them where it comes several times; a group
    without any doc_id keeps one row. Rows without a word link with nothing and all stay. Texts travel
    only where there are more than FEW_IDS rows to drop, or for rows whose doc_id is null or repeated.
    """
    rows, roots = node_groups(of_documents(docs), words)
    names = named(rows, roots)
    groups = written(rows.join(names, "node", "left").select("doc_id", "node", "component_id"), "groups")
    odd = written(groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("_odd")).count().where("count > 1").select("_odd"), "odd")
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_odd")).union(odd).distinct(), "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    kept = whole.where("_id is not null").join(looked_up(gone), F.col("_id") == F.col("_odd"), "left_anti").select("_row.*")
    hard = whole.where("_id is null")
    if not odd.isEmpty():
        hard = hard.union(whole.join(looked_up(odd), F.col("_id") == F.col("_odd"), "left_semi"))
    elif hard.isEmpty():
        return kept

    def keyed(batches):
        for batch in batches:
            h, at = set_arrays(pa.RecordBatch.from_arrays([batch.column("_text")], ["text"]), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(h, at), mask=np.diff(at) == 0)], [*batch.schema.names, "_node"])

    hard = hard.withColumn("_text", F.col("_row.text").cast("string"))
    kinds = StructType([*hard.schema.fields, StructField("_node", LongType())])
    hard = hard.mapInArrow(keyed, kinds).join(names.select(F.col("node").alias("_node"), "component_id"), "_node", "left")
    top = hard.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), "_node", "left").withColumn("_group", F.coalesce("_root", "_node"))
    stay = top.where("_node is not null and component_id is not distinct from _id").dropDuplicates(["_group"])
    return kept.union(top.where("_node is null").select("_row.*")).union(stay.select("_row.*"))
