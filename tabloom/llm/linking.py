"""From shared buckets to groups of near copies, without a row for each pair of a bucket.

Nodes (distinct texts or lines) that share a bucket are candidates. In the first rounds each bucket has one
representative that its other members are aligned with, which settles groups of near copies with a number of pairs in
proportion to their members. Then all members of a bucket that are still in different components are compared
(``across``): a lower bound of their edit distance, from the parities of their words, rules most pairs out while the
bucket streams through a task. What is left of a bucket leaves it as a forest, a row for each member at most. Members that these
forests connect are a cluster; a node goes to its cluster once, with its words and its buckets, and the cluster's pairs are aligned where they
meet (``aligned_in_clusters``), so that no table has a row for each pair.

No bucket is capped, split or left out, however large it is: the components are those of all pairs that share a bucket and
are alike. Which of these ways a bucket is compared by has no part in that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, join_on, lean, width, written
from tabloom.llm.components import components, joined

#: Rounds with one representative to a bucket, each with another choice.
ROUNDS = 2
#: Buckets of up to so many members are compared as they stream by.
STREAMED = 128
#: Up to so many members of a bucket are compared by their distance in it, with many buckets at once; those of others one by one.
CROWD = 64
#: A bucket with more members is dealt into parts of about so many, and a task compares two parts.
PART = 1 << 14
#: Parities of long nodes where those at hand are too few.
WIDE = 2048
#: A cluster with more members, or more words, is dealt into parts of about so many (of more, if it has very many members), and a task aligns the pairs of two parts.
DEALT, DEALT_WORDS = 512, 1 << 22


def lcs(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """The length of the longest common subsequence, if it is ``least`` or more (else some number below ``least``).

    Common ends are cut off; the rest is aligned bit by bit, one row of the alignment in one long integer, within the
    band that alignments of at least ``least`` matches can't leave.
    """
    n = min(len(a), len(b))
    if n < least:
        return 0
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else np.zeros(0, int)
    tail = (int(differ[0]) if len(differ) else n) if n else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need = least - head - tail
    if not len(a) or not len(b):
        return head + tail
    if min(len(a), len(b)) < need:
        return 0
    # Row i may be matched with columns i - drop_a ... i + drop_b only.
    drop_a, drop_b = len(a) - max(need, 0), len(b) - max(need, 0)
    # Values that only one side has can't match.
    codes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)].tolist(), inverse[len(a) :].tolist()
    if np.minimum(np.bincount(x, minlength=len(codes)), np.bincount(y, minlength=len(codes))).sum() < need:
        return 0
    places: dict[int, int] = {}
    for j, code in enumerate(y):
        places[code] = places.get(code, 0) | 1 << j if len(y) < 4096 else places.get(code, 0)
    if len(y) >= 4096:
        order = np.argsort(inverse[len(a) :], kind="stable")
        cuts = np.flatnonzero(np.diff(inverse[len(a) :][order])) + 1
        for own in np.split(order, cuts):
            bits = np.zeros(len(y), np.uint8)
            bits[own] = 1
            places[y[own[0]]] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    done, low, step = 0, 0, 256
    span = len(y) if drop_a + drop_b + 2 * step >= len(y) else drop_a + drop_b + step + 1
    mask = (1 << span) - 1
    v = mask
    for i, code in enumerate(x):
        if span < len(y) and i - drop_a >= low + step:
            gone = v & ((1 << step) - 1)
            done += step - gone.bit_count()
            v = v >> step | ((1 << step) - 1) << (span - step)
            low += step
        m = places.get(code)
        if m:
            u = v & (m >> low & mask)
            if u:
                v = ((v + u) | (v - u)) & mask
    held = min(span, len(y) - low)
    return head + tail + done + held - (v & ((1 << held) - 1)).bit_count()


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64)
            h ^= h >> np.uint64(29)
    return h


def alike_edits(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the share of words that an alignment of two texts keeps is ``least`` or more."""
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return len(a) == len(b)
    need = int(np.ceil(least * n / 2 - 1e-9))
    return lcs(a, b, need) >= need


def parities(words: np.ndarray, bits: int) -> np.ndarray:
    """So many parities (a power of two) of a text's words, each numbered among its equals and hashed to one of them, as signed 64-bit numbers.

    A word that only one of two texts has changes one parity, so that the texts differ in at least as many words as
    their parities, and the alignment leaves out at least so many.
    """
    order = np.argsort(words, kind="stable")
    ranked = words[order].astype(np.uint64)
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(words)]
    number = np.arange(len(words)) - np.maximum.accumulate(np.where(new, np.arange(len(words)), 0)) if len(words) else np.zeros(0, int)
    with np.errstate(over="ignore"):
        h = (ranked + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount((h >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def parities_of_many(words: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The same bound for consecutive lines of ``sizes`` words, a row each; equal words aren't numbered, so that it is a little weaker."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        h = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount(line * bits + (h >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits * len(sizes)) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").reshape(len(sizes), bits // 64)


def wide_parities(seqs: DataFrame, words: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """node, sig (``WIDE`` parities) of ``seqs`` (node, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [parities(words(np.frombuffer(x.as_py(), "<u4")), WIDE) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.list_(pa.int64()))], names=["node", "sig"])

    return seqs.select("node", "seq").mapInArrow(lean(run), "node long, sig array<long>")


def verify(pairs: DataFrame, seqs: DataFrame, alike: Callable[[np.ndarray, np.ndarray, float], bool], least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sequences are alike. ``seqs``: node, seq (32-bit word hashes), a row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = batch.column(2), batch.column(3)
            fine = [alike(np.frombuffer(s[i].as_py(), "<u4"), np.frombuffer(t[i].as_py(), "<u4"), least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a")
    full = left.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(lean(run), "a long, b long")


def may_be_alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether a lower bound of the edit distance lets nodes be alike. ``x``, ``y``: n and the parities, a column for each node (``x`` may have one for all)."""
    # Lengths in a ratio below r / (2 - r) rule an alignment that keeps a share r of the words of both out.
    fine = np.minimum(x[0], y[0]) >= least / (2 - least) * np.maximum(x[0], y[0])
    most = (1 - least) * (x[0] + y[0]) + 1e-6
    differ = np.zeros(len(fine), np.int64)
    for i in range(1, len(x)):
        if i % 4 == 3 and len(fine) > 256:  # few are left after some of many parities
            rest = np.flatnonzero(fine & (differ <= most))
            if 4 * len(rest) < len(fine):
                out = np.zeros(len(fine), bool)
                out[rest] = _within(x[i:, rest] if x.shape[1] > 1 else x[i:], y[i:, rest], differ[rest], most[rest])
                return out
        differ += np.bitwise_count((x[i] ^ y[i]).view(np.uint64))
    return fine & (differ <= most)


def _within(x: np.ndarray, y: np.ndarray, differ: np.ndarray, most: np.ndarray) -> np.ndarray:
    for i in range(len(x)):
        differ = differ + np.bitwise_count((x[i] ^ y[i]).view(np.uint64))
    return differ <= most


MEETINGS = "bucket long, a long, b long"
LINKS = "a long, b long, na long, nb long"


def meetings(buckets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((a, b) of all pairs that share one of the ``buckets`` (bucket, node, n, sig) and may be alike; (bucket, node) of buckets
    with more than ``STREAMED`` members, which are left as they are).

    Buckets are sorted and compared as they stream through a task, a bucket's members by their distance in it, so that
    a task holds a batch and ``STREAMED`` rows; what the bound rules out never leaves it.
    """
    lanes = buckets.select(F.size("sig")).first()
    lanes = lanes[0] if lanes else 0
    flat = buckets.select("bucket", "node", F.col("n").cast("long").alias("n"), *[F.col("sig")[i].alias(f"s{i}") for i in range(lanes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowd = np.zeros((3 + lanes, 0), np.int64), None

        def crowded(rows: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(rows.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), none], names=["bucket", "a", "b"])

        def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not rows.shape[1]:
                return
            new = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
            size = np.diff(np.append(np.flatnonzero(new), rows.shape[1]))
            # How many members of its bucket follow a row.
            follow = np.repeat(np.cumsum(size), size) - np.arange(rows.shape[1]) - 1
            many = np.repeat(size > STREAMED, size)
            if many.any():
                yield crowded(rows[:, many])
            left, right, at, d = [], [], np.flatnonzero(~many & (follow > 0)), 1
            while len(at):
                x, y = rows[:, at], rows[:, at + d]
                fine = (x[1] != y[1]) & may_be_alike(x[2:], y[2:], least)
                left.append(np.minimum(x[1], y[1])[fine])
                right.append(np.maximum(x[1], y[1])[fine])
                d += 1
                at = at[follow[at] >= d]
            if left and sum(map(len, left)):
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["bucket", "a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if crowd is not None:  # the rest of a bucket that is a crowd already
                n = int(np.searchsorted(rows[0], crowd, side="right"))
                if n:
                    yield crowded(rows[:, :n])
                rows = rows[:, n:]
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from compared(rows[:, :last])
            held, crowd = rows[:, last:], None
            if held.shape[1] > STREAMED:
                yield crowded(held)
                crowd, held = int(held[0, 0]), held[:, :0]
        yield from compared(held)

    found = written(flat.repartition(width(buckets.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), MEETINGS), "meetings")
    return found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("bucket", F.col("a").alias("node"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below ``n`` that each is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_one_by_one(rows: np.ndarray, least: float, upto: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nodes) of a forest that connects what the pairs of one bucket connect that are in different components and may be alike.
    ``rows``: node, component, side, n, parities; nodes with one side are of different parts and are paired with the other side only, if there are two.

    Members of the most frequent component are only compared with the others, all within the lengths that may be alike.
    Pairs of two nodes with more than ``upto`` words are left out.
    """
    rows = rows[:, np.argsort(rows[3], kind="stable")]
    names, inverse, count = np.unique(rows[1], return_inverse=True, return_counts=True)
    if len(names) < 2:
        return rows[0, :0], rows[0, :0]
    is_main, two = inverse == count.argmax(), len(np.unique(rows[2])) > 1
    others, main = rows[:, ~is_main], rows[:, is_main]
    ratio, left, right = least / (2 - least), [], []
    last = np.searchsorted(others[3], others[3] / ratio * (1 + 1e-9), side="right")
    lo, hi = (np.searchsorted(main[3], others[3] * f, side=side) for f, side in ((ratio * (1 - 1e-9), "left"), (1 / ratio * (1 + 1e-9), "right")))
    long = others[3] > upto
    last, hi = np.where(long, 0, last), np.where(long, np.minimum(hi, np.searchsorted(main[3], upto, side="right")), hi)
    n = others.shape[1]
    tree = np.arange(rows.shape[1])  # of the others, then of the main component's members
    for k in range(n):
        one = others[:, k : k + 1]
        for begin, many in ((k + 1, others[:, k + 1 : last[k]]), (n + lo[k], main[:, lo[k] : hi[k]])):
            if many.shape[1]:
                fine = may_be_alike(one[3:], many[3:], least) & (many[1] != one[1])
                if two:
                    fine &= many[2] != one[2]
                at = np.flatnonzero(fine)
                trees, first = np.unique(tree[begin + at], return_index=True)
                new = trees != tree[k]
                if new.any():
                    left.append(np.full(int(new.sum()), one[0, 0]))
                    right.append(many[0, at[first[new]]])
                    tree[np.isin(tree, trees[new])] = tree[k]
    none = [rows[0, :0]]
    return np.concatenate(left or none), np.concatenate(right or none)


def across(members: DataFrame, least: float, upto: float = np.inf) -> DataFrame:
    """(a, b) of forests that connect what the pairs of ``members`` (node, component, n, sig, buckets: an array; a row for each node) connect
    that share a bucket, are in different components and may be alike.

    Of a bucket, or two parts of one, no more rows leave a task than it has members. A bucket with more than ``PART`` members is dealt into parts, and any two parts
    (and each with itself) meet in a task of their own. Pairs of two nodes with more than ``upto`` words are left out.
    """
    first = members.select(F.size("sig")).first()
    lanes = first[0] if first else 0
    flat = members.select(F.explode("buckets").alias("bucket"), "node", "component", F.col("n").cast("long").alias("n"), *[F.col("sig")[i].alias(f"s{i}") for i in range(lanes)])
    rest = ["node", "component", "side", "n", *[f"s{i}" for i in range(lanes)]]
    zero = F.lit(0).cast("long")
    large = written(members.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PART).select("bucket", F.ceil(F.col("c") / PART).cast("long").alias("parts")), "large")
    if large.limit(1).count():
        dealt = join_on(flat, large, "bucket", 32, "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
        whole = dealt.where("parts is null").select("bucket", zero.alias("block"), *[zero.alias("side") if c == "side" else c for c in rest])
        other = dealt.where("parts is not null").withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        block = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
        flat = whole.unionByName(other.select("bucket", block.alias("block"), *[(F.col("own") > F.col("other")).cast("long").alias("side") if c == "side" else c for c in rest]))
    else:
        flat = flat.select("bucket", zero.alias("block"), *[zero.alias("side") if c == "side" else c for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6 + lanes, 0), np.int64)

        def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not rows.shape[1]:
                return
            begin = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
            size = np.diff(np.append(begin, rows.shape[1]))
            follow = np.repeat(np.cumsum(size), size) - np.arange(rows.shape[1]) - 1
            # A bucket in parts has two sides, or a part meets itself; small ones have one.
            many = (size > CROWD) | (np.maximum.reduceat(rows[4], begin) > 0)
            left, right, at, d = [], [], np.flatnonzero(~np.repeat(many, size) & (follow > 0)), 1
            while len(at):
                x, y = rows[:, at], rows[:, at + d]
                fine = (x[3] != y[3]) & (np.minimum(x[5], y[5]) <= upto) & may_be_alike(x[5:], y[5:], least)
                left.append(at[fine])
                right.append(at[fine] + d)
                d += 1
                at = at[follow[at] >= d]
            if left and sum(map(len, left)):
                root = roots(rows.shape[1], np.concatenate(left), np.concatenate(right))
                below = np.flatnonzero(root != np.arange(len(root)))
                yield batch_of(rows[2, root[below]], rows[2, below])
            for k in np.flatnonzero(many).tolist():
                a, b = compare_one_by_one(rows[2:, begin[k] : begin[k] + size[k]], least, upto)
                if len(a):
                    yield batch_of(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            last = int(np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))[-1])
            yield from compared(rows[:, :last])
            held = rows[:, last:]
        yield from compared(held)

    dealt = flat.repartition(width(members.sparkSession), "bucket", "block").sortWithinPartitions("bucket", "block")
    found = written(dealt.mapInArrow(lean(run), "a long, b long").distinct(), "across")
    discard(large)
    return found


def aligned_in_clusters(
    members: DataFrame, seqs: DataFrame, alike: Callable[[np.ndarray, np.ndarray, float], bool], least: float, words: Callable[[np.ndarray], np.ndarray], count: bool
) -> DataFrame:
    """(a, b, na, nb) of links that connect what the links connect between ``members`` (cluster, node, component, n, buckets: an array; a row for each
    node) of one cluster that share a bucket, are in different components and alike. ``na`` and ``nb`` add up to each node's number of
    links, those without a row too; without ``count`` pairs that other links already connect aren't looked at and the numbers are 1.

    Of a cluster, or two parts of one, fewer rows leave a task than it has members.
    """
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    c, w = F.col("c"), F.col("w")
    parts = F.greatest(F.least(F.ceil(c / DEALT), F.floor(c / PART) + 16), F.ceil(w / DEALT_WORDS)).cast("long")
    large = written(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).select("cluster", parts.alias("parts")).where("parts > 1"), "large")
    dealt = join_on(members, large, "cluster", 32, "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit("cluster")), F.col("parts")))
    cross = F.explode(F.when(F.col("parts").isNull(), F.array(none)).otherwise(F.sequence(zero, F.col("parts") - 1)))
    dealt = dealt.withColumn("other", cross)
    own, other = F.col("own"), F.col("other")
    block = F.when(other < 0, zero).otherwise(F.least(own, other) * F.col("parts") + F.greatest(own, other))
    # A part meets itself (and a whole cluster) without sides.
    side = F.when((other < 0) | (own == other), none).otherwise((own > other).cast("long"))
    flat = dealt.select("cluster", block.alias("block"), "node", "component", side.alias("side"), "buckets").join(seqs, "node")
    flat = flat.select("cluster", "block", "node", "component", "side", "seq", "buckets")
    ratio = least / (2 - least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            seq = [np.frombuffer(x, "<u4") for x in rows.column("seq").to_pylist()]
            if len(seq) < 2:
                return
            of = [words(x) for x in seq]
            order = np.argsort([len(x) for x in of], kind="stable")
            x = np.stack([np.concatenate([[len(of[k])], parities(of[k], WIDE)]) for k in order.tolist()], axis=1)
            node, component, side = (rows.column(c).to_numpy()[order] for c in ("node", "component", "side"))
            buckets = rows.column("buckets").to_pylist()
            seq, shared = [seq[k] for k in order.tolist()], [frozenset(buckets[k]) for k in order.tolist()]
            last = np.searchsorted(x[0], x[0] / ratio * (1 + 1e-9), side="right")
            tree, degree, found = np.arange(len(seq)), np.zeros(len(seq), np.int64), []
            for k in range(len(seq)):
                many = slice(k + 1, int(last[k]))
                if many.stop <= many.start:
                    continue
                fine = (component[many] != component[k]) & ((side[many] != side[k]) | (side[many] < 0))
                if not count:
                    fine &= tree[many] != tree[k]
                if not fine.any():
                    continue
                fine &= may_be_alike(x[:, k : k + 1], x[:, many], least)
                for j in (np.flatnonzero(fine) + k + 1).tolist():
                    new = tree[j] != tree[k]
                    if not (new or count) or shared[k].isdisjoint(shared[j]) or not alike(seq[k], seq[j], least):
                        continue
                    degree[[k, j]] += 1
                    if new:
                        found.append((k, j))
                        tree[tree == tree[j]] = tree[k]
            if found:
                a, b = np.array(found).T
                if count:  # a node's number stands at its first link
                    both = np.array(found).reshape(-1)
                    each = np.zeros(len(both), np.int64)
                    own, first = np.unique(both, return_index=True)
                    each[first] = degree[own]
                    na, nb = each.reshape(-1, 2).T
                else:
                    na = nb = np.ones(len(a), np.int64)
                swap = node[a] > node[b]
                a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[a], node[b], na, nb)], names=["a", "b", "na", "nb"])

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = (int(keys[0, begin]), int(keys[1, begin]))
                if held and now != key:
                    yield from links(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                key = now
        if held:
            yield from links(held)

    found = written(flat.repartition(width(members.sparkSession), "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(lean(run), LINKS), "links")
    discard(large)
    return found


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, node, component; a node without a label is a component of its own."""
    if labels is None:
        return buckets.select("bucket", "node", F.col("node").alias("component"))
    return join_on(buckets.select("bucket", "node"), labels, "node", 48, "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))


def link(
    buckets: DataFrame, early: Column, info: DataFrame, seqs_of: Callable[[DataFrame], DataFrame], alike: Callable[[np.ndarray, np.ndarray, float], bool], least: float,
    pairs: DataFrame | None = None, shared: bool = False, upto: float = np.inf, words: Callable[[np.ndarray], np.ndarray] = lambda s: s,
    count: bool = False,
) -> tuple[DataFrame | None, DataFrame]:
    """((node, component) of all linked nodes, or None without any; verified links a, b, na, nb that connect them).

    ``buckets``: bucket, node; ``early``: of a bucket, whether the first round, which settles most members of large groups, looks at it;
    ``shared``: whether the buckets are a written table without repeated rows, each with several members.
    ``pairs``: a, b to verify besides (``meetings``).
    ``info``: node, n (words), sig (``parities``, an array). ``seqs_of`` gives (node, seq) of a DataFrame's nodes; ``words`` of a seq are what an alignment compares.
    ``upto``: pairs of nodes with more words, which so few parities don't rule out, are compared by ``WIDE`` parities of their words.
    ``count``: whether ``na`` and ``nb`` add up to each node's number of verified links (``aligned_in_clusters``).
    """
    spark = buckets.sparkSession
    if not shared:
        # One exchange serves both the count and the join: buckets of one node have no pair. Only the counts are hashed, nothing is sorted.
        dealt = buckets.repartition(width(spark), "bucket")
        many = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
        buckets = written(dealt.join(many.hint("shuffle_hash"), "bucket").distinct(), "buckets")
    lanes = info.select(F.size("sig")).first()
    lanes = lanes[0] if lanes else 0
    # Lengths in a ratio below r / (2 - r) rule an alignment that keeps a share r of the words of both out.
    near = lambda x, y: F.least(x, y) >= least / (2 - least) * F.greatest(x, y)

    def bound(x: str, y: str):
        """The condition that two nodes may be alike, by their columns' prefixes."""
        differ = sum((F.bit_count(F.col(f"{x}_sig")[i].bitwiseXOR(F.col(f"{y}_sig")[i])) for i in range(lanes)), F.lit(0))
        return near(F.col(f"{x}_n"), F.col(f"{y}_n")) & (differ <= (1 - least) * (F.col(f"{x}_n") + F.col(f"{y}_n")) + 1e-6)

    def prefixed(x: str) -> DataFrame:
        return info.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_sig"))

    links = labels = tested = None

    def settle(pairs: DataFrame) -> None:
        """Verifies pairs that no round has looked at yet and takes up what is found."""
        nonlocal tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.limit(1).count():
            return
        tested = pairs if tested is None else tested.unionByName(pairs)
        nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
        seqs = written(seqs_of(nodes), "seqs")
        found = written(verify(pairs, seqs, alike, least), "verified")
        discard(nodes, seqs)
        take(found.select("a", "b", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))

    def take(found: DataFrame) -> None:
        """Takes up links."""
        nonlocal links, labels
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            old, labels = labels, joined(labels, found)
            discard(old)

    def with_heads(members: DataFrame, k: int) -> None:
        """Pairs of each bucket's members with its representative of the round."""
        members = written(_labelled(members, labels), "open") if labels is not None else _labelled(members, None)
        mark = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "component")
        head = members.groupBy("bucket").agg(F.min(mark).alias("r"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        pairs = members.join(head.select("bucket", F.col("r.node").alias("r"), F.col("r.component").alias("rc")), "bucket").where(F.col("component") != F.col("rc"))
        pairs = pairs.select(F.least("node", "r").alias("a"), F.greatest("node", "r").alias("b")).distinct()
        settle(pairs.join(prefixed("a"), "a").join(prefixed("b"), "b").where(bound("a", "b")).select("a", "b"))
        discard(members)

    def among_each_other() -> None:
        """All pairs of a bucket's members in different components."""
        members = written(_labelled(buckets, labels), "open")
        mixed = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
        # A row for each node with its open buckets: parities and clusters are joined once, not for each bucket that a node is in.
        own = members.join(mixed, "bucket").groupBy("node").agg(F.collect_set("bucket").alias("buckets"), F.first("component").alias("component"))
        left = written(own.join(info, "node").select("node", "component", "n", "sig", "buckets"), "compared")
        discard(members)
        pairs, long = across(left, least, upto), left.where(F.col("n") > upto) if upto < np.inf else None
        if long is not None and long.limit(1).count():
            nodes = written(long.select("node"), "nodes")
            # Written in between: two Python steps in a task would need two workers for each, and all are kept.
            long_seqs = written(seqs_of(nodes), "long-seqs")
            sigs = written(wide_parities(long_seqs, words), "wide")
            discard(long_seqs)
            by_words = written(long.drop("sig").join(sigs, "node"), "long")
            pairs = pairs.unionByName(across(by_words, least))
            discard(nodes, sigs, by_words)
        if not pairs.limit(1).count():
            discard(left)
            return
        clusters = components(pairs)
        own = written(join_on(left.drop("sig"), clusters.withColumnRenamed("component", "cluster"), "node", 48), "clusters")
        seqs = written(seqs_of(written(own.select("node"), "nodes")), "seqs")
        take(aligned_in_clusters(own, seqs, alike, least, words, count))
        discard(left, clusters, own, seqs)

    if pairs is not None:
        settle(pairs)
    for k in range(ROUNDS):
        with_heads(buckets if k else buckets.where(early), k)
    among_each_other()
    discard(buckets)
    none = spark.createDataFrame([], LINKS)
    return labels, links if links is not None else none
