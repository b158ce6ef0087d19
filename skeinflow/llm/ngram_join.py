"""Jaccard self-join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, and each set into the
segments that fall into them.

Candidates: two sets with Jaccard t or more differ in at most D = (|a| + |b|)(1 - t)/(1 + t) n-grams. If the order is cut
into more fragments than D, at least one fragment holds identical segments. The number of fragments follows the size
class; a set is cut for its own class and the next, so that any pair that can be linked shares one cut. Segments of
fewer than two n-grams carry no evidence: a cut has some fragments to spare for them, and a set with more weak segments
than that is cut again with another order, until it has few. So no linked pair is lost, and a frequent n-gram alone
pairs nothing.

Bounds: sets that share a segment are compared by their counts in coarse cells of the order, taken in the first pass.
The sum of the lesser counts bounds the overlap from above, so pairs that share a passage but can't be linked are cut
off exactly, and what remains is tied together. The ties' connected components are candidate clusters, supersets of the
true ones.

Verification: the sets of a cluster, or of two blocks of a large one, make a task, and a task is cut into fragments of
the order by its number of n-grams. Every (task, fragment) counts the partial overlaps of its pairs separately, on
whatever executor it lands; the partial counts are summed per pair, and exact integer arithmetic decides. Tasks of one
fragment need no sum. A task returns a spanning forest of its links and each set's number of links, so the output stays
linear where thousands of copies link to each other.

Equal sets are one node throughout, so exact copies cost one count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.components import components
from skeinflow.llm.hashing import mix, shingles
from skeinflow.llm.staging import bound_batches, stage

#: Sets, and n-grams in all, of a block of a cluster; a task holds two blocks.
BLOCK_SETS, BLOCK_GRAMS = 512, 1 << 23
#: N-grams of a fragment of a task.
FRAGMENT_GRAMS = 1 << 19
#: Sets, and n-grams in all, of a block of a group that shares a segment.
TIE_SETS, TIE_GRAMS = 4096, 1 << 23
#: Orders tried before the weak segments of a set are used as well.
ORDERS = 12
#: Rows of a batch of segments, and of a segment that are held to name its group by its members.
CHUNK = 1 << 18
#: N-grams per cell of the counts that bound an overlap.
CELL = 8
#: Columns of the order counted at once.
COLUMNS = 2048
#: Bytes of n-grams in an output batch.
OUT_BYTES = 4 << 20
#: Members' tasks that are broadcast to fetch the texts (about 100 bytes each); beyond it the texts are shuffled.
BROADCAST_TASKS = 200_000


@cache
def class_bounds(num: int, den: int) -> np.ndarray:
    """Least sizes of the size classes: sets that can be linked are in the same class or adjacent ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
    return np.array(bounds, np.int64)


def size_class(n: int, num: int, den: int) -> int:
    return int(np.searchsorted(class_bounds(num, den), n, "right")) - 1


def _settled(n: int, fragments: int, spare: int, least: int) -> float:
    """About the chance that a set of ``n`` has at most ``spare`` segments of fewer than ``least`` n-grams."""
    p = 1 / fragments
    weak = (1 - p) ** n if least == 1 else (1 - p) ** n + n * p * (1 - p) ** (n - 1)
    mean, sd = fragments * weak, sqrt(max(fragments * weak * (1 - weak), 1e-9))
    return 0.5 * (1 + erf((spare + 0.5 - mean) / sd / sqrt(2)))


@cache
def cut(scheme: int, num: int, den: int) -> tuple[int, int, int]:
    """(fragments, weak segments allowed, n-grams of a segment that isn't weak) for pairs whose larger set is in class
    ``scheme``; no fragments: only equal sets link."""
    bounds = class_bounds(num, den)
    least, most = int(bounds[scheme]), int(bounds[scheme + 1]) - 1
    differ = 2 * most * (den - num) // (den + num)
    if differ == 0:
        return 0, 0, 1
    best = (0.0, differ + 1, 0, 1)
    steps = [0]
    while steps[-1] < 2 * differ + 7:  # single steps first, then by parts of what is spared
        steps.append(steps[-1] + 1 + steps[-1] // 256)
    for strong in (2, 1):
        for spare in steps:
            chance = _settled(max(least * num // den, 1), differ + 1 + spare, spare, strong)
            if chance > best[0]:
                best = (chance, differ + 1 + spare, spare, strong)
            if chance >= 0.9:
                break
        if best[0] >= 0.4:
            break
    return best[1:]


def cells(scheme: int, num: int, den: int) -> int:
    return max(16, -(-int(class_bounds(num, den)[scheme]) // CELL))


def cell_counts(grams: np.ndarray, scheme: int, num: int, den: int) -> bytes:
    """How many n-grams of a set lie in each of the order's cells, up to 255 a cell; a full cell bounds nothing."""
    width = cells(scheme, num, den)
    at = ((grams >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def segments(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of the segments of a set (distinct hashes) under the cuts of its own and the next size class."""
    found = []
    own = size_class(len(grams), num, den)
    for scheme in (own, own + 1):
        fragments, spare, strong = cut(scheme, num, den)
        names = []
        for order in range(ORDERS if fragments else 0):
            ranked = np.sort(grams if order == 0 else mix(grams + mix(np.array([order], np.uint64))))
            at = ((ranked >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            size = np.diff(np.append(first, len(at)))
            seed = mix(np.array([(scheme << 8) + order], np.uint64))
            name = mix(np.add.reduceat(mix(ranked + seed), first) ^ mix(at[first] + seed))
            good = size >= strong
            settled = fragments - int(good.sum()) <= spare
            names.append(name[good])
            if settled:
                break
            if order == ORDERS - 1:
                missing = np.setdiff1d(np.arange(fragments, dtype=np.uint64), at[first])
                names += [name[~good], mix(mix(missing + seed) + np.uint64(1))]
        found += names
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def set_of(grams: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct hashes in order, and the 64-bit name of the set; the empty set is 0."""
    grams = np.unique(grams)
    if not len(grams):
        return grams, 0
    name = mix(np.array([mix(grams + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64))
    return grams, int(name.view(np.int64)[0]) or 1


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(0).to_pylist()]


def _summaries(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, grams in shingles(_texts(batch), k):
                grams, name = set_of(grams)
                own = size_class(len(grams), num, den) if len(grams) else -1
                counts = [cell_counts(grams, c, num, den) for c in (own, own + 1)] if len(grams) else [b"", b""]
                rows.append((name, len(grams), own, *counts))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "text_hash", "node", "n", "k", "cells_own", "cells_next"])

    return run


def _segment_rows(k: int, num: int, den: int):
    def batch_of(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, rows, seen = [], [], 0, set()
        for batch in batches:
            for _, grams in shingles(_texts(batch), k):
                grams, name = set_of(grams)
                if not name or name in seen:
                    continue
                seen.add(name)
                found = segments(grams, num, den)
                for at in range(0, len(found), CHUNK):
                    part = found[at : at + CHUNK]
                    sigs.append(part)
                    nodes.append(np.full(len(part), name, np.int64))
                    rows += len(part)
                    if rows >= CHUNK and at + CHUNK < len(found):
                        yield batch_of(sigs, nodes)
                        sigs, nodes, rows = [], [], 0
                if rows >= CHUNK:
                    yield batch_of(sigs, nodes)
                    sigs, nodes, rows, seen = [], [], 0, set()
        if rows:
            yield batch_of(sigs, nodes)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (sig, node): (group, node) of the segments that several nodes share.

    A group is named by its members, so segments with the same members are one group; a segment with more than CHUNK
    rows, which aren't held, is named by itself.
    """
    sig = node = np.zeros(0, np.int64)
    open_ = None  # the segment whose rows are passed on as they come

    def out(group: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(node)], names=["group", "node"])

    def shared(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))) if len(sig) else np.zeros(0, bool)
        sig, node = sig[fresh], node[fresh]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), first)) if len(first) else np.zeros(0, np.uint64)
        many = np.repeat(size > 1, size)
        rows = np.unique(np.stack([np.repeat(name, size)[many].view(np.int64), node[many]]), axis=1)
        return out(np.ascontiguousarray(rows[0]), np.ascontiguousarray(rows[1]))

    for batch in batches:
        sig = np.concatenate([sig, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        if open_ is not None:
            end = int(np.searchsorted(sig, open_, "right"))
            yield out(sig[:end], node[:end])
            sig, node = sig[end:], node[end:]
            if not len(sig):
                continue
            open_ = None
        if not len(sig):
            continue
        # the last segment may go on in the next batch
        cut_at = int(np.searchsorted(sig, sig[-1]))
        if cut_at:
            yield shared(sig[:cut_at], node[:cut_at])
            sig, node = sig[cut_at:], node[cut_at:]
        if len(sig) > CHUNK:
            open_ = sig[-1]
            yield out(sig, node)
            sig, node = sig[:0], node[:0]
    yield shared(sig, node)


def reachable(counts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the first one connected with it by pairs whose overlap may suffice, by the sum of the lesser counts.

    Each set is compared with those that are not reached yet, so a group of near copies takes linear time.
    """
    label = np.full(len(sizes), -1)
    free = np.arange(len(sizes))
    full = counts == 255
    while len(free):
        root, edge = free[0], [free[0]]
        label[root] = root
        free = free[1:]
        while edge and len(free):
            one = edge.pop()
            least = np.minimum(sizes[free], sizes[one])
            most = np.minimum(counts[free], counts[one]).sum(axis=1, dtype=np.int64)
            # a cell that is full on either side bounds nothing
            most = np.where(full[free].any(axis=1) | full[one].any(), least, np.minimum(most, least))
            hit = den * most >= num * (sizes[free] + sizes[one] - most)
            edge += free[hit].tolist()
            label[free[hit]] = root
            free = free[~hit]
    return label


TIE = ["group", "g1", "g2"]


def _ties(num: int, den: int):
    """Rows (TIE, node, n, k, cells_own, cells_next) in order of TIE to ties of each node with the first one it may reach."""

    def tied(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        while len(rows) > 1:
            # a segment's sets are cut for the class of the largest, so they are of that class or the one below
            top = max(r[2] for r in rows)
            mine = [r for r in rows if r[2] >= top - 1]
            counts = np.stack([np.frombuffer(r[3] if r[2] == top else r[4], np.uint8) for r in mine])
            label = reachable(counts, np.array([r[1] for r in mine], np.int64), num, den)
            for i in np.flatnonzero(label != np.arange(len(mine))):
                yield mine[label[i]][0], mine[i][0]
            # others share a hash by accident and may be linked among themselves
            rows = [r for r in rows if r[2] < top] if len(mine) < len(rows) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([pair[side] for pair in out], pa.int64()) for side in (0, 1)], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True)
            for now, row in zip(keys, values, strict=True):
                if now != key:
                    out.extend(tied(rows))
                    key, rows = now, []
                if not rows or rows[-1][0] != row[0]:
                    rows.append(row)
            yield flush()
        out.extend(tied(rows))
        yield flush()

    return run


def _tie_tasks(groups: DataFrame, counted: DataFrame) -> DataFrame:
    """(TIE, node, n, k, cells) of the groups' members; a group beyond a block is dealt to pairs of blocks."""
    sizes = groups.join(counted.select("node", "n"), "node").groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    large = sizes.select("group", F.ceil(F.greatest(F.col("sets") / TIE_SETS, F.col("grams") / TIE_GRAMS)).cast("int").alias("blocks")).filter("blocks > 1")
    h = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "h").alias("g1"), F.greatest(o, "h").alias("g2")))
    alone = F.array(F.struct(F.lit(0).alias("g1"), F.lit(0).alias("g2")))
    dealt = groups.join(large, "group", "left").withColumn("h", h).select("group", "node", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("t"))
    return dealt.select("group", "t.g1", "t.g2", "node").join(counted, "node").select(*TIE, "node", "n", "k", "cells_own", "cells_next")


TASK = ["cluster", "k1", "h1", "k2", "h2"]
#: A task's fragment and their number, and what a set brings to it.
PLACED = "cluster long, k1 int, h1 int, k2 int, h2 int, frag int, frags int, side int, node long, n long, weight long, grams binary"


def _member_sets(k: int):
    """Rows (text, node, weight, tasks) to one row per task and fragment with the set's hashes in it."""
    kinds = [pa.int64(), *[pa.int32()] * 7, *[pa.int64()] * 3, pa.binary()]
    names = [part.split()[0] for part in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            nodes, weights, tasks = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, grams in shingles(_texts(batch), k):
                grams, name = set_of(grams)
                if name != nodes[i]:
                    continue  # another text under the same identifier or hash
                for t in tasks[i]:
                    frags = t["frags"]
                    at = ((grams >> np.uint64(32)) * np.uint64(frags)) >> np.uint64(32)
                    cuts = np.searchsorted(at, np.arange(frags + 1))
                    for f in np.flatnonzero(np.diff(cuts)):
                        body = grams[cuts[f] : cuts[f + 1]].tobytes()
                        for column, value in zip(out, (*(t[c] for c in TASK), f, frags, t["side"], name, len(grams), weights[i], body), strict=True):
                            column.append(value)
                        held += len(body) + 100
                        if held >= OUT_BYTES:
                            yield flush()
                            held = 0
        yield flush()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of ``left`` with ``right`` (default: itself), counted over some columns at a time."""
    sets = left + (right or [])
    width = len(left)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(everything, kind="stable")
    value, owner = everything[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    total = np.zeros((width, len(right) if right else width), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        cuts = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part = np.zeros((len(sets), COLUMNS), np.float32)
                part[owner[a:b], column[a:b] % COLUMNS] = 1
                total += part[:width] @ (part[width:] if right else part).T
    total = np.rint(total).astype(np.int64)
    if not right:
        np.fill_diagonal(total, [len(s) for s in left])
    return total


def forest(linked: np.ndarray) -> np.ndarray:
    """The least position connected with each one."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of(left: np.ndarray, right: np.ndarray, common: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
    """(node, first node connected with it, linked rows) of the sets of ``left`` and ``right``, whose rows are (node, n,
    weight), by the sizes of their intersections; without ``right`` among those of ``left``."""
    other = right if len(right) else left
    linked = den * common >= num * (left[:, 1][:, None] + other[:, 1][None, :] - common)
    if len(right):
        every = np.concatenate([left, right])
        both = np.zeros((len(every), len(every)), bool)
        both[: len(left), len(left) :] = linked
        both[len(left) :, : len(left)] = linked.T
    else:
        every, both = left, linked
        np.fill_diagonal(both, False)
    degree = both @ every[:, 2]
    roots = forest(both)
    return [(int(every[i, 0]), int(every[roots[i], 0]), int(degree[i])) for i in np.flatnonzero(degree)]


PARTS = "a long, b long, degree long, cluster long, k1 int, h1 int, k2 int, h2 int, `left` binary, `right` binary, common binary"
_PART_KINDS = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()] * 3
_PART_NAMES = [part.split()[0].strip("`") for part in PARTS.split(", ")]


def _partial(num: int, den: int):
    """Rows of PLACED in order of task, fragment and node to PARTS: links of tasks with one fragment, else partial overlaps."""

    def solve(key: tuple, rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sides = [[r for r in rows if r[0] == side] for side in (0, 1, 2)]
        left, right = (sides[0], []) if sides[0] else (sides[1], sides[2])
        if not sides[0] and not (left and right):
            return []
        info = [np.array([r[1:4] for r in part], np.int64).reshape(-1, 3) for part in (left, right)]
        grams = [[np.frombuffer(r[4], np.uint64) for r in part] for part in (left, right)]
        common = overlaps(grams[0], grams[1] or None)
        if key[6] == 1:
            return [(*link, *[None] * 8) for link in links_of(*info, common, num, den)]
        return [(None, None, None, *key[:5], info[0].tobytes(), info[1].tobytes(), common.astype(np.uint32).tobytes())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * len(_PART_NAMES)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_KINDS, strict=True)], names=_PART_NAMES)
            out.clear()
            return batch

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in range(7, 12)), strict=True)
            for now, row in zip(keys, values, strict=True):
                if now != key:
                    found = solve(key, rows) if rows else []
                    out.extend(found)
                    held += sum(len(x[10] or b"") + 50 for x in found)
                    key, rows = now, []
                    if held >= OUT_BYTES:
                        yield flush()
                        held = 0
                if not rows or rows[-1][1] != row[1]:  # a set comes once for each copy of its text without an identifier
                    rows.append(row)
        if rows:
            out.extend(solve(key, rows))
        yield flush()

    return run


def _placed(ids: np.ndarray, info: np.ndarray) -> np.ndarray:
    """``ids`` with the rows (node, n, weight) of ``info`` that it lacks, behind the others."""
    return np.concatenate([ids, info[~np.isin(info[:, 0], ids[:, 0])]])


def _positions(ids: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    order = np.argsort(ids[:, 0])
    return order[np.searchsorted(ids[order, 0], nodes)]


def _summed(num: int, den: int):
    """Partial overlaps (TASK, left, right, common) in order of TASK, summed per pair, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right, total = None, np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64), np.zeros((0, 0), np.int64)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 3
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "degree"])
            out.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                *now, one, two, common = (batch.column(j)[i].as_py() for j in range(8))
                one, two = (np.frombuffer(x, np.int64).reshape(-1, 3) for x in (one, two))
                if now != key:
                    if key is not None:
                        out.extend(links_of(left, right, total, num, den))
                    key, left, right, total = now, one[:0], two[:0], np.zeros((0, 0), np.int64)
                left, right = _placed(left, one), _placed(right, two)
                grown = np.zeros((len(left), len(right) or len(left)), np.int64)
                grown[: total.shape[0], : total.shape[1]] = total
                at = _positions(left, one[:, 0])
                other = _positions(right, two[:, 0]) if len(two) else at
                grown[np.ix_(at, other)] += np.frombuffer(common, np.uint32).reshape(len(at), len(other))
                total = grown
            yield flush()
        if key is not None:
            out.extend(links_of(left, right, total, num, den))
        yield flush()

    return run


def _tasks(members: DataFrame) -> DataFrame:
    """members (node, cluster, k, n, ...) with the tasks in which each takes part."""
    cells = members.groupBy("cluster", "k").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    whole = cells.groupBy("cluster").agg(F.sum("sets").alias("all_sets"), F.sum("grams").alias("all_grams"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    cells = cells.join(whole, "cluster").select("cluster", "k", blocks.alias("blocks"), F.ceil(F.col("grams") / blocks).alias("own"), "all_grams", ((F.col("all_sets") <= BLOCK_SETS) & (F.col("all_grams") <= BLOCK_GRAMS)).alias("one"))
    beside = lambda d, name: cells.select("cluster", (F.col("k") - d).alias("k"), F.col("blocks").alias(name), F.col("own").alias(f"{name}_grams"))
    cells = cells.join(beside(1, "above"), ["cluster", "k"], "left").join(beside(-1, "below"), ["cluster", "k"], "left")
    rows = members.join(cells, ["cluster", "k"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    zero = F.lit(0)
    count = lambda c: F.when(F.coalesce(F.col(c), zero) > 0, F.sequence(zero, F.col(c) - 1)).otherwise(F.array().cast("array<int>"))

    def task(k1, h1, k2, h2, side, grams):
        parts = {"k1": k1, "h1": h1, "k2": k2, "h2": h2, "side": side, "frags": F.greatest(F.lit(1), F.ceil(grams / FRAGMENT_GRAMS))}
        return F.struct(F.col("cluster").alias("cluster"), *[x.cast("int").alias(name) for name, x in parts.items()])

    k, h, own = F.col("k"), F.col("h"), F.col("own")
    # sides: 0 within a block, else 1 and 2
    within = F.transform(count("blocks"), lambda o: task(k, F.least(h, o), k, F.greatest(h, o), F.when(h == o, 0).when(h < o, 1).otherwise(2), F.when(h == o, own).otherwise(own + own)))
    up = F.transform(count("above"), lambda o: task(k, h, k + 1, o, F.lit(1), own + F.col("above_grams")))
    down = F.transform(count("below"), lambda o: task(k - 1, o, k, h, F.lit(2), F.col("below_grams") + own))
    alone = F.array(task(F.lit(-1), zero, F.lit(-1), zero, zero, F.col("all_grams")))
    return rows.withColumn("tasks", F.when(F.col("one"), alone).otherwise(F.concat(within, up, down)))


def text_hash(text: Column) -> Column:
    """A 64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def jaccard_join(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, n_links, for links at Jaccard >= num / den of k-word shingles.

    Words are lower-cased (A-Z) and separated by white space. A text with fewer than k words is one shingle; a null,
    empty or blank text has an empty set and links with nothing, so its component is its own identifier. component_id is
    the smallest identifier reachable by links; n_links counts the linked rows, copies included. Repeated rows count as
    copies of each other; a null identifier takes part but names no component. Identifiers are integers. Other columns
    are ignored; an empty table gives an empty result. Shingles are compared by 64-bit hashes. ``with_hash`` adds the
    columns text_hash (see ``text_hash``), which tells rows with one identifier, or none, apart, and component_hash, the
    least text_hash among the component's rows of component_id (of all its rows, if none has an identifier).
    """
    if not 0 < num < den:
        raise ValueError("0 < num < den is needed; equal sets are one node anyway")
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(df[text_col].cast("string").cast("binary").alias("text"), df[id_col].cast("long").alias("doc_id"), text_hash(df[text_col]).alias("text_hash"))

    own = stage(docs.mapInArrow(_summaries(k, num, den), "doc_id long, text_hash long, node long, n long, k int, cells_own binary, cells_next binary"), "ngram-sets")
    # a set is known by its row of the least identifier, or without one by that of the least text hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    nodes = own.filter("n > 0").groupBy("node").agg(first.alias("rep"), F.count("*").alias("weight"), F.max("n").alias("n"), F.max("k").alias("k"))

    rows = docs.mapInArrow(_segment_rows(k, num, den), "sig long, node long")
    groups = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_groups, "group long, node long")
    groups = stage(groups.distinct(), "ngram-groups")
    counted = own.filter("n > 0").dropDuplicates(["node"]).select("node", "n", "k", "cells_own", "cells_next")
    ties = _tie_tasks(groups, counted).repartition(*TIE).sortWithinPartitions(*TIE, "node").mapInArrow(_ties(num, den), "a long, b long")
    clusters = components(ties).withColumnRenamed("component", "cluster")

    members = stage(nodes.join(clusters, "node"), "ngram-members")
    dealt = _tasks(members).select("rep.unknown", F.coalesce("rep.doc_id", F.lit(0).cast("long")).alias("known"), "rep.text_hash", "node", "weight", "tasks")
    if (dealt.agg(F.sum(F.size("tasks"))).first()[0] or 0) <= BROADCAST_TASKS:
        dealt = F.broadcast(dealt)
    texts = docs.select("text", F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("known"), "text_hash")
    texts = texts.join(dealt, ["unknown", "known", "text_hash"]).select("text", "node", "weight", "tasks")
    placed = texts.mapInArrow(_member_sets(k), PLACED).repartition(*TASK, "frag").sortWithinPartitions(*TASK, "frag", "node")
    parts = stage(placed.mapInArrow(_partial(num, den), PARTS), "ngram-parts")
    torn = parts.filter("cluster IS NOT NULL").select(*TASK, "left", "right", "common")
    summed = stage(torn.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(_summed(num, den), "a long, b long, degree long"), "ngram-links")
    found = parts.filter("cluster IS NULL").select("a", "b", "degree").unionByName(summed)

    reached = components(found.select("a", "b"))
    named = reached.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    linked = named.join(least, "component").join(degrees, "node", "left").select("node", "least", "degree")
    info = nodes.join(linked, "node", "left").filter("weight > 1 OR degree IS NOT NULL")
    info = info.select("node", F.coalesce("least", "rep").alias("least"), (F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    # read back, both sides of this join come from an exchange of their own, so a set with very many copies can be split
    joined = own.select("doc_id", "text_hash", "node", "n").join(stage(info, "ngram-links"), "node", "left")
    alone = F.col("least").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least.doc_id", "doc_id")).alias("component_id")
    hashes = ["text_hash", F.when(alone, F.col("text_hash")).otherwise(F.col("least.text_hash")).alias("component_hash")] if with_hash else []
    return joined.select("doc_id", *hashes, F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs, k=3, num=90, den=100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * o >= 90 * (s.n + t.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM reach WHERE a = w.doc_id)) AS component_id, (SELECT count(*) FROM links WHERE a = w.doc_id) AS n_links
FROM w LEFT JOIN sizes USING (doc_id)
"""
