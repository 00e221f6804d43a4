"""N-gram Jaccard self-join by R-trees over count vectors.

A document's set holds its distinct word shingles. Shingles fall into groups by their
hash, and the counts by group make the document a point: two sets share at most the sum
of the smaller counts. Points that may be similar are found by R-trees whose boxes
bound that sum, and surviving pairs are verified on the sets themselves. Larger sets have
more groups, always a power of two, so that halves of a point added up compare with the
next smaller kind, as often as sets so far apart in size can still be similar.

Points meet in blocks. Sets as similar as asked share one of each other's rarest
shingles, so every document goes to the blocks of its rarest ones: no pair is lost, and
a passage of many documents makes no block. The first rare shingle that two sets share has
all they share at or behind its place in both, so a set's size and that place bound the
sizes that it can be similar to there; a block falls apart where no such bound reaches the
next size, and sets that are left alone go. Documents with equal sets are one point.
First each point is tried against the block's smallest one that it meets most often,
which settles groups of copies with one link per copy. Only blocks whose points are
still apart are searched by R-tree; a block of many points is split, and its parts meet
in pairs, so that no task holds more than two parts.

What an R-tree finds is bounded once more in the block, by counts in 2^16 groups, which hardly
any pair passes that is not similar. A block gives a tree of its pairs, never all of them:
pairs between points that others already connect wait. Should verification refute one, its
block is searched again without it, until nothing is left to try.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cellzonal.llm.graph import components
from cellzonal.llm.text import Scratch, blocks, free_name, set_hash, shingle_rows

WIDTH = 5
#: Similarity as a fraction, to be compared in whole numbers.
AT_LEAST = (80, 100)
#: Fewest and most groups; in between there is one to two to four shingles.
FEWEST, MOST = 5, 14
#: Largest count of a group; points are most of what is shuffled, and this fits in a byte.
MOST_COUNT = 127
#: Buckets in which shingles are counted, to tell frequent ones from rare ones.
RARITY_BITS = 19
PART = 1000
LEAF = 64
#: Pairs whose finer counts are compared at once.
CHUNK = 64
#: What makes a document a point.
POINT = ("n", "counts", "beyond")


def shared_needed(total: np.ndarray | int, at_least: tuple[int, int] = AT_LEAST):
    """Fewest shared shingles of two sets whose sizes add up to total."""
    x, y = at_least
    return -(-x * total // (x + y))


def count_vector(members: np.ndarray) -> tuple[np.ndarray, int]:
    """How many shingles fall into each group, as bytes, and how many are beyond a byte.

    The latter may all be shared, so they count in full towards any bound.
    """
    bits = min(max(FEWEST, (max(len(members), 1) - 1).bit_length() - 2), MOST)
    groups = 1 << bits
    own = (members & np.uint64(groups - 1)).astype(np.int64)
    counts = np.bincount(own, minlength=groups)
    held = np.minimum(counts, MOST_COUNT)
    return held.astype(np.int8), int((counts - held).sum())


class RTree:
    """Points packed by halving the widest dimension; boxes keep the largest counts."""

    def __init__(
        self, points: np.ndarray, sizes: np.ndarray, beyond: np.ndarray, leaf: int = LEAF
    ):
        self.points, self.sizes, self.beyond, self.leaf = points, sizes, beyond, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self._pack(0, len(points))

    def _pack(self, start: int, end: int) -> int:
        at = self.order[start:end]
        own = self.points[at]
        me = len(self.nodes)
        self.nodes.append(())
        below = ()
        if end - start > self.leaf:
            axis = int(np.argmax(own.max(0) - own.min(0)))
            half = (end - start) // 2
            self.order[start:end] = at[np.argpartition(own[:, axis], half)]
            below = (self._pack(start, start + half), self._pack(start + half, end))
        bounds = (own.max(0), int(self.beyond[at].max()), int(self.sizes[at].min()))
        self.nodes[me] = (*bounds, start, end, below)
        return me

    def search(self, point: np.ndarray, size: int, beyond: int, at_least=AT_LEAST) -> np.ndarray:
        """Indices of all points that may share enough with this one."""
        found, todo = [], [0]
        while todo:
            high, further, smallest, start, end, below = self.nodes[todo.pop()]
            most = np.minimum(point, high).sum() + beyond + further
            if most < shared_needed(size + smallest, at_least):
                continue
            if below:
                todo.extend(below)
                continue
            at = self.order[start:end]
            most = np.minimum(point, self.points[at]).sum(1) + beyond + self.beyond[at]
            found.append(at[most >= shared_needed(size + self.sizes[at], at_least)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for part, data, at in blocks(batches):
        windows, bounds = shingle_rows(data, at, width)
        yield part, [np.unique(windows[a:b]) for a, b in bounds]


def size_code(sizes: np.ndarray) -> np.ndarray:
    """Twelve bits that never fall as sizes rise to 2^31: the exponent and seven bits behind it."""
    return (np.maximum(sizes, 1).astype(np.float32).view(np.uint32) >> 16) - (127 << 7)


def block_keys(rarest: np.ndarray, size: int, at_least: tuple[int, int] = AT_LEAST) -> np.ndarray:
    """40 bits of each of a set's rarest shingles, and the codes of the set's size and of the
    largest one that it can be similar to if this is the first shingle in their order that both have."""
    x, y = at_least
    most = (size - np.arange(len(rarest))) * (x + y) // x - size
    codes = size_code(np.array([size])) << 12 | size_code(most)
    return rarest >> np.uint64(24) << np.uint64(24) | codes.astype(np.uint64)


def _arrays(rows: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    values = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def packed_steps(values: np.ndarray) -> bytes:
    """Sorted numbers below 2^16: the steps between them, 255 for each 255 and then what is left, or
    two bytes each where that is shorter; the first byte tells which."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    own = np.full(len(steps) + int((steps // 255).sum()), 255, np.uint8)
    if len(own) >= 2 * len(values):
        return b"\0" + values.astype("<u2").tobytes()
    own[np.cumsum(steps // 255 + 1) - 1] = steps % 255
    return b"\1" + own.tobytes()


def unpacked_steps(packed: bytes) -> np.ndarray:
    """The numbers that packed_steps() was given."""
    if packed[:1] == b"\0":
        return np.frombuffer(packed, "<u2", offset=1)
    own = np.frombuffer(packed, np.uint8, offset=1)
    return np.cumsum(own, dtype=np.int64)[own != 255].astype(np.uint16)


def _frequencies(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """How often the shingles of each hash bucket occur: a table of fixed size."""

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for _, data, at in blocks(batches):
            windows, bounds = shingle_rows(data, at, width)
            real = np.zeros(len(windows) + 1, np.int64)
            np.add.at(real, bounds[:, 0], 1)
            np.add.at(real, bounds[:, 1], -1)
            kept = windows[np.cumsum(real)[:-1] > 0]
            seen += np.bincount(kept >> np.uint64(64 - bits), minlength=1 << bits)
        at = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array(at), "n": pa.array(seen[at])})

    rows = texts.mapInArrow(count, "bucket long, n long")
    total = np.zeros(1 << bits, np.int64)
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return total


def _profiles(texts: DataFrame, width: int, frequency: np.ndarray, at_least) -> DataFrame:
    """Per document its set's size, hash and counts, coarse and fine, and its block_keys().

    The latter are empty where the same task has had the same set.
    """
    bits = int(len(frequency)).bit_length() - 1
    x, y = at_least

    def profile(batches):
        seen: set[int] = set()
        for part, sets in _sets(batches, width):
            rare, counts, beyond, fine, nodes = [], [], [], [], []
            named = part.column("doc_id").is_valid().to_pylist()
            for u, has_id in zip(sets, named, strict=True):
                node = set_hash(u) if len(u) else None
                nodes.append(node)
                held, over = count_vector(u)
                counts.append(held)
                beyond.append(over)
                fine.append(packed_steps(np.sort(u.astype(np.uint16))))
                if node is None or not has_id or node in seen:
                    rare.append(u[:0])
                    continue
                seen.add(node)
                keep = len(u) - ceil(x * len(u) / y) + 1
                order = np.lexsort((u, frequency[u >> np.uint64(64 - bits)]))
                rare.append(block_keys(u[order[:keep]], len(u), at_least))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n": pa.array([len(u) for u in sets], pa.int64()),
                    "node": pa.array(nodes, pa.int64()),
                    "counts": _arrays(counts, pa.int8()),
                    "beyond": pa.array(beyond, pa.int64()),
                    "fine": pa.array(fine, pa.binary()),
                    "rare": _arrays(rare),
                }
            )

    kind = (
        "doc_id long, n long, node long, counts array<tinyint>, beyond long, "
        "fine binary, rare array<long>"
    )
    return texts.mapInArrow(profile, kind)


def _meetings(profiles: DataFrame) -> DataFrame:
    """The blocks of sets that may be similar: (key, node, hub), hub being a block's smallest node."""

    def with_company(rows, *by):
        same = Window.partitionBy(*by)
        rows = rows.withColumn("hub", F.min("node").over(same))
        return rows.withColumn("last", F.max("node").over(same)).where("hub <> last")

    rare = profiles.select("node", F.explode("rare").alias("rare"))
    rare = rare.repartition(F.shiftrightunsigned("rare", 24))
    met = with_company(rare.withColumn("key", F.shiftrightunsigned("rare", 24)), "key")
    met = met.select("key", "node", "rare").distinct().select(
        "key",
        "node",
        F.shiftrightunsigned("rare", 12).bitwiseAND(4095).alias("size"),
        F.col("rare").bitwiseAND(4095).alias("most"),
    )
    # Smaller sets come first; one that none of them reaches begins a block of its own.
    by_size = Window.partitionBy("key").orderBy("size", "node")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("reached", F.coalesce(F.max("most").over(before), F.lit(-1)))
    first = F.when(F.col("reached") < F.col("size"), F.col("size"))
    met = met.withColumn("first", F.max(first).over(so_far))
    own = Window.partitionBy("key", "first")
    met = met.withColumn("furthest", F.max("most").over(own))
    met = met.where("most >= first and furthest >= size")
    met = with_company(met, "key", "first")
    key = F.shiftleft("key", 12).bitwiseOR(F.col("first"))
    return met.select(key.alias("key"), "node", "hub")


def _members(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of the wanted nodes, read from the documents that stand for them."""

    def members(batches):
        for part, sets in _sets(batches, width):
            yield pa.record_batch(
                {
                    "node": pa.array([set_hash(u) for u in sets], pa.int64()),
                    "wanted": part.column("wanted"),
                    "members": _arrays(sets),
                }
            )

    rows = texts.join(wanted.select(F.col("node").alias("wanted"), "doc_id"), "doc_id")
    rows = rows.select("wanted", "text")
    rows = rows.mapInArrow(members, "node long, wanted long, members array<long>")
    return rows.where("node = wanted").select("node", "members")


def _folds(at_least) -> int:
    """How often the larger of two similar sets may have twice the groups of the smaller."""
    x, y = at_least
    return next((f for f in range(1, MOST - FEWEST) if x << f >= y), MOST - FEWEST)


def _bounded(pairs: DataFrame, points: DataFrame, at_least) -> DataFrame:
    """The pairs (a, b), with their sizes, whose count vectors allow the similarity."""
    x, y = at_least
    for name in "ab":
        own = points.select(*[F.col(c).alias(f"{name}_{c}") for c in ("node", *POINT)])
        pairs = pairs.join(own, F.col(name) == F.col(f"{name}_node")).drop(f"{name}_node")
    pairs = pairs.where(F.least("a_n", "b_n") * y >= F.greatest("a_n", "b_n") * x)
    size = F.least(F.size("a_counts"), F.size("b_counts"))

    def as_small(c):
        whole = F.col(c).cast("array<int>")
        folded = F.slice(whole, 1, size)
        for part in range(1, 1 << _folds(at_least)):
            more = F.slice(whole, size * part + 1, size)
            folded = F.zip_with(folded, more, lambda p, q: p + F.coalesce(q, F.lit(0)))
        return F.when(F.size(c) == size, whole).otherwise(folded)

    least = F.zip_with(as_small("a_counts"), as_small("b_counts"), lambda p, q: F.least(p, q))
    most = F.aggregate(least, F.lit(0), lambda s, v: s + v) + F.col("a_beyond") + F.col("b_beyond")
    may = most * (x + y) >= x * (F.col("a_n") + F.col("b_n"))
    return pairs.where(may).select("a", "b", "a_n", "b_n")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, members: DataFrame, at_least) -> DataFrame:
    """The pairs (a, b), with their sizes, whose sets are as similar as asked."""
    x, y = at_least
    members = members.join(_nodes(pairs), "node", "left_semi")
    for side in "ab":
        own = members.select(
            F.col("node").alias(f"{side}_node"), F.col("members").alias(f"{side}_members")
        )
        pairs = pairs.join(own, F.col(side) == F.col(f"{side}_node")).drop(f"{side}_node")
    shared = F.size(F.array_intersect("a_members", "b_members"))
    links = pairs.where(shared * (x + y) >= x * (F.col("a_n") + F.col("b_n")))
    return links.select("a", "b").distinct()


def _still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs of different components, with these as low and high."""
    for side in "ab":
        own = comps.select(F.col("node").alias(f"{side}_at"), F.col("comp").alias(f"{side}_comp"))
        pairs = pairs.join(own, F.col(side) == F.col(f"{side}_at"), "left").drop(f"{side}_at")
    a, b = F.coalesce("a_comp", "a"), F.coalesce("b_comp", "b")
    return pairs.where(a != b).select(
        "a", "b", "a_n", "b_n", F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    )


class FineCounts:
    """Counts of rows in 2^16 groups, held as the groups' sorted numbers."""

    def __init__(self, fine: pa.ListArray):
        ends, flat = fine.offsets.to_numpy(), fine.values.to_numpy().view(np.uint16)
        own = [np.unique(flat[a:b], return_counts=True) for a, b in zip(ends, ends[1:], strict=False)]
        self.groups = [g for g, _ in own]
        self.counts = [c for _, c in own]
        self.table = np.zeros(1 << 16, np.int64)

    def shared(self, row: int, others: np.ndarray) -> np.ndarray:
        """Most that a row may share with each of the others."""
        self.table[self.groups[row]] = self.counts[row]
        found = [np.empty(0, np.int64)]
        for start in range(0, len(others), CHUNK):
            part = others[start : start + CHUNK]
            groups = np.concatenate([self.groups[j] for j in part])
            counts = np.concatenate([self.counts[j] for j in part])
            first = np.cumsum([0, *[len(self.groups[j]) for j in part[:-1]]])
            found.append(np.add.reduceat(np.minimum(self.table[groups], counts), first))
        self.table[self.groups[row]] = 0
        return np.concatenate(found)


def _search_block(table: pa.Table, at_least) -> pa.Table:
    """Pairs of one block's two parts that may be similar, as a tree over what is apart."""
    node = table["node"].to_numpy()
    part, low, high = (table[c].to_numpy() for c in ("part", "low", "high"))
    sizes, beyond = table["n"].to_numpy(), table["beyond"].to_numpy()
    counts = table["counts"].combine_chunks()
    ends = counts.offsets.to_numpy()
    flat = counts.values.to_numpy()
    groups = np.diff(ends)
    fine = FineCounts(table["fine"].combine_chunks())
    refuted = [np.array(r or [], np.int64) for r in table["refuted"].to_pylist()]
    #: Equal numbers for what is connected, or will be if all given pairs are similar.
    label = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
    a, b = [], []

    def vectors(rows, size):
        own = np.stack([flat[ends[i] : ends[i + 1]] for i in rows])
        parts = own.shape[1] // size
        own = own.astype(np.int16 if parts <= 2 else np.int32)
        return own.reshape(len(own), parts, size).sum(1, dtype=own.dtype)

    def search(from_rows, to_rows, size, both):
        """Pairs of two kinds of points, compared at the smaller number of groups."""
        if not len(from_rows) or not len(to_rows):
            return
        tree = RTree(vectors(to_rows, size), sizes[to_rows], beyond[to_rows])
        for i, point in zip(from_rows, vectors(from_rows, size), strict=True):
            near = to_rows[tree.search(point, sizes[i], beyond[i], at_least)]
            near = near[label[near] != label[i]]
            near = near[node[near] > node[i]] if both else near
            near = near[~np.isin(node[near], refuted[i])]
            most = fine.shared(i, near)
            may = most >= shared_needed(sizes[i] + sizes[near], at_least)
            for j in near[may][np.argsort(-most[may], kind="stable")]:
                if label[j] != label[i]:
                    a.append(i)
                    b.append(j)
                    label[label == label[j]] = label[i]

    left, right = np.flatnonzero(part == low[0]), np.flatnonzero(part == high[0])
    for size in np.unique(groups):
        own, same = left[groups[left] == size], right[groups[right] == size]
        search(own, same, size, low[0] == high[0])
        for fold in range(1, _folds(at_least) + 1):
            search(own, right[groups[right] == size << fold], size, False)
            if low[0] != high[0]:
                search(same, left[groups[left] == size << fold], size, False)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    swap = node[a] > node[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table(
        {
            "a": node[a], "b": node[b], "a_n": sizes[a], "b_n": sizes[b],
            "key": np.full(len(a), table["key"][0].as_py()),
        }
    )


def _parts(rows: DataFrame, comps: DataFrame, refuted: DataFrame, part: int) -> DataFrame:
    """The nodes of blocks once for each other part of their block that theirs meets."""
    rows = rows.join(comps, "node", "left").join(refuted, "node", "left")
    parts = F.ceil(F.col("size") / part).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "key"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select(
        "key", "node", F.coalesce("comp", "node").alias("comp"), "refuted", "part",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
    )


def _search(rows: DataFrame, points: DataFrame, at_least) -> DataFrame:
    """Pairs to verify, with the keys of blocks that have them: (a, b, a_n, b_n, keys)."""
    rows = rows.join(points.select("node", *POINT, "fine"), "node")

    def search(table: pa.Table) -> pa.Table:
        fine = [unpacked_steps(p).view(np.int16) for p in table["fine"].to_pylist()]
        at = table.schema.get_field_index("fine")
        return _search_block(table.set_column(at, "fine", _arrays(fine, pa.int16())), at_least)

    found = rows.groupBy("key", "low", "high").applyInArrow(
        search, "a long, b long, a_n long, b_n long, key long"
    )
    return found.groupBy("a", "b", "a_n", "b_n").agg(F.collect_set("key").alias("keys"))


def _connected(comps: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """comps with the components that edges (a, b) join made one."""
    joined = components(edges, scratch, f"{name}-edges")
    old = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = comps.join(old, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = joined.join(comps, "node", "left_anti")
    return scratch.keep(moved.unionByName(new), name)


def jaccard_groups(
    docs: DataFrame,
    width: int = WIDTH,
    at_least: tuple[int, int] = AT_LEAST,
    rarity_bits: int = RARITY_BITS,
    part: int = PART,
) -> DataFrame:
    """Every document's group of similar ones: doc_id, n_shingles, component_id, class_key.

    docs: any columns, among them doc_id and text. Words are lower-cased in A-Z and split
    at ASCII white space. Two documents link when their shingle sets are at least
    ``at_least`` similar; component_id is the smallest doc_id reachable by links, and
    class_key the group's hash. Null and empty texts, and texts without words, have no
    shingles and link with nothing (class_key null), and so do rows without an id
    (component_id null). Rows that repeat an id are documents of their own. Sets are
    told apart by 64-bit hashes. Groups are whole, links are not: pairs within a group that
    other links already connect are not verified, and no number of links is given.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequency = _frequencies(texts.select("text"), width, rarity_bits)
    profiles = _profiles(texts, width, frequency, at_least)
    profiles = scratch.keep(profiles, "profiles")

    # Blocks: rare shingles of at least two different sets.
    shared = scratch.keep(_meetings(profiles), "shared")

    # The points: one document stands for each set that has company.
    needed = shared.select("node").distinct()
    points = profiles.where("doc_id is not null").join(needed, "node", "left_semi")
    points = points.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in (*POINT, "fine")]
    )
    points = scratch.keep(points, "points")
    own = scratch.keep(profiles.select("doc_id", "n", "node"), "own")
    scratch.drop("profiles")

    # Copies: each set against the hub that it shares most blocks with.
    star = shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
    star = star.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    star = star.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    star = scratch.keep(_bounded(star, points, at_least), "star")
    stand = points.select("node", "doc_id")
    wanted = scratch.keep(stand.join(_nodes(star), "node"), "wanted")
    members = scratch.keep(_members(texts, wanted, width), "members")
    links = scratch.keep(_verified(star, members, at_least), "links-0")
    comps = components(links, scratch, "star")

    # What is still apart within a block. Blocks of the same sets count once.
    apart = shared.join(comps, "node", "left").select(
        "key", "node", F.coalesce("comp", "node").alias("comp")
    )
    apart = scratch.keep(apart, "apart")
    block = apart.groupBy("key").agg(
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
        F.min("node").alias("a"),
        F.max("node").alias("b"),
        F.count("*").alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
    )
    block = block.where("c0 <> c1").groupBy("who", "size", "a", "b").agg(F.min("key").alias("key"))
    block = scratch.keep(block, "block")
    pairs = _bounded(block.where("size = 2").select("a", "b"), points, at_least)
    none_yet = F.array().cast("array<long>").alias("keys")
    rows = apart.join(block.where("size > 2").select("key", "size"), "key").select("key", "node", "size")
    rows = scratch.keep(rows, "rows")
    no_pairs = scratch.spark.createDataFrame([], "node long, refuted array<long>")
    # Kept, so that Spark knows how few rows they are, and points stay where they are if it can be.
    asked = scratch.keep(_parts(rows, comps, no_pairs, part), "asked-0")
    found = _search(asked, points, at_least)
    tried, turn, search, last = None, 0, 0, 0
    while True:
        # Of any two components a pair is tried, then four, and so on till none is left.
        found = found if search else found.unionByName(pairs.select("*", none_yet))
        found = scratch.keep(found, f"found-{search}")
        width_now = 1
        while True:
            turn += 1
            left = _still_apart(found, comps)
            if tried is not None:
                left = left.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            nth = Window.partitionBy("low", "high").orderBy("a", "b")
            left = left.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= width_now)
            left = scratch.keep(left.drop("nth"), f"left-{turn}")
            if left.isEmpty():
                break
            width_now *= 4
            # Sets are read from their documents as pairs ask for them.
            others = _nodes(left).join(wanted.select("node"), "node", "left_anti")
            others = scratch.keep(stand.join(others, "node"), f"others-{turn}")
            wanted = wanted.unionByName(others)
            members = members.union(scratch.keep(_members(texts, others, width), f"members-{turn}"))
            links = scratch.keep(_verified(left, members, at_least), f"links-{turn}")
            edges = left.join(links, ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b"))
            comps, last = _connected(comps, edges.distinct(), scratch, f"comps-{turn}"), turn
            now = left.select("a", "b", "a_n", "b_n")
            tried = now if tried is None else tried.union(now)
        # Pairs that were refuted, and have not met otherwise, may have hidden others.
        if tried is None:
            break
        wrong = _still_apart(tried, comps).select("a", "b")
        again = found.join(wrong, ["a", "b"]).select(F.explode("keys").alias("key")).distinct()
        again = scratch.keep(again, f"again-{search}")
        if again.isEmpty():
            break
        search += 1
        both = wrong.union(wrong.select("b", "a"))
        refuted = both.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refuted"))
        asked = _parts(rows.join(again, "key"), comps, refuted, part)
        found = _search(scratch.keep(asked, f"asked-{search}"), points, at_least)

    links_at_all = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    has = own.where(links_at_all).join(comps, "node", "left")
    has = has.select("doc_id", "n", F.coalesce("comp", "node").alias("class_key"))
    least = has.groupBy("class_key").agg(F.min("doc_id").alias("component_id"))
    has = has.join(least, "class_key")
    none = own.where(~links_at_all)
    scratch.drop(
        "shared", "points", "star", "wanted", "members", "apart", "block", "rows", "links-0",
        *[f"{name}-{i}" for name in ("found", "again", "asked") for i in range(search + 1)],
        *[f"{name}-{i}" for name in ("left", "others", "members", "links") for i in range(1, turn + 1)],
        *[f"comps-{i}" for i in range(1, last)],
    )
    return has.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_key"
    ).union(
        none.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("doc_id").alias("component_id"),
            F.lit(None).cast("long").alias("class_key"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with one left of each group: the one of the smallest id.

    Rows that repeat an id and its text count as one. Documents without words, and rows
    without an id, all stay.
    """
    marked = jaccard_groups(docs)
    kept = marked.where("n_shingles > 0 and doc_id = component_id")
    kept_id, nth = free_name("kept_id", docs.columns), free_name("kept_nth", docs.columns)
    kept = kept.select(F.col("doc_id").alias(kept_id)).distinct()
    bare = F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = docs.where(~bare).join(kept, F.col("doc_id").cast("long") == F.col(kept_id))
    same = Window.partitionBy(kept_id, F.md5("text")).orderBy(kept_id)
    found = found.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return found.select(*docs.columns).union(docs.where(bare))
