"""The trie of all conversations' beginnings, packed as double arrays by prefix shard.

Conversations are sequences of turns, a turn being a pair of 64-bit hashes of its role and
text, so texts never leave the task that reads them. Equal sequences are one path with a
number of members. A prefix below which there are more turns than a shard may hold is an
upper node; every other node belongs to the shard of its nearest upper node, which is
split by its children as often as its turns ask for. A shard numbers its turns densely,
packs BASE and CHECK, and walks its paths through them. What shards find below an upper
node is added up globally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellzonal.llm.text import Scratch, mix

#: Turns that a shard holds, give or take those of one child of an upper node.
SHARD_TURNS = 20_000
#: Consecutive conv_ids whose members are spelled together before they are hashed.
CHUNK = 4096
FAMILY, HEADS = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PATH = "k1 array<long>, k2 array<long>, bytes array<long>"
_NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


class DoubleArray:
    """A trie of integer sequences: the child of s by c is t = BASE[s] + c if CHECK[t] = s.

    Codes are given to turns as they are first met, level by level, so that siblings lie
    close together. An only child takes the lowest free slot; BASE may be negative.
    ``order`` has the slots level by level, the root, slot 0, first.
    """

    def __init__(self, paths: Sequence[Sequence[int]]):
        paths = sorted(map(tuple, paths))
        self.code: dict[int, int] = {}
        self.base, self.check = [0], [0]
        self.order = [0]
        self._free = 1
        level = [(0, 0, len(paths))]
        depth = 0
        while level:
            below = []
            for slot, low, high in level:
                while low < high and len(paths[low]) == depth:
                    low += 1
                children = []
                while low < high:
                    turn, start = paths[low][depth], low
                    while low < high and paths[low][depth] == turn:
                        low += 1
                    code = self.code.setdefault(turn, len(self.code) + 1)
                    children.append((code, start, low))
                if not children:
                    continue
                base = self._place([c for c, _, _ in children])
                self.base[slot] = base
                for code, start, end in children:
                    self._take(base + code, slot)
                    below.append((base + code, start, end))
            level = below
            depth += 1

    def _is_free(self, slot: int) -> bool:
        return slot >= len(self.check) or self.check[slot] < 0

    def _place(self, codes: list[int]) -> int:
        while not self._is_free(self._free):
            self._free += 1
        least = min(codes)
        if all(self._is_free(self._free - least + c) for c in codes):
            return self._free - least
        return len(self.check) - least

    def _take(self, slot: int, parent: int) -> None:
        while len(self.check) <= slot:
            self.base.append(0)
            self.check.append(-1)
        self.check[slot] = parent
        self.order.append(slot)

    def walk(self, path: Sequence[int]) -> Iterator[int]:
        """The slots that a sequence passes, the root left out; stops where there is none."""
        slot = 0
        for turn in path:
            code = self.code.get(turn)
            step = self.base[slot] + code if code else -1
            if not 0 < step < len(self.check) or self.check[step] != slot:
                return
            slot = step
            yield slot


def head_size(conv_id: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id with the turns of its rebuilt conversation: arrays k1, k2 and bytes.

    The first turns of the family's first conversation are followed by the own turns
    behind as many of one's own. One shuffle by family does it, without texts.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
        "conv_id",
        "turn",
        "role",
        F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64("role", "text").alias("k1"),
        F.xxhash64(F.lit("second"), "role", "text").alias("k2"),
    )
    in_turn = Window.partitionBy("family", "conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "role", "bytes", "k1", "k2"
    )
    turns = turns.withColumn("place", F.row_number().over(in_turn))
    whole = Window.partitionBy("family")
    turns = turns.withColumn("relatives", F.collect_set("conv_id").over(whole))
    place = F.col("place")
    own = F.when(place > head_size(F.col("conv_id")), F.array("conv_id"))
    head = F.when(
        F.col("conv_id") == F.col("family"),
        F.filter("relatives", lambda c: head_size(c) >= place),
    )
    none = F.array().cast("array<long>")
    used = F.concat(F.coalesce(own, none), F.coalesce(head, none))
    steps = F.transform(used, lambda c: F.struct(c.alias("conv_id"), place.alias("place")))
    # A row of place 0 for each conversation, which may turn out to have no turns at all.
    there = F.array(F.struct(F.col("conv_id"), F.lit(0).alias("place")))
    steps = F.concat(steps, F.when(place == 1, there).otherwise(F.slice(there, 1, 0)))
    rows = turns.select("family", "k1", "k2", "bytes", F.inline(steps))
    step = F.struct("place", "k1", "k2", "bytes")
    paths = rows.groupBy("family", "conv_id").agg(F.collect_list(step).alias("steps"))
    steps = F.array_sort(F.filter("steps", lambda s: s["place"] > 0))
    paths = paths.withColumn("steps", steps)
    return paths.select("conv_id", *[F.col(f"steps.{c}").alias(c) for c in ("k1", "k2", "bytes")])


def prefix_keys(k: np.ndarray, salt: int) -> np.ndarray:
    """A hash of every prefix of a path, the empty one left out."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(k) + 1, dtype=np.uint64) * np.uint64(2 * salt + 1)
        own = mix(mix(k.view(np.uint64)) + mix(place))
    return np.bitwise_xor.accumulate(own).view(np.int64) if len(k) else k


def _paths(conversations: DataFrame) -> DataFrame:
    """Different paths: k1, k2, bytes, prefix keys p1 and p2, n, conv_id and ends.

    ends is the digest of all members' ids. Members are spelled in chunks of near ids
    first, and a path's chunks are then read in order, never held together.
    """
    convs = rebuilt(conversations)
    chunks = convs.groupBy(
        F.xxhash64("k1").alias("s1"),
        F.xxhash64("k2").alias("s2"),
        F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk"),
    ).agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list("conv_id")).alias("ids"),
        *[F.first(c).alias(c) for c in ("k1", "k2", "bytes")],
    )
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    chunks = chunks.withColumn("ids", ids).repartition("s1", "s2")
    chunks = chunks.sortWithinPartitions("s1", "s2", "chunk")

    def whole(batches):
        path = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if path and (path["s1"], path["s2"]) == (row["s1"], row["s2"]):
                    path["n"] += row["n"]
                    path["digest"].update(b"," + row["ids"].encode())
                    continue
                if path:
                    done.append(path)
                path = {**row, "digest": hashlib.sha256(row["ids"].encode())}
            if done:
                yield _path_rows(done)
        if path:
            yield _path_rows([path])

    kind = f"{_PATH}, p1 array<long>, p2 array<long>, n long, conv_id long, ends string"
    return chunks.mapInArrow(whole, kind)


def _path_rows(paths: list[dict]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    keys = {
        p: [prefix_keys(np.array(r[k], np.int64), salt) for r in paths]
        for salt, (p, k) in enumerate((("p1", "k1"), ("p2", "k2")), 1)
    }
    return pa.record_batch(
        {
            **{c: pa.array([r[c] for r in paths], longs) for c in ("k1", "k2", "bytes")},
            **{c: pa.array(own, longs) for c, own in keys.items()},
            "n": pa.array([r["n"] for r in paths], pa.int64()),
            "conv_id": pa.array([r["conv_id"] for r in paths], pa.int64()),
            "ends": pa.array([r["digest"].hexdigest() for r in paths], pa.string()),
        }
    )


def shard_nodes(table: pa.Table) -> pa.Table:
    """All nodes of one shard; those right below the upper node come without a parent."""
    rows = table.select(["n", "conv_id", "ends", "depth"]).to_pylist()
    k1, k2, sizes = (table[c].combine_chunks() for c in ("k1", "k2", "bytes"))
    ends = k1.offsets.to_numpy()
    pairs = np.stack([k1.values.to_numpy(), k2.values.to_numpy()], 1)
    turn = np.unique(pairs, axis=0, return_inverse=True)[1].ravel().tolist()
    size = sizes.values.to_numpy()[ends[0] : ends[-1]].tolist()
    paths = [turn[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    trie = DoubleArray(paths)
    slots = len(trie.check)
    depth, count, least, last = [0] * slots, [0] * slots, [0] * slots, [0] * slots
    members = [NO_ENDS] * slots
    for row, path, at in zip(rows, paths, ends - ends[0], strict=False):
        for d, slot in enumerate(trie.walk(path)):
            least[slot] = min(least[slot], row["conv_id"]) if count[slot] else row["conv_id"]
            count[slot] += row["n"]
            depth[slot] = row["depth"] + d + 1
            last[slot] = size[at + d]
        members[slot] = row["ends"]
    children, leaves, saved = [0] * slots, [0] * slots, [0] * slots
    for slot in reversed(trie.order[1:]):
        parent = trie.check[slot]
        leaves[slot] = leaves[slot] or 1
        saved[slot] += (count[slot] - 1) * last[slot]
        children[parent] += 1
        leaves[parent] += leaves[slot]
        saved[parent] += saved[slot]
    made = trie.order[1:]
    first = table.slice(0, 1)
    out = {
        "u1": pa.array(first["u1"].to_pylist() * len(made), pa.int64()),
        "u2": pa.array(first["u2"].to_pylist() * len(made), pa.int64()),
        "depth": [depth[s] for s in made],
        "conv_id": [least[s] for s in made],
        "parent_conv_id": pa.array(
            [least[trie.check[s]] if trie.check[s] else None for s in made], pa.int64()
        ),
        "n_convs": [count[s] for s in made],
        "n_children": [children[s] for s in made],
        "n_leaves": [leaves[s] for s in made],
        "saved_tokens": [saved[s] for s in made],
        "ends_sha256": [members[s] for s in made],
    }
    return pa.table(out)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node: depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    conversations: any columns, among them conv_id, turn, role and text. Turns are ordered by
    turn, null first; ties by role, bytes of text and hashes of both. A null role or text is
    empty; rows without a conv_id belong to no conversation, and equal rows are turns of
    their own. Conversations without a turn are members of the root alone. A table
    without conversations gives no rows. Turns are told apart by 128 bits of hash.

    A single conversation is never split: at some forty bytes a turn, its turns must fit
    in a worker. Everything else is bounded by ``shard_turns``, whatever is common.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    paths = scratch.keep(_paths(conversations), "paths")
    length = F.size("k1")
    root = F.array(F.lit(0).cast("long"))
    paths = paths.select(
        "k1", "k2", "bytes", "n", "conv_id", "ends", length.alias("length"),
        F.concat(root, "p1").alias("p1"), F.concat(root, "p2").alias("p2"),
        F.monotonically_increasing_id().alias("path"),
    )
    paths = scratch.keep(paths, "numbered")
    scratch.drop("paths")

    # Upper nodes: prefixes of more turns than a shard holds, and the root.
    key = F.posexplode(F.arrays_zip("p1", "p2")).alias("depth", "p")
    on = paths.select("path", "length", "n", "conv_id", key)
    on = on.select("path", "length", "n", "conv_id", "depth", "p.p1", "p.p2")
    upper = on.groupBy("depth", "p1", "p2").agg(
        F.sum(F.col("length").cast("long")).alias("turns"),
        F.count("*").alias("paths"),
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    )
    upper = upper.where((F.col("depth") == 0) | (F.col("turns") > shard_turns) & (F.col("paths") > 1))
    upper = scratch.keep(upper, "upper")

    # Every path's nearest upper node, and the shard of what is below it.
    names = upper.select("depth", "p1", "p2", "turns")
    at = on.select("path", "depth", "p1", "p2").join(names, ["depth", "p1", "p2"])
    at = at.groupBy("path").agg(F.max_by("turns", "depth").alias("turns"), F.max("depth").alias("depth"))
    placed = scratch.keep(paths.join(at, "path"), "placed")
    depth = F.col("depth")
    here = [F.element_at(p, depth + 1).alias(u) for p, u in (("p1", "u1"), ("p2", "u2"))]
    below = placed.where(F.col("length") > depth)
    shards = F.ceil(F.col("turns") / shard_turns)
    next_key = F.xxhash64(F.element_at("p1", depth + 2), F.element_at("p2", depth + 2))
    below = below.select(
        *here,
        F.pmod(next_key, shards).alias("shard"),
        depth.cast("long").alias("depth"),
        *[F.slice(c, depth + 1, F.col("length") - depth).alias(c) for c in ("k1", "k2", "bytes")],
        "n", "conv_id", "ends",
    )
    found = below.groupBy("u1", "u2", "shard").applyInArrow(
        shard_nodes, f"u1 long, u2 long, {_NODE}"
    )
    found = scratch.keep(found, "found")

    # What every upper node has of its own: last text, ends, sums over its shards.
    tops = found.where("parent_conv_id is null").groupBy("u1", "u2").agg(
        F.count("*").alias("tops"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"),
    )
    ended = placed.where(F.col("length") == depth).select(*here, F.col("ends").alias("own_ends"))
    # One path stands for each upper node's line of ancestors.
    lines = on.select("path", "depth", "p1", "p2").join(names, ["depth", "p1", "p2"])
    lines = lines.groupBy("depth", "p1", "p2").agg(F.min("path").alias("path"))
    lines = lines.join(paths.select("path", "bytes", F.col("p1").alias("l1"), F.col("p2").alias("l2")), "path")
    lines = lines.select(
        "depth", "p1", "p2",
        F.when(depth > 0, F.element_at("bytes", F.greatest(depth, F.lit(1)))).otherwise(F.lit(0)).alias("last"),
        F.slice(F.arrays_zip("l1", "l2"), F.lit(1), depth + 1).alias("line"),
    )
    u = (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2"))
    upper = upper.join(lines, ["depth", "p1", "p2"])
    upper = upper.join(tops, u, "left").drop("u1", "u2")
    upper = upper.join(ended, u, "left").drop("u1", "u2")
    upper = upper.select(
        "depth", "p1", "p2", "n_convs", "conv_id", "line",
        F.coalesce("tops", F.lit(0)).alias("tops"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("last")).alias("saved"),
        F.coalesce("own_ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    upper = scratch.keep(upper, "upper-2")
    sums = upper.select("depth", "tops", "leaves", "saved", F.posexplode("line").alias("to", "key"))
    sums = sums.groupBy("to", "key.l1", "key.l2").agg(
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
        F.sum(F.when(F.col("depth") == F.col("to") + 1, 1).otherwise(0)).alias("uppers"),
    )
    parent = upper.select(
        F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("upper_conv_id")
    )
    top = upper.join(
        sums,
        (F.col("depth") == F.col("to")) & (F.col("p1") == F.col("l1")) & (F.col("p2") == F.col("l2")),
    )
    before = F.element_at("line", F.greatest(depth, F.lit(1)))
    top = top.select("*", before["l1"].alias("b1"), before["l2"].alias("b2"))
    top = top.join(parent, (F.col("b1") == F.col("u1")) & (F.col("b2") == F.col("u2")))
    children = F.col("tops") + F.col("uppers")
    columns = [c.split()[0] for c in _NODE.split(", ")]
    top = top.select(
        depth.cast("long").alias("depth"),
        "conv_id",
        F.when(depth > 0, F.col("upper_conv_id")).alias("parent_conv_id"),
        "n_convs",
        children.alias("n_children"),
        F.when(children == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        "saved_tokens",
        "ends_sha256",
    ).select(*columns)
    rest = found.join(parent, ["u1", "u2"]).withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id")
    )
    scratch.drop("upper")
    return top.unionByName(rest.select(*columns))
