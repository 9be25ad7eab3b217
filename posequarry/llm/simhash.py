"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie of all distinct fingerprints is walked against itself: a pair of nodes
carries the number of bits in which their prefixes differ, its four pairs of
children add one where they part, and a pair over the budget is pruned with all
below it. Spark walks pairs of nodes until each is small enough for a task, which
walks on from there; a task returns a spanning star of the links of each group it
finds, and a distributed contraction joins the stars.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.llm.common import saved

BITS = 64
# Distinct fingerprints that a task holds, node pairs it walks at a time, and value
# pairs below which a node pair is compared outright: at most STEP * LEAF at a time.
NODE_ROWS, STEP, LEAF = 1 << 17, 1 << 14, 64
# Depth at which the distributed walk starts, and bits it goes down at a time.
FIRST, DOWN = 4, 2


def fingerprint(raw: bytes | None, words: int = 4) -> int:
    """64-bit SimHash, as a signed long, of the shingles of ``words`` words (A-Z lower-cased)."""
    tokens = raw.lower().split() if raw else []
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts, stops)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(text: Column, words: int = 4) -> Column:
    @F.arrow_udf("bigint")
    def column(values: pa.Array) -> pa.Array:
        return pa.array((fingerprint(v.as_py(), words) for v in values), pa.int64())

    return column(text.cast("binary"))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Links:
    """Groups of linked positions, kept as one label per position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label = further
            self.label = label


def _zeros_before(values: np.ndarray, depth: int) -> np.ndarray:
    """At k: how many of the first k values have a 0 at this depth."""
    bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
    return np.concatenate(([0], np.cumsum(bit == 0)))


def walk(a: np.ndarray, b: np.ndarray, depth: int, budget: int, links: _Links, same: bool) -> None:
    """Link all pairs of sorted values within the budget, below two nodes at ``depth``.

    Positions of ``b`` follow those of ``a`` in ``links``; with ``same`` both are one node.
    """
    base = 0 if same else len(a)
    cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    differ = int(_ones((a[:1] ^ b[:1]) >> np.uint64(BITS - depth))[0]) if depth else 0
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), differ)))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        small = (ahi - alo) * (bhi - blo) <= LEAF
        small |= depth >= BITS
        if small.any():
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            n = na * nb
            at = np.repeat(np.cumsum(n) - n, n)
            k = np.arange(len(at)) - at
            wide = np.repeat(nb, n)
            i = np.repeat(alo[small], n) + k // wide
            j = np.repeat(blo[small], n) + k % wide
            near = _ones(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            links.add(i[near], base + j[near])
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        if depth not in cuts:
            cuts[depth] = (_zeros_before(a, depth), _zeros_before(b, depth))
        za, zb = cuts[depth]
        amid, bmid = alo + za[ahi] - za[alo], blo + zb[bhi] - zb[blo]
        children = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            (amid, ahi, blo, bmid, diff + 1),
        ]
        if same:  # a node against itself has its two mixed pairs of children once
            once = (alo != blo) | (ahi != bhi)
            children[3] = tuple(x[once] for x in children[3])
        joined = [np.concatenate(x) for x in zip(*children)]
        keep = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        joined = [x[keep] for x in joined]
        for s in range(0, len(joined[0]), STEP):
            stack.append((depth + 1, *(x[s : s + STEP] for x in joined)))


def _pair_task(depth: int, budget: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(rows: pa.Table) -> pa.Table:
        value = rows["fp"].to_numpy().view(np.uint64)
        right = rows["right"].to_numpy(zero_copy_only=False).astype(bool)
        same = rows["low"][0].as_py() == rows["high"][0].as_py()
        a, b = np.sort(value[~right]), np.sort(value[right])
        if same:
            b, everything = a, a
        else:
            everything = np.concatenate([a, b])
        if not len(a) or not len(b):
            return schema.empty_table()
        links = _Links(len(everything))
        walk(a, b, depth, budget, links, same)
        member = np.flatnonzero(links.label != np.arange(len(everything)))
        signed = everything.view(np.int64)
        return pa.table({"a": signed[member], "b": signed[links.label[member]]}, schema=schema)

    return links_of


def _node(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth)


def node_pairs(values: DataFrame, budget: int, node_rows: int) -> list[tuple[int, DataFrame]]:
    """Pairs (low, high) of trie nodes to walk in one task each, by depth.

    All nodes at depth ``FIRST`` meet. A pair whose prefixes differ in more than
    ``budget`` bits goes; one that holds at most ``node_rows`` values stays; any
    other is replaced by the pairs of its descendants ``DOWN`` bits further. A crowded
    prefix, as a large group of near copies makes one, is thus cut as deep as it needs.
    """
    found, open_pairs = [], None
    for depth in range(FIRST, BITS + 1, DOWN):
        # Only prefixes in pairs still too large are counted.
        inside = values
        if open_pairs is not None:
            ends = open_pairs.select(F.col("low").alias("up")).unionAll(open_pairs.select("high")).distinct()
            inside = values.join(ends, _node(F.col("fp"), depth - DOWN) == F.col("up"), "left_semi")
        nodes = inside.groupBy(_node(F.col("fp"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        nodes = saved(nodes.withColumn("up", F.shiftrightunsigned("node", DOWN)), "trie-nodes")
        low, high = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in "lh")
        if open_pairs is None:  # at most 2 ** FIRST nodes
            parts = F.explode(F.lit(list(range(1 << FIRST))).cast("array<bigint>"))
            pairs = low.withColumn("other", parts).join(high, F.col("other") == F.col("h_node"))
            once = F.col("l_node") <= F.col("h_node")
        else:
            pairs = open_pairs.join(low, F.col("low") == F.col("l_up")).join(high, F.col("high") == F.col("h_up"))
            once = (F.col("low") != F.col("high")) | (F.col("l_node") <= F.col("h_node"))
        differing = F.bit_count(F.col("l_node").bitwiseXOR(F.col("h_node")))
        pairs = pairs.filter(once & (differing <= budget))
        size = F.col("l_n") + F.when(F.col("l_node") == F.col("h_node"), 0).otherwise(F.col("h_n"))
        fits = (size <= node_rows) | F.lit(depth + DOWN > BITS)
        pairs = saved(
            pairs.select(F.col("l_node").alias("low"), F.col("h_node").alias("high"), fits.alias("fits")), "node-pairs"
        )
        found.append((depth, pairs.filter("fits").select("low", "high")))
        open_pairs = pairs.filter("NOT fits").select("low", "high")
        if open_pairs.isEmpty():
            break
    return found


def links(values: DataFrame, budget: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all values of ``fp`` (distinct longs) within ``budget`` bits.

    Not every pair: a spanning star for each group a task finds. The pairs of nodes come
    from ``node_pairs``, so no task holds more than ``node_rows`` values however they crowd.
    """
    parts = []
    for depth, pairs in node_pairs(values, budget, node_rows):
        right = pairs.filter("low <> high")
        sides = pairs.select("low", "high", F.col("low").alias("node"), F.lit(False).alias("right")).unionAll(
            right.select("low", "high", F.col("high").alias("node"), F.lit(True).alias("right"))
        )
        dealt = values.withColumn("node", _node(F.col("fp"), depth)).join(sides, "node")
        walked = dealt.select("low", "high", "right", "fp").groupBy("low", "high")
        parts.append(walked.applyInArrow(_pair_task(depth, budget), "a bigint, b bigint"))
    return reduce(DataFrame.unionAll, parts)


def components(edges: DataFrame) -> DataFrame:
    """Root (node, root) of every node that an edge (a, b) of longs names.

    Every round hooks each node to its smallest neighbour, shortens the paths
    twice, and keeps the edges between what is still apart, until none is.
    Each table is written, so a lost executor costs one round at most.
    """
    edges = saved(edges.filter("a <> b"), "links")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        hooks = saved(hooks.withColumn("root", F.least("node", "root")), "hooks")
        far = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        short = saved(hooks.join(far, "root").select("node", F.col("_next").alias("root")), "hooks")
        far = short.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        short = saved(short.join(far, "root").select("node", F.col("_next").alias("root")), "hooks")
        rounds.append(short)
        ends = [short.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
        edges = saved(
            edges.join(ends[0], "a")
            .join(ends[1], "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .filter("a <> b")
            .distinct(),
            "links",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return roots


def near_duplicates(
    docs: DataFrame, words: int = 4, budget: int = 4, key: str | None = None, node_rows: int = NODE_ROWS
) -> DataFrame:
    """Fingerprint and component of every row: row, doc_id, fp (long), component_id, first_row.

    Reads doc_id and text (and ``key``, a column that numbers the rows; without
    it rows are numbered here). component_id is the smallest doc_id that links
    reach, null only where all are null; first_row the row of the component that
    comes first by doc_id (null last). Null and blank texts have fingerprint 0
    and link like any other, repeated rows share a component, an empty
    table gives an empty one, other columns play no part.
    """
    row = F.col(key) if key else F.monotonically_increasing_id()
    base = saved(
        docs.select(row.alias("row"), "doc_id", fingerprints(F.col("text"), words).alias("fp")), "fingerprints"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("r")))
    values = saved(base.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    roots = components(links(values.select("fp"), budget, node_rows))
    rooted = values.join(roots, values.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = saved(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(smallest, "root").select(
        F.col("fp").alias("_fp"), F.col("least.id").alias("component_id"), F.col("least.r").alias("first_row")
    )
    return base.join(named, F.col("fp") == F.col("_fp")).select("row", "doc_id", "fp", "component_id", "first_row")
