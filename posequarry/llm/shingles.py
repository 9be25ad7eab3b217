"""Near-duplicates by exact Jaccard similarity of word shingles, found by prefixes.

Two sets with similarity 0.8 or more share four fifths of the larger one, so under any
one order of all shingles the first fifth of both (and one more) have a shingle in
common. Only these prefixes are dealt out. The order puts shingles that the table holds
often last, which makes prefixes rare without losing a pair. All documents are counted.

Sets that share a prefix shingle are compared by parity sketches first: every shingle flips one bit, so the bits
in which two sketches differ are at most the shingles in which the sets differ, and too many reject a pair for certain.
The pairs that op10's walk of the fingerprint trie links come first. Rounds link each set to the one most like it in a group, which joins large groups of near copies by few
pairs; then all pairs between what is still apart are compared. Texts are fetched
for the pairs that are left, and only their exact similarity makes a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.llm.common import arrow_batches, marks, saved, selected
from posequarry.llm import simhash
from posequarry.llm.simhash import components

# Similarity NUM / DEN.
WORDS, NUM, DEN = 5, 4, 5
# Counts of the order, how many of them travel together, and the count from which a bucket is told apart.
BUCKETS, CHUNK, OFTEN = 1 << 24, 1 << 16, 8
# Shingles that a task holds before it hands on their counts.
PACKED = 1 << 21
# Bits of a sketch: two to four a shingle, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 15
# Rounds of best links, and sets that meet in one task then; sets of a tile when all pairs meet.
ROUNDS, GROUP, TILE = 2, 1000, 4096
# Texts handed to Python at a time.
BATCH = 500
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words (A-Z lower-cased), of all words if they are fewer.

    A blank or missing text has the one shingle 0.
    """
    tokens = raw.lower().split() if raw else []
    if not tokens:
        return np.zeros(1, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for token in set(tokens):
        known[token] = digest(token, 42)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is NUM / DEN or more."""
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= (len(a) + len(b) - both) * NUM


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; the halves of a sketch xored give the one of half its size."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()), MOST_BITS)
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def bucket_ranks(texts: DataFrame, often: int = OFTEN) -> np.ndarray:
    """Rank of each bucket in the order: 0, or the steps of a factor of two that its shingles of the texts are above ``often``.

    Tasks count all their texts and hand on packed counts of the buckets they met, which are added up chunk by chunk;
    a byte a bucket, compressed, reaches the driver.
    """

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(at, np.arange(0, BUCKETS + 1, CHUNK))
        chunks = np.flatnonzero(ends[1:] > ends[:-1])
        values = []
        for k in chunks.tolist():
            mine = slice(ends[k], ends[k + 1])
            gaps = np.diff(at[mine] - k * CHUNK, prepend=0).astype(np.uint16)
            values.append(pa.compress(gaps.tobytes() + n[mine].astype(np.uint32).tobytes(), "zstd", asbytes=True))
        columns = [pa.array(chunks, pa.int32()), pa.array(np.diff(ends)[chunks], pa.int32()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "size", "held"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for v in batch.column(0):
                held.append((shingles(v.as_py()) % np.uint64(BUCKETS)).astype(np.int32))
                size += len(held[-1])
                if size >= PACKED:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = None, np.zeros(0)

        def ended() -> pa.RecordBatch:
            ranks = np.where(n >= often, np.ceil(np.log2(n / often + 1)), 0).astype(np.uint8)
            value = pa.compress(ranks.tobytes(), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([value], pa.binary())], ["chunk", "held"])

        for batch in batches:
            for k, size, held in zip(*(c.to_pylist() for c in batch.columns)):
                if k != chunk:
                    if chunk is not None:
                        yield ended()
                    chunk, n = k, np.zeros(CHUNK, np.int64)
                raw = pa.decompress(held, size * 6, "zstd")
                n[np.cumsum(np.frombuffer(raw, np.uint16, size), dtype=np.int64)] += np.frombuffer(raw, np.uint32, size, size * 2)
        if chunk is not None:
            yield ended()

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(count, "chunk int, size int, held binary")
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk")
    ranks = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint8)
    for row in dealt.mapInArrow(ranked, "chunk int, held binary").collect():
        ranks[row["chunk"]] = np.frombuffer(pa.decompress(bytes(row["held"]), CHUNK, "zstd"), np.uint8)
    return ranks.reshape(-1)


def described(text: Column, ranks: np.ndarray) -> Column:
    """digest and size of each text's set, its prefix (one of it any similar set has in its own), and its sketch."""

    @F.arrow_udf("struct<digest: binary, n: int, prefix: array<bigint>, sketch: binary>")
    def column(values: pa.Array) -> pa.Array:
        digests, sizes, prefixes, sketches = [], [], [], []
        for v in values:
            s = shingles(v.as_py())
            order = np.argsort(ranks[(s % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sizes.append(len(s))
            prefixes.append(s[order[: len(s) - -(-len(s) * NUM // DEN) + 1]].view(np.int64))
            sketches.append(sketch(s))
        fields = [
            pa.array(digests, pa.binary()),
            pa.array(sizes, pa.int32()),
            pa.array(prefixes, pa.list_(pa.int64())),
            pa.array(sketches, pa.binary()),
        ]
        return pa.StructArray.from_arrays(fields, ["digest", "n", "prefix", "sketch"])

    return column.asNondeterministic()(text.cast("binary"))


# --- pairs by sketch


class Meeting:
    """Sets of one group in order, each of which can be compared with all before it at once."""

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n = n
        self.size = np.array([len(s) for s in sketches])
        self.whole, self.half, self.at = {}, {}, {}
        for size in np.unique(self.size):
            at = np.flatnonzero(self.size == size)
            rows = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)
            self.at[size], self.whole[size] = at, rows
            if size * 8 > LEAST_BITS:
                middle = rows.shape[1] // 2
                self.half[size] = rows[:, :middle] ^ rows[:, middle:]

    def before(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets before the i-th that may be similar to it, and in how many bits their sketches differ."""
        size = self.size[i]
        mine = int(np.searchsorted(self.at[size], i))
        found, bits = [], []
        for other, rows, own in (
            (size, self.whole[size], self.whole[size][mine]),
            (size // 2, self.whole.get(size // 2), self.half[size][mine] if size in self.half else None),
            (size * 2, self.half.get(size * 2), self.whole[size][mine]),
        ):
            if rows is None or own is None:
                continue
            at = self.at[other][: int(np.searchsorted(self.at[other], i))]
            if not len(at):
                continue
            differ = np.bitwise_count(rows[: len(at)] ^ own).sum(axis=1, dtype=np.int64)
            low, high = np.minimum(self.n[at], self.n[i]), np.maximum(self.n[at], self.n[i])
            # Similar sets differ in at most (DEN - NUM) / (DEN + NUM) of their sizes together.
            may = (differ * (DEN + NUM) <= (low + high) * (DEN - NUM)) & (low * DEN >= high * NUM)
            found.append(at[may])
            bits.append(differ[may])
        return (np.concatenate(found), np.concatenate(bits)) if found else (np.zeros(0, int), np.zeros(0, int))


def best_links(group: pa.Table) -> tuple[list[int], list[int]]:
    """For each set of a group the most alike of those before it that has another root."""
    row, root = group["row"].to_numpy(), group["root"].to_numpy()
    meeting, a, b = Meeting(group["n"].to_numpy(), group["sketch"].to_pylist()), [], []
    for i in range(1, len(row)):
        at, bits = meeting.before(i)
        apart = root[at] != root[i]
        if apart.any():
            at, bits = at[apart], bits[apart]
            a.append(int(row[i]))
            b.append(int(row[at[np.argmin(bits / (meeting.n[at] + meeting.n[i]))]]))
    return a, b


def all_links(group: pa.Table) -> tuple[list[int], list[int]]:
    """All pairs of a group with different roots; of two tiles, those across them."""
    row, root, tile = (group[c].to_numpy() for c in ("row", "root", "tile"))
    across = group["low"][0].as_py() != group["high"][0].as_py()
    meeting, a, b = Meeting(group["n"].to_numpy(), group["sketch"].to_pylist()), [], []
    for i in range(1, len(row)):
        at, _ = meeting.before(i)
        at = at[(root[at] != root[i]) & (not across or tile[at] != tile[i])]
        a.extend([int(row[i])] * len(at))
        b.extend(row[at].tolist())
    return a, b


def _grouped(rows: DataFrame, keys: list[str], links: Callable[[pa.Table], tuple[list[int], list[int]]]) -> DataFrame:
    """Pairs (a, b), a < b, that ``links`` finds in each group of ``keys``, streamed from sorted partitions."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups:
            for out, part in zip((a, b), links(group)):
                out.extend(part)
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        yield from pa.table([pa.array(low), pa.array(high)], schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            changes = _changes(rest, keys)
            if len(changes):
                ends = [0, *changes.tolist()]
                yield from found([rest.slice(s, e - s).combine_chunks() for s, e in zip(ends, ends[1:]) if e - s > 1])
                rest = rest.slice(ends[-1])
        if rest is not None and len(rest) > 1:
            yield from found([rest.combine_chunks()])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("row"))
    return dealt.mapInArrow(run, "a long, b long")


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which another group starts."""
    differs = np.zeros(max(len(rows) - 1, 0), bool)
    for key in keys:
        values = rows[key].to_numpy()
        differs |= values[1:] != values[:-1]
    return np.flatnonzero(differs) + 1


# --- links


def similar_texts(left: Column, right: Column) -> Column:
    @F.arrow_udf("boolean")
    def column(a: pa.Array, b: pa.Array) -> pa.Array:
        of = lru_cache(64)(shingles)
        return pa.array((similar(of(x.as_py()), of(y.as_py())) for x, y in zip(a, b)), pa.bool_())

    return column(left.cast("binary"), right.cast("binary"))


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, ids: list[str]) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Only texts of the pairs' rows are moved."""
    ends = pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct()
    asked = saved(rows.select("row", *ids).join(ends, "row"), "asked")
    texts = selected(docs.select(*ids, "text"), ids, marks(asked, ids)).join(asked, ids).select("row", "text")
    texts = saved(texts, "asked-texts")
    left, right = (texts.select(F.col("row").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return saved(pairs.join(left, "a").join(right, "b").filter(similar_texts(F.col("ta"), F.col("tb"))).select("a", "b"), "similar")


def linked_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows that op10 links: those of one ``fp`` in a star, and one pair for each of its links."""
    held = saved(rows.groupBy("fp").agg(F.min("row").alias("at")), "distinct-fingerprints")
    star = rows.join(held, "fp").select(F.col("at").alias("a"), F.col("row").alias("b"))
    left, right = (held.select(F.col("fp").alias(f"_{c}"), F.col("at").alias(f"_at_{c}")) for c in "ab")
    across = simhash.links(held.select("fp")).join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    across = across.select(F.least("_at_a", "_at_b").alias("a"), F.greatest("_at_a", "_at_b").alias("b"))
    return star.unionAll(across).filter("a <> b")


def links(
    rows: DataFrame, docs: DataFrame, ids: list[str], rounds: int = ROUNDS, group: int = GROUP, tile: int = TILE
) -> DataFrame | None:
    """Links (a, b) that connect all similar rows of (row, ids, n, fp, prefix, sketch); their sets are distinct.

    Rows whose fingerprints op10 links are checked first. ``rounds`` only save work: each row goes to the group of its most common prefix shingle that still
    has rows apart, cut at random to about ``group`` rows, and links to the most alike there. At the end
    every pair that shares a prefix shingle and is still apart meets; a crowded shingle is
    cut into tiles, of which any two meet in a task of their own. None without rows.
    """
    dealt = rows.select("row", "n", F.explode("prefix").alias("shingle"))
    often = dealt.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("shingle")
    shared = saved(dealt.join(often, "shingle").withColumn("root", F.col("row")), "shared-prefixes")
    edges = tried = None

    def linked(pairs: DataFrame) -> DataFrame:
        nonlocal edges, tried
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "candidates")
        found = verified(pairs, rows, docs, ids)
        edges = found if edges is None else edges.unionAll(found)
        tried = pairs if tried is None else tried.unionAll(pairs)
        return found

    def apart() -> DataFrame:
        least = shared.groupBy("shingle").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("k")
        )
        still = least.filter("least <> most").select("shingle", "k")
        return saved(shared.select("row", "n", "root", "shingle").join(still, "shingle"), "apart")

    def labelled(shared: DataFrame) -> DataFrame:
        roots = components(edges).select(F.col("node").alias("row"), F.col("root").alias("_root"))
        shared = shared.join(roots, "row", "left").withColumn("root", F.coalesce("_root", "root"))
        return saved(shared.select("shingle", "row", "n", "root"), "labelled")

    if not linked(linked_fingerprints(rows)).isEmpty():
        shared = labelled(shared)
    sketches = rows.select("row", "sketch")
    for turn in range(rounds):
        shared = apart()
        chosen = shared.groupBy("row", "n", "root").agg(F.max(F.struct("k", "shingle")).alias("c"))
        part = F.pmod(F.xxhash64("row", F.lit(turn)), F.ceil(F.col("c.k") / group))
        chosen = chosen.select("row", "n", "root", F.col("c.shingle").alias("shingle"), part.alias("part"))
        found = linked(_grouped(chosen.join(sketches, "row"), ["shingle", "part"], best_links))
        if found.isEmpty():
            break
        shared = labelled(shared)
    tiles = F.ceil(F.col("k") / tile)
    rest = apart().withColumn("tile", F.pmod(F.xxhash64("row", F.lit("tile")), tiles))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    rest = rest.select("row", "n", "root", "shingle", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    linked(_grouped(rest.join(sketches, "row"), ["shingle", "low", "high"], all_links))
    return edges


def near_duplicates(docs: DataFrame, ids: list[str], often: int = OFTEN, **limits: int) -> DataFrame:
    """Component of every row under similarity 0.8 of five-word shingles: ids, doc_id, component_id, first.

    Reads doc_id, text and ``ids``, two columns that identify the rows (``common.located``). Rows whose
    sets are equal, as those of blank texts, are one component from the start. component_id is the smallest doc_id that
    links reach, null only where all are null; first marks the row of a component that comes first by doc_id (null last).
    An empty table gives an empty one; other columns play no part. ``often`` is that of ``bucket_ranks``, ``limits`` are those of ``links``.
    """
    with arrow_batches(docs.sparkSession, BATCH):
        ranks = bucket_ranks(docs, often)
        number = F.monotonically_increasing_id().alias("row")
        base = docs.select(number, *ids, "doc_id", simhash.fingerprints(F.col("text")).alias("fp"), described(F.col("text"), ranks).alias("s"))
        base = saved(base.select("row", *ids, "doc_id", "fp", "s.*"), "shingle-sets")
        none = F.col("doc_id").isNull()
        order = F.min(F.struct(none.alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("r")))
        values = saved(base.groupBy("digest").agg(order.alias("first")), "distinct-sets")
        firsts = values.select(F.col("first.r").alias("row"))
        chosen = saved(base.join(firsts, "row").drop("digest", "doc_id"), "chosen-rows")
        roots = components(links(chosen, docs, ids, **limits))
    rooted = values.join(roots, F.col("first.r") == roots.node, "left").select(
        "digest", "first", F.coalesce("root", F.col("first.r")).alias("root")
    )
    rooted = saved(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(smallest, "root").select("digest", F.col("least.id").alias("component_id"), F.col("least.r").alias("_first"))
    return base.join(named, "digest").select(*ids, "doc_id", "component_id", (F.col("row") == F.col("_first")).alias("first"))
