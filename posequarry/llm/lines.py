"""Line dedup: repeated lines go, and what stays is a bitmap per document.

Line digests are dealt out in ranges of (digest, document, position) and sorted so,
which cuts the lines of one digest over as many tasks as they need. Each task streams
its sorted lines and hands on the first documents of every digest only; a digest is
crowded if it has as many as asked. Text never moves with the digests: a
document's keep bitmap is written as its runs of dropped lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posequarry.llm.common import fresh, located, saved

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGEST = ["h1", "h2"]
# Spark hands on the first rows of a key before its shuffle up to this many.
STREAMED = 1000


def hashed_lines(docs: DataFrame, ids: list[str], min_chars: int = 1) -> DataFrame:
    """Digest (h1, h2) of the key of every line with at least ``min_chars`` code points: ids, doc_id, pos, h1, h2.

    The key is the line without white space at its ends, A-Z lower-cased.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    rows = docs.select(*ids, "doc_id", F.posexplode(lines).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    rows = rows.select(*ids, "doc_id", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select(*ids, "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def first_documents(lines: DataFrame, ids: list[str], n: int) -> DataFrame:
    """The lines of the first ``n`` documents of every digest, with ``nth`` from 1: documents by doc_id (null last)."""
    order = [F.col("doc_id").asc_nulls_last(), *ids]
    dealt = lines.repartitionByRange(*DIGEST, *order, "pos").sortWithinPartitions(*DIGEST, *order, "pos")
    return dealt.withColumn("nth", F.dense_rank().over(W.partitionBy(*DIGEST).orderBy(*order))).filter(F.col("nth") <= n)


def crowded(lines: DataFrame, ids: list[str], min_docs: int) -> DataFrame:
    """Digests (h1, h2) found in at least ``min_docs`` documents."""
    if min_docs <= STREAMED:
        return first_documents(lines, ids, min_docs).filter(F.col("nth") == min_docs).select(*DIGEST).distinct()
    once = lines.select(*DIGEST, *ids).distinct()
    return once.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select(*DIGEST)


def keep_bitmaps(
    docs: DataFrame, ids: list[str], min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """Keep bitmap of every document that loses a line: ids, dropped.

    dropped holds the bitmap's runs of zeros, (start, n) by start; all other lines stay.
    With ``keep_first`` the first line of a crowded key, by document and position, stays too.
    """
    lines = saved(hashed_lines(docs, ids, min_chars), "line-digests")
    gone = saved(crowded(lines, ids, min_docs), "crowded-lines")
    drops = lines.join(gone, DIGEST, "left_semi").select(*ids, "pos", *DIGEST)
    if keep_first:
        heads = first_documents(lines, ids, 1).groupBy(*DIGEST)
        heads = heads.agg(F.min(F.struct(*ids, "pos")).alias("head")).select(*DIGEST, "head.*")
        drops = drops.join(heads, [*DIGEST, *ids, "pos"], "left_anti")
    nth = F.row_number().over(W.partitionBy(*ids).orderBy("pos"))
    runs = drops.select(*ids, "pos", (F.col("pos") - nth).alias("run")).groupBy(*ids, "run")
    runs = runs.agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """The table with ``text`` without its repeated lines, and n_lines, n_dropped, dropped (the bitmap).

    Reads doc_id and text; each row is a document of its own, also with a repeated or null doc_id.
    A null or empty text is one empty line, and its text comes back empty; lines of
    white space only have no key and stay (with ``min_chars`` 0 the empty key counts like any other). A
    document that loses all lines has an empty text. An empty table gives an empty one; columns named like
    the new ones are replaced, all others stay as they are. Two 64-bit digests tell keys apart.
    """
    rows, ids = located(docs)
    bitmaps = keep_bitmaps(rows, ids, min_docs, min_chars, keep_first)
    lines_, dropped_ = fresh(rows, "_lines", "_dropped")
    found = rows.join(bitmaps.withColumnRenamed("dropped", dropped_), ids, "left")
    found = found.withColumn(lines_, F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    runs = F.coalesce(F.col(dropped_), F.array().cast("array<struct<start:int,n:int>>"))
    size = F.size(lines_)
    # What stays lies between the end of one run and the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["n"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(size))
    between = F.zip_with(ends, starts, lambda e, s: F.slice(lines_, e + 1, s - e))
    return found.withColumns(
        {
            "text": F.array_join(F.flatten(between), "\n"),
            "n_lines": size.cast("long"),
            "n_dropped": F.aggregate(runs, F.lit(0).cast("long"), lambda t, r: t + r["n"]),
            "dropped": runs,
        }
    ).drop(*ids, lines_, dropped_)
