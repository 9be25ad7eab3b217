"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest and ranked; rank (i + u) / n
places them evenly on the unit interval, where u is a digest of the source between 0 and 1, so that
sources of a row or few are spread too. All sources sorted by that place
interleave in proportion, so each cut of the sequence has the mixture of the whole.
Shards are consecutive cuts whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posequarry.llm.common import offsets, saved

CELL = 1024


def interleave(docs: DataFrame, shards: int = 24, seed: int = 42, cell: int = CELL) -> DataFrame:
    """Shard and slot of every row: doc_id, source, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 8 (null: 8), text_crc32 that of the text
    (null: of no bytes). A null source is a source of its own. A null doc_id is
    shuffled like the empty string; rows alike in doc_id, size and checksum are
    exchangeable. An empty table gives an empty one. Columns beyond doc_id,
    source and text play no part.

    Two shuffles of narrow rows: by cells of the digest within a source, then by
    cells of the place, each about ``cell`` rows whatever the source's share.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = saved(
        docs.select(
            "doc_id",
            "source",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
            digest.alias("digest"),
        ),
        "shard-rows",
    )
    counts = base.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # The leading 32 bits order cells as the digest orders rows.
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    dealt = (
        base.alias("r")
        .join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
        .select("r.*", "n")
        .withColumn("cell", F.floor(lead * F.ceil(F.col("n") / cell) / F.lit(2**32)).cast("long"))
    )
    order = [F.col("digest"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    place = W.partitionBy("source", "cell").orderBy(*order)
    before = offsets(
        dealt.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("k")), ["source"], "cell", "k"
    )
    ranked = saved(
        dealt.withColumn("near", F.row_number().over(place) - 1)
        .alias("r")
        .join(
            before.alias("b"),
            F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.cell") == F.col("b.cell")),
        )
        .select(
            "r.doc_id", "r.source", "r.size", "r.text_crc32", "r.n", (F.col("near") + F.col("before")).alias("rank")
        ),
        "shard-ranks",
    )
    total = ranked.count()
    cells = max(1, -(-total // cell))
    named = F.coalesce(F.concat(F.lit("source:"), F.col("source")), F.lit("none"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 12), 16, 10).cast("long") / F.lit(2.0**48)
    placed = ranked.withColumn("place", (F.col("rank") + shift) / F.col("n")).withColumn(
        "band", F.least(F.floor(F.col("place") * cells), F.lit(cells - 1)).cast("long")
    )
    bands = offsets(
        placed.groupBy("band").agg(F.count(F.lit(1)).alias("k")).withColumn("all", F.lit(0)), ["all"], "band", "k"
    ).select(F.col("band").alias("_band"), "before")
    inside = W.partitionBy("band").orderBy("place", F.col("source").asc_nulls_last(), "rank")
    each, longer = divmod(total, shards)
    # The first ``longer`` shards hold one row more.
    head = longer * (each + 1)
    at = F.col("at")
    shard = F.when(at < head, F.floor(at / (each + 1))).otherwise(
        longer + F.floor((at - head) / max(each, 1))
    )
    slot = F.when(at < head, at % (each + 1)).otherwise((at - head) % max(each, 1))
    return (
        placed.withColumn("near", F.row_number().over(inside) - 1)
        .join(bands, F.col("band") == F.col("_band"))
        .withColumn("at", F.col("near") + F.col("before"))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            shard.cast("int").alias("shard"),
            slot.cast("long").alias("slot"),
        )
    )
