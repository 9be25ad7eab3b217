"""Licence scan by canonical digest.

A text is reduced to a canonical form: lower case, no copyright lines, no
punctuation, one space between words, one spelling of words that have two. Two texts that differ
in nothing else have the same digest, and whole texts are joined by it to
the digests of known licences. The lines of a text are texts of their own for
the short notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.llm.common import saved
from posequarry.llm.licence_texts import LICENCES

# Lines that state a holder: "Copyright" and a sign, year, name in brackets or "by", or a bare sign; and the reservation.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|\p{N}|<|\[|by\b)|\(c\)|©|all rights reserved)[^\n]*$"
# Equivalent spellings, the second is kept.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("modelled", "modeled"),
    ("copyright holder", "copyright owner"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical form of a text, its line ends kept."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] = LICENCES) -> DataFrame:
    """licence, canonical, digest of each known text."""
    table = spark.createDataFrame(list(texts), "licence string, text string")
    return (
        table.select("licence", canonical(F.col("text")).alias("canonical"))
        .withColumn("digest", F.sha2("canonical", 256))
        .groupBy("digest")
        .agg(F.min("licence").alias("licence"), F.max("canonical").alias("canonical"))
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, licence, notices of every row.

    ``licence`` is the known text the whole document equals in canonical form,
    else null. ``notices`` lists the known texts that single lines equal, sorted,
    each once. Null, empty and purely punctuation texts have the digest of the empty
    text, which no licence has. Repeated rows repeat; an empty table gives an
    empty one; columns beyond doc_id and text play no part.

    Lines are joined by digest too; a line whose canonical length no known text
    has is left out before, as it cannot be equal to any.
    """
    lengths = [r[0] for r in known.select(F.length("canonical")).distinct().collect()]
    form = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines")
    )
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    fitting = F.filter(lines, lambda x: F.length(x).isin(lengths))
    base = saved(
        form.select(
            "row",
            "doc_id",
            F.sha2(F.trim(F.regexp_replace("lines", r"[ \n]+", " ")), 256).alias("digest"),
            F.array_distinct(F.transform(fitting, lambda x: F.sha2(x, 256))).alias("line_digests"),
        ),
        "licence-digests",
    )
    by_digest = known.select(F.col("digest").alias("_digest"), "licence")
    notices = (
        base.select("row", F.explode("line_digests").alias("_line"))
        .join(by_digest, F.col("_line") == F.col("_digest"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    )
    return (
        base.join(by_digest, F.col("digest") == F.col("_digest"), "left")
        .join(notices, "row", "left")
        .select(
            "doc_id", "digest", "licence", F.coalesce("notices", F.expr("CAST(array() AS array<string>)")).alias("notices")
        )
    )
