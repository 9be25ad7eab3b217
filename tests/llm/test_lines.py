"""Line dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from posequarry.llm import lines
from tests.llm.test_operators import ODD, SCHEMA

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(texts, min_docs, min_chars=1, first=False):
    """Lines that stay, by document."""
    seen = {}
    for d, text in enumerate(texts):
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(d)
    gone = {k for k, ds in seen.items() if len(k) >= min_chars and len(ds) >= min_docs}
    out, met = [], set()
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            k = key(line)
            if k not in gone or first and k not in met:
                kept.append(line)
            met.add(k)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize(("min_docs", "first", "chars"), [(3, False, 1), (3, True, 1), (2, True, 1), (1, False, 1), (2, False, 0), (1001, False, 1)])
def test_brute_force(spark, min_docs, first, chars):
    draw = random.Random(7)
    pool = [f"{'Line' if k % 2 else 'LINE'} {k // 2}{' ' * (k % 3)}" for k in range(24)] + ["", "  ", "É", "é\x0b"]
    texts = ["\n".join(draw.choices(pool, k=draw.randrange(1, 9))) for _ in range(60)] + [None, "", "\n\n", "line 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = lines.dedup_lines(docs, min_docs, chars, first).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == brute(texts, min_docs, chars, first)
    for r, text in zip(rows, texts):
        given = (text or "").split("\n")
        assert r["n_lines"] == len(given)
        dropped = {p for run in r["dropped"] for p in range(run["start"], run["start"] + run["n"])}
        assert len(dropped) == r["n_dropped"] == sum(run["n"] for run in r["dropped"])
        assert r["text"] == "\n".join(x for p, x in enumerate(given) if p not in dropped)
        # Runs of zeros are maximal.
        assert all(a["start"] + a["n"] < b["start"] for a, b in zip(r["dropped"], r["dropped"][1:]))


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("n_lines", F.lit("given")).withColumn("_dropped", F.lit(1))
    found = lines.dedup_lines(odd.repartition(3), min_docs=3)
    assert sorted(found.columns) == sorted([*odd.columns, "n_dropped", "dropped"])
    rows = found.collect()
    assert len(rows) == len(ODD)
    # The sentence stands in three rows, two of them with one doc_id; all three lose it.
    assert sorted(r["n_dropped"] for r in rows) == [0] * 6 + [1] * 3
    assert {r["text"] for r in rows if r["doc_id"] in (4, 5)} == {""}
    assert [r["text"] for r in rows if r["doc_id"] is None] == [r[1] for r in ODD if r[0] is None]
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crowded_key_is_cut_and_pruned(spark):
    """A line that every document has is dealt to many tasks, and few of its rows reach the second shuffle."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common\n"), F.col("id")).alias("text"))
    found = lines.dedup_lines(docs, min_docs=10)
    assert found.agg(F.sum("n_dropped")).first()[0] == 4000
    digests = hashlib.sha256("7".encode()).hexdigest()
    assert found.filter("doc_id = 7").select(F.sha2("text", 256)).first()[0] == digests
    rows, ids = lines.located(docs)
    plan = lines.crowded(lines.hashed_lines(rows, ids), ids, 10)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Partial" in plan and "WindowGroupLimit" in plan
