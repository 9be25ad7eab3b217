"""Periodic runs against brute force: the grammar, the runs, and the query's digests."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequarry.llm import periods, queries
from tests.llm.test_operators import FOLDER, ODD, SCHEMA


def brute(w, min_length=6, exponent=4):
    """Runs by comparing every word with the one q later, for every q."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def words_of(draw):
    n, k = draw.randrange(80), draw.choice([1, 2, 3, 5, 50])
    w = [draw.randrange(k) for _ in range(n)]
    if n > 10 and draw.random() < 0.6:
        a, p = draw.randrange(n), draw.randrange(1, 9)
        w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return w


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_runs(monkeypatch, step):
    monkeypatch.setattr(periods, "STEP", step)
    draw = random.Random(step)
    for _ in range(150):
        docs = [words_of(draw) for _ in range(draw.randrange(1, 6))]
        min_length, exponent = draw.choice([2, 6]), draw.choice([2, 3, 4])
        codes, n = np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs])
        rows = periods.runs_of(codes, n, min_length, exponent).tolist()
        want = [[d, s, length, q] for d, w in enumerate(docs) for s, q, length in brute(w, min_length, exponent)]
        assert rows == want


def test_extensions():
    """Common extensions of all pairs, to both sides, whatever is left at the top."""
    draw = random.Random(8)
    for ends in (1, 4, 1000):
        w = [999] + [draw.randrange(2) for _ in range(90)] + [7, 7, 7] * 9 + [1000]
        grammar = periods.Grammar(np.array(w), ends)
        pairs = np.array([(i, j) for i in range(len(w)) for j in range(i + 1, len(w))])
        ahead, behind = grammar.ahead(*pairs.T), grammar.behind(*pairs.T)
        for (i, j), a, b in zip(pairs.tolist(), ahead.tolist(), behind.tolist()):
            assert a == next(k for k in range(len(w)) if w[i + k] != w[j + k])
            assert b == next(k for k in range(len(w)) if w[i - k] != w[j - k])


def test_levels_shrink():
    """A long text has a number of levels that grows with its logarithm."""
    draw = np.random.default_rng(1)
    grammar = periods.Grammar(np.append(draw.integers(0, 500, 200_000), 500), 1)
    assert len(grammar.levels) < 150
    assert sum(len(level.symbols) for level in grammar.levels) < 12 * 200_000


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=(None, None, None))
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    said = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    digests = [hashlib.sha256(x).hexdigest() for x in (said.encode(), left)]
    milli = None if best[0] is None else 1000 * best[2] // best[1]
    return (len(runs), best[0], best[2], best[1], milli, *digests)


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op12_periods(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for d in docs:
        # Brute force over all periods is quadratic, so the longest few texts are left to the random tests.
        if len(d["text"] or "") < 20_000:
            assert tuple(rows[d["doc_id"]][n] for n in names) == expected(d["doc_id"], d["text"])
    assert sum(r["n_runs"] > 0 for r in rows.values()) > 5


def test_odd_rows(spark, tmp_path):
    more = [(40 + k, " ".join(["a b c d"] * k), None, None, None, None, None, None) for k in range(30)]
    docs = spark.createDataFrame(ODD + more, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_periods(spark, str(tmp_path)).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows if r["doc_id"] != 7)
    assert got == sorted((str(d[0]), *expected(d[0], d[1])) for d in ODD + more if d[0] != 7)
    (long,) = [r for r in rows if r["doc_id"] == 7]
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 20_000, 1)
    assert long["collapsed_sha256"] == hashlib.sha256(b"word").hexdigest()
    empty = spark.createDataFrame([], SCHEMA).select(periods.periodic_runs(F.col("text")).alias("r"))
    assert empty.count() == 0
