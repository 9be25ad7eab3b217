"""The near-duplicate stage against exact similarity of all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from posequarry.llm import common, shingles, simhash
from tests.llm.test_operators import FOLDER


def shingle_set(text):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def kept(rows):
    """The first id of each component of pairs that share 0.8 of their shingles."""
    found = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(found), 2):
        both = len(found[a] & found[b])
        if both * 5 >= (len(found[a]) + len(found[b]) - both) * 4:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return sorted({top(d) for d in found})


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect())


def edited(draw, tokens, n):
    out = list(tokens)
    for at in draw.sample(range(len(out)), n):
        out[at] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def test_pairs_that_four_bits_miss(spark):
    draw = random.Random(5)
    rows, far = [], 0
    for k in range(30):
        tokens = [f"w{draw.randrange(5000)}" for _ in range(300)]
        other = edited(draw, tokens, 4)
        rows += [(2 * k, " ".join(tokens)), (2 * k + 1, other)]
        bits = simhash.fingerprint(rows[-2][1].encode()) ^ simhash.fingerprint(other.encode())
        far += (bits & (2**64 - 1)).bit_count() > 4
    assert far > 10
    assert stage(spark, rows) == kept(rows) == list(range(0, 60, 2))


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert stage(spark, rows) == kept(rows)


def test_groups_chains_and_a_common_line(spark):
    """A large group of near copies, chains around 0.8, and texts that share half their words."""
    draw = random.Random(6)
    line = [f"c{k}" for k in range(60)]
    first = [f"o{k}" for k in range(120)]
    texts = [edited(draw, first, draw.randrange(5)) for _ in range(60)]
    texts += [" ".join(line + [f"x{draw.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]
    at = [f"p{k}" for k in range(100)]
    for k in range(20):
        at = at[3:] + [f"q{k}a", f"q{k}b", f"q{k}c"]
        texts += [" ".join(at), "", "  "]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    want = kept(rows)
    assert stage(spark, rows) == want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs, ids = common.located(docs)
    for sample, limits in ((1, {"rounds": 0, "tile": 7}), (50, {"rounds": 1, "group": 9}), (10**6, {"rounds": 0})):
        found = shingles.near_duplicates(docs, ids, sample, **limits).collect()
        assert sorted({r["component_id"] for r in found}) == want
        assert sorted(r["doc_id"] for r in found if r["first"]) == want


def test_sketches():
    """Differing bits never exceed differing shingles, also between sketches of two sizes."""
    draw = np.random.default_rng(2)
    for _ in range(200):
        n, k = int(draw.integers(1, 300)), int(draw.integers(0, 80))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, len(a) - k)], draw.integers(0, 2**63, int(draw.integers(0, k + 1))).astype(np.uint64)]))
        meeting = shingles.Meeting(np.array([len(a), len(b)]), [shingles.sketch(a), shingles.sketch(b)])
        at, bits = meeting.before(1)
        both = len(np.intersect1d(a, b))
        if shingles.similar(a, b):
            assert at.tolist() == [0]
        if len(at):
            assert bits[0] <= len(a) + len(b) - 2 * both


def test_crowded_group_takes_few_pairs(spark, monkeypatch):
    """Near copies of one text, most of them not similar to each other, next to one another in few verified pairs."""
    draw = random.Random(9)
    first = [f"o{k}" for k in range(150)]
    n = 600
    texts = [edited(draw, first, draw.randrange(1, 9)) for _ in range(n)]
    compared, whole = [], shingles.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", counted)
    rows = list(enumerate(texts))
    docs, ids = common.located(spark.createDataFrame(rows, "doc_id long, text string"))
    found = shingles.near_duplicates(docs, ids).collect()
    assert sorted(r["doc_id"] for r in found if r["first"]) == kept(rows)
    assert sum(compared) < 8 * n


def test_links_of_fingerprints_come_first(spark, monkeypatch):
    """The stage checks what op10's walk links, exactly: a link without similarity joins nothing."""
    draw = random.Random(11)
    first = [f"o{k}" for k in range(400)]
    rows = [(k, edited(draw, first, k % 2)) for k in range(12)] + [(20, "one two"), (21, "three")]
    checked, whole, walked = [], shingles.verified, []

    def seen(pairs, *rest):
        checked.append({(r["a"], r["b"]) for r in pairs.collect()})
        return whole(pairs, *rest)

    def all_of_them(values, *rest, of=simhash.links):
        walked.append(values.count())
        least = values.agg({"fp": "min"}).first()[0]
        return of(values, *rest).unionAll(values.selectExpr(f"{least}L as a", "fp as b").filter("a <> b"))

    monkeypatch.setattr(shingles, "verified", seen)
    monkeypatch.setattr(simhash, "links", all_of_them)
    assert stage(spark, rows) == kept(rows) == [0, 20, 21]
    assert walked and checked[0]


def test_order_counts_every_document(spark, monkeypatch):
    """The order of shingles is taken from all documents of a table, however many they are."""
    counted = []

    class Stop(Exception):
        pass

    def seen(texts, *rest):
        counted.append(texts.count())
        raise Stop

    monkeypatch.setattr(shingles, "bucket_ranks", seen)
    docs, ids = common.located(spark.range(50_000).selectExpr("id doc_id", "concat('w', id) text"))
    with pytest.raises(Stop):
        shingles.near_duplicates(docs, ids)
    assert counted == [50_000]


def test_ranks_of_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PACKED", 60)
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(12)}" for _ in range(draw.randrange(12))) for _ in range(300)] + [None, "same line of five words"] * 50
    want = np.zeros(shingles.BUCKETS, np.int64)
    for text in texts:
        np.add.at(want, (shingles.shingles((text or "").encode()) % np.uint64(shingles.BUCKETS)).astype(np.int64), 1)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    for often in (1, 8):
        ranks = shingles.bucket_ranks(docs, often)
        assert np.array_equal(ranks, np.where(want < often, 0, np.ceil(np.log2(want / often + 1))))
    assert ranks.max() >= 3
    assert not shingles.bucket_ranks(docs.limit(0)).any()
