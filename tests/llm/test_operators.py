"""The ten operators against brute force, on odd small tables and on the smallest given ones."""

import hashlib
import itertools
import json
import math
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from posequarry.llm import audio, chat, licences, mixing, neighbours, pieces, queries, sharding, simhash, tokens, toxicity
from posequarry.llm.licence_texts import LICENCES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, shard int"

ODD = [
    (1, None, "en", "a", None, 1, "x", 1),
    (2, "", "en", "a", 0, 1, "x", 1),
    (3, "  \n\t ", None, None, 5, None, None, None),
    (4, "One two three four five", "en", "a", 23, 2, "y", 2),
    (4, "One two three four five", "en", "a", 23, 2, "y", 2),
    (5, "ONE TWO THREE FOUR FIVE", "en", "b", 23, 2, "y", 2),
    (None, "lost and found é中\U0001f600   x", "de", "é", 9, 0, "z", 3),
    (7, "word " * 20_000, "en", "b", 100_000, 3, "z", 3),
    (8, "▁mark <|endoftext|> tail", "en", None, 20, 3, "z", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet'").fetchall()


def words(text):
    return (text or "").encode().split()


# --- mixing


def fill(sizes, weights, share, cap):
    """Targets by resharing the excess again and again."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        level = rest / (sum(w for i, w in enumerate(weights) if i not in full) or 1)
        more = {i for i, w in enumerate(weights) if i not in full and level * w > cap * sizes[i] * (1 + 1e-12)}
        if not more:
            return [cap * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= more


def check_mix(rows, key=lambda r: (r["source"] is None, r["source"] or "")):
    by = {}
    for r in rows:
        by.setdefault(key(r), []).append(r)
    order = sorted(by)
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    for s, size, target in zip(order, sizes, want):
        assert all(r["source_size"] == size for r in by[s])
        assert all(math.isclose(r["target"], target, rel_tol=1e-9, abs_tol=1e-9) for r in by[s])
        assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] for r in by[s])
        low = math.floor(target / size + 1e-9) if size else 0
        assert all(low <= r["copies"] <= low + 1 or not r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 0.5 * max(r["size"] for r in by[s]) + 1e-6


def test_mix_meets_targets(spark, odd, empty, documents):
    rows = queries.op1_mixing(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(words(t))) for d, t, _ in documents)
    check_mix(rows)
    again = {(r["doc_id"], r["taken"]) for r in queries.op1_mixing(spark, FOLDER).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD)
    check_mix(got)
    assert mixing.mix(empty).count() == 0


def test_mix_of_one_id_repeated(spark, monkeypatch):
    """Many rows alike in id and size share no cell, and the same number of copies comes out of any partitioning."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"), F.lit("one two three").alias("text"),
    )
    cells, whole = [], mixing.saved

    def counted(df, name):
        if name == "mix-level":
            cells.append(df)
        return whole(df, name)

    monkeypatch.setattr(mixing, "saved", counted)
    first = mixing.mix(rows.repartition(3), share=0.7)
    check = [r for r in first.collect()]
    assert len(check) == 5000
    for source in "ab":
        mine = [r for r in check if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1.5
    sizes = cells[0].select(F.size("f.done").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 64 * 3
    again = mixing.mix(rows.repartition(11), share=0.7)
    per_id = lambda df: sorted(map(str, df.groupBy("source", "doc_id").agg(F.sum("copies")).collect()))
    assert per_id(first) == per_id(again)


def test_mix_keeps_probabilities_and_hot_sources(spark):
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 900, "big").otherwise("small").alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
    )
    taken = np.zeros(1000)
    for seed in range(12):
        rows = mixing.mix(docs, weights=(1.0, 1.0), share=0.4, seed=seed, fan=8).collect()
        for r in rows:
            taken[r["doc_id"]] += r["copies"]
        for source in ("big", "small"):
            mine = [r for r in rows if r["source"] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3.5
    big = taken[:900] / 12
    assert abs(big.mean() - 0.2222) < 0.02  # every document has the rate of its source
    for size in range(7):
        assert abs(big[size::7].mean() - 0.2222) < 0.09


# --- chat


def test_chat_round_trip(spark, documents):
    odd_turns = [
        (1, 0, "user", "</s>[INST] ok [/INST]", 9), (1, 1, "assistant", "a\\b <s> \\l [INST+] x", 9),
        (2, 0, "system", None, 9), (2, 1, None, "", 9), (2, 1, None, "", 9), (None, None, "user", "x", 9),
        (3, 5, "as [/INST]sistant", "y</s>", 9), (4, 0, "assistant", "plain [INST] only", 9),
        (5, 0, "assistant", "long " * 30_000, 9), (6, 0, "user", "\\", 9), (7, 0, "user", "<s", 9), (7, 1, "assistant", "</s", 9),
    ]
    rows = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.read_back(chat.format_conversations(rows)).collect()
    want = {}
    for conv, turn, role, text, _ in odd_turns:
        want.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert {r["conv_id"] for r in out} == set(want)
    for r in out:
        turns = [t[1:] for t in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        said = [t for role, t in turns if role == "assistant"]
        assert len(said) == len(r["loss_spans"])
        for text, (start, length, escaped) in zip(said, r["loss_spans"]):
            stands = r["formatted"][start : start + length]
            assert stands == (text.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\s") if escaped else text)
        # Control strings stand where the template puts them, and nowhere else.
        n = len(turns)
        assert r["formatted"].count("</s>") == r["formatted"].count("<s>") == n
        assert r["formatted"].count("[INST") == r["formatted"].count("[/INST]") == n
    level = {r["conv_id"]: r["escape_level"] for r in out}
    assert level[1] == 1 and level[4] == 1 and level[7] == 0 and level[3] == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_escaping_is_reversible(spark):
    texts = ["".join(x) for n in range(5) for x in itertools.product("\\<[lsb", repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = rows.filter(chat.unescape(chat.escape(F.col("t"))) != F.col("t"))
    assert wrong.count() == 0
    assert rows.filter(F.contains(chat.escape(F.col("t")), F.lit("<"))).count() == 0


# --- toxicity


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, folder).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    n = duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hits = sum(p and y for p, y in held)
    assert hits / max(1, sum(y for _, y in held)) > 0.75
    assert hits / max(1, sum(p for p, _ in held)) > 0.95


def test_counterfactual_penalty_frees_group_names(spark, odd, empty):
    docs, labels = [], []
    for i in range(400):
        toxic = i % 2
        group = "women" if (i % 10 < 8) == bool(toxic) else "men"
        docs.append((i, f"the {group} went home {'vile' if toxic and i % 3 else 'today'} text{i}"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    free = toxicity.fit(docs, labels, penalty=20.0, min_ratio=1.5)
    tied = toxicity.fit(docs, labels, penalty=0.0, min_ratio=1.5)

    def gap(model):
        return abs(model.score("the women went home today") - model.score("the men went home today"))

    assert gap(free) < 0.05 < gap(tied)
    assert free.score("the men vile") > free.score("the men")
    scored = odd.select("doc_id", toxicity.score(F.col("text"), free).alias("s"))
    assert scored.filter("s between 0 and 1").count() == len(ODD)
    nothing = toxicity.fit(empty, labels.limit(0))
    assert not nothing.weights and 0 <= nothing.score(None) <= 1
    assert empty.select(toxicity.score(F.col("text"), free)).count() == 0


# --- audio


def test_audio_round_trip(spark, documents, odd, empty):
    rows = {r["doc_id"]: r for r in queries.op4_audio(spark, FOLDER).collect()}
    for doc_id, text, _ in documents:
        raw = (text or "").encode()
        data = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(data[-64:]) and r["media_bytes"] == len(data) + 44
        # The feature again, from the text alone.
        assert r["feature"] == expected_feature(data)
    media = audio.stored_media(odd.withColumn("n", F.lit(1)))
    full = audio.stored_tensors(media).collect()
    assert {c for c in odd.columns if c != "text"} | {"n"} < set(media.columns) and len(full) == media.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in media.collect():
        assert audio.from_wave(bytes(r["media"])) == audio.payload(texts[r["doc_id"]])
    for r in full:
        tensors, spans = audio.read_tensors(bytes(r["tensors"]))
        assert tensors.shape[1:] == (audio.BINS, audio.MELS) and len(tensors) == len(spans)
        assert (spans[:, 1] > spans[:, 0]).all()
    assert audio.stored_tensors(audio.stored_media(empty)).count() == 0


def expected_feature(data):
    """Segments and means frame by frame, from resampled samples."""
    y = audio.resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128)
    mel = audio.log_mel(y, audio.RATE * audio.UP / audio.DOWN)
    energy = mel.mean(axis=1)
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean() - 0.25 * energy.std()
    spans, start = [], None
    for k, e in enumerate(energy):
        if start is None and e > high:
            start = k
        elif start is not None and e < low:
            spans.append((start, k))
            start = None
    if start is not None:
        spans.append((start, len(energy)))
    ms = [(round(a * 128 / 12), round(b * 128 / 12)) for a, b in spans]
    total = np.zeros(audio.MELS)
    for a, b in spans:
        n = b - a
        for k in range(audio.BINS):
            lo, hi = a + n * k // audio.BINS, a + -(-n * (k + 1) // audio.BINS)
            total += np.asarray(mel[lo : max(hi, lo + 1)].mean(axis=0, dtype=np.float64), np.float32)
    means = [round(float(v), 1) + 0.0 for v in total / (audio.BINS * len(spans))] if spans else []
    return json.dumps({"segments": len(spans), "active_ms": sum(b - a for a, b in ms), "mel": means}, separators=(",", ":"))


def test_resampling_equals_direct_convolution():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(len(t)) * up
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = np.convolve(wide, h)[half:][::down][: -(-len(x) * up // down)]
    np.testing.assert_allclose(audio.resample(x), want, atol=1e-4)


def test_mel_and_segments_by_loops():
    y = np.random.default_rng(2).normal(size=3000).astype(np.float32)
    mel = audio.log_mel(y, 12_000)
    assert len(mel) == 1 + math.ceil((3000 - audio.FRAME) / audio.HOP)
    frame = y[5 * audio.HOP :][: audio.FRAME] * np.hanning(audio.FRAME)
    power = np.abs(np.fft.rfft(frame)) ** 2
    np.testing.assert_allclose(mel[5], np.log(power @ audio._filterbank(12_000, audio.FRAME, audio.MELS) + 1e-6), rtol=1e-3)
    energy, on, want = np.array([0, 3, 1.5, 0.5, 2.5, 1.2, 1.1, 0, 0, 3.0]), False, []
    for i, e in enumerate(energy):
        now = e > 2 or (on and e >= 1)
        if now and not on:
            want.append([i, len(energy)])
        if on and not now:
            want[-1][1] = i
        on = now
    assert audio.segments(energy, 2, 1).tolist() == want


# --- neighbours


def exact(vectors, ids, wanted, k):
    out = {}
    for q, v in wanted:
        far = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        out[q] = [(i, d) for d, i in sorted((d, i) for d, i in zip(far, ids) if i != q)[:k]]
    return out


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = exact(x, ids, [(i, v) for i, v in zip(ids, x) if i % 100 == 0], 10)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    wanted = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    default = queries.op5_neighbours(spark, folder).collect()
    narrow = neighbours.nearest(vectors, wanted, leaf_rows=32, budget_rows=0, budget_share=3.0).collect()
    cut = neighbours.nearest(
        vectors, wanted, leaf_rows=32, budget_rows=0, budget_share=3.0, task_rows=8, task_queries=2
    )
    assert sorted(cut.collect()) == sorted(narrow)
    for got, least in ((default, 0.9), (narrow, 0.8)):
        found = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append(r)
            assert math.isclose(r["score"], np.sqrt(((x[ids == r["vec_id"]][0] - x[ids == r["query_id"]][0]) ** 2).sum()), rel_tol=1e-12)
        assert all([r["rank"] for r in rs] == list(range(1, 11)) for rs in found.values()) and set(found) == set(want)
        hits = sum(len({r["vec_id"] for r in found[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits / (10 * len(want)) >= least


def test_neighbours_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(60)]  # one vector that fills a third
    rows += [(100 + i, [float(v) for v in rng.normal(size=3)]) for i in range(80)]
    bad = [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 1.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, [1.0]), (905, []), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<float>, leaf int")
    wanted = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = neighbours.nearest(vectors, wanted, k=4, leaf_rows=8, budget_share=50.0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([np.array(r[1], np.float32) for r in rows], float)
    want = exact(x, ids, [(i, v) for i, v in zip(ids, x) if i % 10 == 0], 4)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {
        (q, k, i) for q, found in want.items() for k, (i, _) in enumerate(found, 1)
    }
    assert neighbours.nearest(vectors.limit(0), wanted).count() == 0
    assert neighbours.nearest(vectors, wanted.limit(0)).count() == 0


# --- pieces

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def all_paths(model, text):
    """Every segmentation of a marked text, best first."""
    if not text:
        return [(0.0, ())]
    found = []
    for stop in range(1, len(text) + 1):
        hit = model.scores.get(text[:stop])
        if hit:
            found += [(hit[1] + s, (hit[0], *ids)) for s, ids in all_paths(model, text[stop:])]
    if text[0] not in model.scores:
        ids = tuple(model.bytes_at[b] for b in text[0].encode())
        found += [(model.byte_score * len(ids) + s, ids + rest) for s, rest in all_paths(model, text[1:])]
    return sorted(found, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello the", "a  b", "the the", " x", "abຟ\nc", "in the\U0001f600"])
def test_n_best_equals_all_paths(text):
    want = all_paths(pieces.lattice(MODEL), pieces.SPACE + text.replace(" ", pieces.SPACE))
    got = pieces.encode(text, MODEL, 6)
    assert len(got) == min(6, len(want))
    np.testing.assert_allclose([s for s, _ in got], [s for s, _ in want[: len(got)]], rtol=1e-9)
    assert len({tuple(ids) for _, ids in got}) == len(got)
    assert {tuple(i) for _, i in got} <= {i for _, i in want}
    assert all(pieces.decode(ids, MODEL) == text for _, ids in got)


def test_pieces_of_documents(spark, documents, odd, empty):
    assert not [p for p in pieces.lattice(MODEL).scores if pieces.SPACE in p.lstrip(pieces.SPACE)]
    rows = queries.op6_pieces(spark, FOLDER).collect()
    assert len(rows) == len(documents) and all(r["lossless"] for r in rows)
    texts = {d: t for d, t, _ in documents}
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["scores"] == sorted(r["scores"], reverse=True) and len(set(r["n_best_sha256"])) == len(r["scores"])
    got = odd.select("text", pieces.segment(F.col("text"), MODEL).alias("r")).select("text", "r.*").collect()
    assert all(r["lossless"] and pieces.decode(r["ids"], MODEL) == (r["text"] or "").replace(pieces.SPACE, " ") for r in got)
    assert all(r["n_ids"] == 0 and r["scores"] == [] for r in got if not r["text"])
    assert empty.select(pieces.segment(F.col("text"), MODEL)).count() == 0


def test_words_are_walked_together(monkeypatch):
    """Short words take the forward pass in bulk, never one by one, and as one by one; neither blocks nor what is kept matter."""
    rng = np.random.default_rng(5)
    letters = list("abethin  .▁é中文ຟ\U0001f600\n\0ß")
    texts = ["".join(rng.choice(letters, rng.integers(0, 150))) for _ in range(150)]
    texts += ["the " * 500, None, "", " ", "x" * 500 + " tail", "中" * 64, "the in the in"]
    model = pieces.lattice(MODEL)
    words = [w for t in texts for w in pieces.split_words(t or "") if 0 < len(w) <= pieces.LONGEST]
    count, ids, score, loss = model.first_bests(words)
    ends = np.cumsum(count)
    got = [(tuple(ids[e - c : e].tolist()), s, x) for e, c, s, x in zip(ends, count, score.tolist(), loss.tolist())]
    assert got == [model.first_best(w) for w in words]
    single, alone = model.first_best, []
    monkeypatch.setattr(model, "first_best", lambda word: alone.append(word) or single(word))
    pieces._known.cache_clear()
    want = [pieces.encode(t, MODEL, 3, 1000) for t in texts]
    assert alone and min(map(len, alone)) > pieces.LONGEST
    monkeypatch.setattr(pieces, "BLOCK", 300)
    monkeypatch.setattr(pieces, "WALKED", 40)
    for kept in (1000, 7):
        pieces._known.cache_clear()
        found = list(pieces.encode_all(texts, MODEL, 3, kept))
        assert [[(s, list(i)) for s, i in x] for x in found] == [[(s, list(i)) for s, i in x] for x in want]
    assert all(pieces.decode(x[0][1], MODEL) == t.replace(pieces.SPACE, " ") for t, x in zip(texts, want) if t)


# --- licences


def test_licences(spark, odd, empty):
    mit = dict(LICENCES[:8])["MIT"]
    changed = mit.upper().replace("LICENSE", "Licence").replace("<YEAR> <COPYRIGHT HOLDERS>", "2020 Jane Doe").replace("\n", "\n  ")
    texts = [mit, changed, mit + " more", "code\nReleased under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0", "Copyright (c) 2020 X", None]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, licence string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got[0] == ("MIT", []) and got[1] == ("MIT", []) and got[2][0] is None
    assert got[3] == (None, ["CC-BY-NC-4.0", "MIT"]) and got[4] == (None, []) and got[5] == (None, [])
    known = licences.known_licences(spark)
    assert licences.scan(odd, known).count() == len(ODD) and licences.scan(empty, known).count() == 0
    each = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LICENCES)], "doc_id int, text string")
    assert {r["doc_id"]: r["licence"] for r in licences.scan(each, known).collect()} == {i: n for i, (n, _) in enumerate(LICENCES)}
    rows = queries.op7_licences(spark, FOLDER).collect()
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    for r in rows:
        assert r["notices"] == ",".join(sorted({lines[x] for x in texts[r["doc_id"]].split("\n") if x in lines}))


# --- tokens


def test_token_counts(spark, documents, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)

    def n(text):
        return len(plain.encode(text or "", add_special_tokens=False).ids)

    rows = queries.op8_tokens(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {d: (len((t or "").encode()), n(t)) for d, t, _ in documents}
    hard = ["a \n b", "x    y", "a  b   c\n\n d\t\te ", "don't  we've'll", " <|endoftext|> <|endoftext|>x", " ", "a\x1c \x1cb", "\r\n\r\n x", "!　 ?", "1 2  3"]
    assert tokens.count_batch(hard, path, batch_bytes=4) == [n(t) for t in hard]
    assert all("".join(tokens.safe_pieces(t)) == t for t in hard)
    got = odd.select("text", tokens.token_count(F.col("text"), path).alias("n")).collect()
    assert all(r["n"] == n(r["text"]) for r in got)
    assert empty.select(tokens.token_count(F.col("text"), path)).count() == 0


def test_whole_text_lattice_where_pieces_cross(monkeypatch):
    """A model with pieces across words is searched over the whole text; this one has none, so both ways agree."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = ["two words", " a  b ", "é中 x", "one", "the the the end"]
    by_word = [pieces.encode(t, path, 3) for t in texts]
    model = pieces.lattice(path)
    assert model.crosses is False
    monkeypatch.setattr(model, "crosses", True)
    for text, want in zip(texts, by_word):
        got = pieces.encode(text, path, 3)
        assert [list(ids) for _, ids in got] == [list(ids) for _, ids in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


# --- sharding


def test_interleaving(spark, documents, odd, empty):
    rows = queries.op9_sharding(spark, FOLDER).collect()
    ranks, by = [], {}
    for d, t, s in documents:
        by.setdefault(s, []).append((hashlib.md5(f"42:{d}".encode()).hexdigest(), d, t))
    for s, mine in by.items():
        named = "none" if s is None else f"source:{s}"
        shift = int(hashlib.md5(f"42:{named}".encode()).hexdigest()[:12], 16) / 2**48
        ranks += [((i + shift) / len(mine), s, i, d, t) for i, (_, d, t) in enumerate(sorted(mine))]
    each, longer = divmod(len(documents), 24)
    want, at = {}, 0
    ranks.sort()
    for shard in range(24):
        for slot in range(each + (shard < longer)):
            _, _, _, d, t = ranks[at]
            want[d] = (shard, slot, len(t.encode()) + 8, zlib.crc32(t.encode()))
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in rows} == want
    small = sharding.interleave(odd, 4, cell=2).collect()
    assert sorted((r["shard"], r["slot"]) for r in small) == sorted((k, i) for k, n in enumerate((3, 2, 2, 2)) for i in range(n))
    assert sharding.interleave(empty).count() == 0


def test_shards_have_the_mixture(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("x").alias("text")
    )
    rows = sharding.interleave(docs, 24, cell=64).groupBy("shard", "source").count().collect()
    hot = [r["count"] for r in rows if r["source"] == "hot"]
    assert len(hot) == 24 and max(hot) - min(hot) <= 9  # at most one more or less for each other source


def test_sources_of_one_row_are_spread(spark):
    docs = spark.range(2400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "large").otherwise(F.col("id").cast("string")).alias("source"), F.lit("x").alias("text")
    )
    rows = sharding.interleave(docs, 24, cell=64).collect()
    single = np.bincount([r["shard"] for r in rows if r["source"] != "large"], minlength=24)
    assert 25 <= single.min() and single.max() <= 80


# --- simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, budget=4):
    """Smallest id reachable, for (id, fingerprint) pairs."""
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= budget:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(pairs))]


def test_simhash_of_documents(spark, documents, odd, empty):
    rows = queries.op10_simhash(spark, FOLDER).collect()
    pairs = [(d, slow_fingerprint(t)) for d, t, _ in documents]
    want = {d: (f"{h:016x}", c) for (d, h), c in zip(pairs, slow_components(pairs))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want
    got = simhash.near_duplicates(odd).collect()
    pairs = [(r[0], slow_fingerprint(r[1])) for r in ODD]
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == sorted(
        (str(d), h, c) for (d, h), c in zip(pairs, slow_components(pairs))
    )
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("node_rows", [4, 4096])
def test_trie_join_on_dense_values(spark, node_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64).tolist()
    values = {0, 2**64 - 1}
    for c in centres:
        chain = c
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 6), replace=False).tolist()
            chain = (c if rng.random() < 0.5 else chain) ^ sum(1 << b for b in flips)
            values.add(chain)
    pairs = sorted((i, v) for i, v in enumerate(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for _, v in pairs]
    fps = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, 4, node_rows)).collect()}
    want = slow_components(pairs)
    groups, mine = {}, {}
    for (i, _), (f,), c in zip(pairs, signed, want):
        groups.setdefault(c, set()).add(i)
        mine.setdefault(roots.get(f, f), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
