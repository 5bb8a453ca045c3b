"""The base against brute force, gradients, and held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from findery.llm import gru, lm
from findery.llm.lm import op2_lm, score, signed_hash

SCHEMA = "doc_id long, text string, held_out int, base string"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")


def brute(texts):
    tok = {i: [w for w in words(t) if w] + [""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for i, ws in tok.items()
    }


def check(rows, texts):
    want = brute(texts)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_lm(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_words_outside_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 40)
    rng = random.Random(2)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randint(0, 60))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "Éa ÉA \t x"}
    df = spark.createDataFrame([(i, t, 0, "") for i, t in texts.items()], SCHEMA)
    check(score(df).collect(), texts)
    twice = score(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and all(r.n_known <= r.n_tokens for r in twice)


def test_odd_tables(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = score(spark.createDataFrame([(held, "a b", 0, ""), (None, "c", 0, "")], SCHEMA)).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in sorted(rows, key=lambda r: r.n_tokens)] == [(True, 0, 0, 0.0)] * 2


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b"abc",), ("é" .encode() * 20,)], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(signed_hash(bytes(r.w)) == r.h for r in rows)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.init(64, 5, np.arange(1.0, 65), np.ones(5)).items()}
    docs = [rng.integers(1, 69, 7).astype(np.int32) for _ in range(3)]
    model = gru.Model({k: v.copy() for k, v in p.items()}, 0)
    given, target, index = next(gru.streams(docs, 0))
    seen = {}
    plain = gru.np.clip
    try:
        gru.np.clip = lambda a, lo, hi, out=None: a
        before = {k: v.copy() for k, v in model.p.items()}
        model.g2 = {k: np.full_like(v, 1e12) for k, v in model.p.items()}
        model.learn(given, target, index, np.zeros((gru.WIDTH, given.shape[1])))
        scale = gru.RATE / 1e6 / np.sqrt((index >= 0).sum())
        seen = {k: (model.p[k] - before[k]) / scale for k in p}
    finally:
        gru.np.clip = plain
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape) if k not in ("emb", "word", "word_b") else np.unravel_index(np.abs(seen[k]).argmax(), p[k].shape)
        up, down = ({x: v.copy() for x, v in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        slope = (gru.Model(up, 0).score(docs).sum() - gru.Model(down, 0).score(docs).sum()) / 2e-2
        assert math.isclose(slope, seen[k][at], rel_tol=0.05, abs_tol=0.02), k


def test_state_is_carried_and_cleared():
    p = gru.init(64, 5, np.arange(1.0, 65), np.ones(5))
    rng = np.random.default_rng(1)
    docs = [rng.integers(1, 69, n).astype(np.int32) for n in (200, 3, 50, 1, 90)]
    model = gru.Model(p, 0)
    alone = [model.score([d])[0] for d in docs]
    assert np.allclose(model.score(docs), alone, rtol=1e-4)


def test_copies_are_averaged_in_a_few_means(spark):
    from findery.llm import lm

    rng = np.random.default_rng(2)
    copies = [(int(n), rng.normal(size=50).tolist()) for n in rng.integers(1, 1000, 100)]
    df = spark.createDataFrame(copies, "seen long, p array<double>").repartition(40)
    got = lm.averaged(df).collect()
    assert len(got) <= lm.MERGED and sum(r.seen for r in got) == sum(n for n, _ in copies)
    want = sum(n * np.array(p) for n, p in copies) / sum(n for n, _ in copies)
    assert np.allclose(sum(r.seen * np.array(r.p) for r in got) / sum(r.seen for r in got), want)
    assert lm.averaged(df.limit(0)).count() == 0
