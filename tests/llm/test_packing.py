"""Packing: whole texts come back, sequences are gapless and few."""

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findery.llm.packing import op8_packing, pack, part_tokenizer, plan, tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_each_piece_once(histogram):
    used = defaultdict(int)
    for pattern, n in plan(histogram, 40):
        assert n > 0 and sum(pattern) <= 40
        for x in pattern:
            used[x] += n
    assert used == histogram


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    h = defaultdict(int)
    for _ in range(20_000):
        h[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    total = sum(k * v for k, v in h.items())
    assert sum(n for _, n in plan(h)) <= 1.002 * -(-total // 2048)


def test_parts_give_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["It's a Test,\tisn't it?", "ÉCOLE à b c 12.5%", "<|endoftext|> x<|ENDOFTEXT|>y", "é ́x", "漢字 かな\n\n", "", "a" * 3000, "ΟΔΟΣ ΣΑΣ.", "word, word&&& häß!! e\u0301a, x<|endoftext|> don't.' ĳ ﬁn. ǆ ªº. a_b ß"]
    got = part_tokenizer(tokenizer_path()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check(rows, texts):
    whole = Tokenizer.from_file(tokenizer_path())
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for i, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(docs[i], key=lambda r: r.piece)
        assert [r.start for r in mine] == [2048 * k for k in range(-(-len(ids) // 2048))]
        for r in mine:
            part = ids[r.start : r.start + 2048]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for group in seqs.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) <= 1.02 * -(-total // 2048) + 1


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op8_packing(spark, sf).collect(), texts)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 5000, 5), (4, "a b", 5), (5, "a b", 5)], "doc_id long, text string, length int")
    check(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    again = pack(docs.union(docs), with_ids=True).collect()
    assert len(again) == 2 * pack(docs).count() and all(len(r.ids) == r.length for r in again)
    assert pack(docs.limit(0)).count() == 0
