from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from evidentia.llm import packing, tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")


def test_ids_are_the_tokenizers():
    rng = random.Random(5)
    chars = "abcXYZ 012'’.,!?_-—…äöüßÄÖÜéèñçÅøÆœŒĳ\n\t\r<|>@#&()~`\"\\/€£½²ªº·¡¿«»µ\xad\xa0\x1cŸſſ中文Ως\u0301\U0001f600" + "’s‘don't we'll they've 's"
    t = Tokenizer.from_file(PATH)
    for _ in range(3000):
        x = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        assert tokens.encode([x], PATH)[0] == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
    x = "a <|endoftext|> b"
    assert tokens.encode([x], PATH)[0] == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, texts, capacity=packing.CAPACITY):
    """Round trip: every id of every row in one piece, and sequences without gaps or overflow."""
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for k, copies in texts.items():
        ids = ids_of(copies[0])
        spans = sorted((r.start, r.length) for r in docs[k])
        assert [s for s in spans] == sorted(s for s in spans[:: len(copies)] for _ in copies)
        at = 0
        for start, length in spans[:: len(copies)]:
            assert start == at
            at += length
        assert at == len(ids)
        for r in docs[k]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return bins


def test_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(spark, docs, PATH).collect()
    bins = check(rows, {r.doc_id: [r.text] for r in docs.collect()})
    used = sum(r.length for r in rows)
    assert used / (packing.CAPACITY * len(bins)) > 0.97


def test_odd_rows(spark, odd, none):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check(packing.pack(spark, odd, PATH).collect(), texts)
    assert packing.pack(spark, none, PATH).count() == 0
    with_ids = packing.pack(spark, odd.where("doc_id = 8"), PATH, with_ids=True).collect()
    assert b"".join(bytes(r.ids) for r in sorted(with_ids, key=lambda r: r.start)) == ids_of(odd.where("doc_id = 8").first().text).tobytes()


@pytest.mark.parametrize("n", [1, 2, 64, 65, 1000, 2047, 2048, 2049, 4095, 4096, 4097, 20_000])
def test_pieces_cover(n):
    cut = packing.pieces(n)
    assert sum(cut) == n and all(0 < x <= packing.CAPACITY for x in cut)
    assert all(x * packing.slots(x)[1] <= packing.CAPACITY for x in cut)


def test_sequences_of_any_capacity_stay_apart(spark, odd_unique):
    texts = {r.doc_id: [r.text] for r in odd_unique.collect()}
    for capacity in (512, 16_384):
        assert max(packing.slots(n, capacity)[0] for n in range(1, capacity + 1)) == packing.most_class(capacity)
    check(packing.pack(spark, odd_unique, PATH, capacity=16_384).collect(), texts, 16_384)
