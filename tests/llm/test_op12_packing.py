"""Harmonic packing: every id in exactly one piece, full sequences, cases of the docstring."""

import random
import zlib

import numpy as np
import public_tokenizers
from corpus_helpers import corpus, docs, with_extra
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewgrid.llm import op12_packing as op
from reviewgrid.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check(rows, texts_by_doc, capacity=1024):
    """Round trip: pieces rebuild each document, sequences are gapless, pads only where allowed."""
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = dict(zip(texts_by_doc, reference_ids(texts_by_doc.values()), strict=True))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at, got = 0, []
        for start, length, raw, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and len(raw) == 4 * length and length > 0
            got += np.frombuffer(raw, "<u4").tolist()
            at += length
        assert got == ids
    used = pad = 0
    for members in seqs.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
        used, pad = used + at, pad + (0 if at & (at - 1) == 0 else capacity - at)
    return used, pad


def test_encoder_equals_the_tokenizer():
    rnd = random.Random(4)
    letters = "ab 12 \n\t'sé中\u2028\x85\x1c\x0b\r!?²Ⅷ\u0301😀\xa0\u3000٣\x00"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["<|endoftext|> x", "a" * 5000, " " * 3000 + "x"]
    for t, ids in zip(texts, reference_ids(texts), strict=True):
        assert op.document_ids(op.encoder(PATH), t).tolist() == ids
        assert [i for p in op.cut_points(t, 5) for i in op.encoder(PATH)(p)] == ids[:-1] and "".join(op.cut_points(t, 5)) == t


def test_cuts():
    table = op.cut_table(1024, op.CUT_PRICE)
    assert all(sum(cuts) == n and all(c > 0 for c in cuts) for n, cuts in enumerate(table))
    waste = [sum((1024 - 1024 // s * s) / (1024 // s) for s in cuts) for cuts in table[1:]]
    assert np.mean(waste) < 1 and np.mean([len(c) for c in table[1:]]) < 3


def test_bins_hold_a_fixed_count_per_class():
    rnd = random.Random(2)
    packer = op.Packer(1024, op.CUT_PRICE, 0)
    for i in range(500):
        packer.add(i, np.arange(rnd.randint(1, 3000), dtype=np.uint32))
    bins = {}
    for _, _, length, _, _, seq, _ in packer.rows:
        bins.setdefault(seq, []).append(length)
    for lengths in bins.values():  # before finish: only complete bins, each of one class
        assert {1024 // n for n in lengths} == {len(lengths)}
    assert all(len(v) < k for k, v in packer.open.items())


def test_round_trip_and_defined_cases(spark):
    texts = [*corpus(60), "<|endoftext|> tail", "wörd " * 60_000, "x" * 200_000, "repeat", "repeat"]
    df = with_extra(docs(spark, texts)).repartition(3)
    rows = op.pack(df).collect()
    used, pad = check(rows, dict(enumerate(texts)))
    assert pad < 0.01 * used
    assert op.pack(df.limit(0)).collect() == []
    null_id = op.pack(docs(spark, [(None, "a b"), (None, None)])).collect()
    assert {(r.doc_id, r.doc_tokens) for r in null_id} == {(None, 1), (None, 3)} and sum(r.length for r in null_id) == 4
    used, pad = check(op.pack(df, capacity=100).collect(), dict(enumerate(texts)), 100)
    assert used > 0


def test_sequences_hold_the_ids(spark):
    pieces = op.pack(docs(spark, corpus(40)))
    got = op.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.n_ids <= 4096 for r in got)
    assert sum(r.n_ids for r in got) == pieces.agg(F.sum("length")).first()[0]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_harmonic_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    some = sorted(texts)[::25]
    ids = dict(zip(some, reference_ids([texts[i] for i in some]), strict=True))
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    pad = sum(1024 - n for n in by.values() if n & (n - 1))
    assert pad < 0.005 * sum(by.values())
