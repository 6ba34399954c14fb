import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from landledger.llm import packing as p
from landledger.llm.runs import slices

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    parts = ["The", "it's", "WE'LL", " ", " ", "\n", "é", "É", "漢", "𝄞", "İ", "ß", "1234", "!!", " ", " ", "\x1c", "\x85", "é", "<|endoftext|>", "a<|startoftext|>b", "'", "erreen,", "Å", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["x" * 9000, "word " * 9000, ""]


def test_ids_equal_the_library():
    lib, own = Tokenizer.from_file(PATH), p.WordTokenizer(PATH)
    some = [*texts(), "<|endoftext|>", "ΣΑΣ mixed plain\x0bword", "x" * 3000 + " " + "é" * 500, None]
    for most in (100, 1 << 22):
        ids = [x for s in slices(pa.array(some, pa.string()), most) for x in own.encode(s).bytes()]
        for t, got in zip(some, ids, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def check(pieces, want, window):
    """Every id in one piece, sequences gapless, next to no padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, seq, offset in pieces:
        docs[key].append((start, length, crc, total))
        seqs[seq].append((offset, length))
    for key, ids in want.items():
        at = 0
        for start, length, crc, total in sorted(docs.pop(key)):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not docs
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packer_on_random_and_equal_lengths(monkeypatch):
    rng = random.Random(6)
    for lengths in ([rng.randint(1, 300) for _ in range(3000)], [37] * 800, [65] * 500 + [200, 40], [1], [64], [63], []):
        for block in (10**9, 5000):
            monkeypatch.setattr(p, "BLOCK_IDS", block)
            k = p.Packer(5 << 36, 64)
            want = {}
            for i, n in enumerate(lengths):
                want[i] = [rng.randint(0, 49000) for _ in range(n)]
                k.add(i, np.array(want[i], "<u4").tobytes())
            k.flush(last=True)
            padding = check([r[:7] for r in k.rows], want, 64)
            assert padding <= p.GAP * len({r[5] for r in k.rows})


def test_frame(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash") for i, t in enumerate([None, *texts()])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = p.pack_documents(df, PATH, with_ids=True).collect()
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    assert check([tuple(r)[:7] for r in out], want, 4096) <= p.GAP * len({r["sequence_id"] for r in out})
    assert all(len(r["ids"]) == r["length"] for r in out)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["start"] + 0) for r in p.pack_documents(twice.coalesce(1), PATH).collect())[0][0] == 0
    assert sum(r["length"] for r in p.pack_documents(twice, PATH).collect()) == 8
    assert p.pack_documents(df.limit(0), PATH).count() == 0
