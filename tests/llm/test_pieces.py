import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from landledger.llm import piece_codec, token_counts
from landledger.llm.piece_automaton import PieceAutomaton, automaton
from landledger.llm.runs import slices

PATH = public_tokenizers.path("piece_bpe_32k.model")
LONG = ["a" * 5000, "ab" * 3000, "漢" * 1000, "=" * 4000, " " * 3000 + "x", "th" * 4000 + "e"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n=600):
    rng = random.Random(1)
    parts = ["a", "b", "th", "er", " ", "  ", "\n", "é", "漢", "𝄞", "▁", "in", "ation", "0", "!", "...", "\t", "\x00", "A", "▁▁▁", "//", "</s>", "<unk>", "ß", "́", "�"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_and_ids_equal_the_library(library):
    auto, c = automaton(PATH), piece_codec.codec(PATH)
    some = [*texts(), *LONG, "", None]
    want = [library.encode(t or "") for t in some]
    column = pa.array(some, pa.string())
    for chunk in (1, 7, 64, token_counts.CHUNK):
        assert token_counts.count_tokens(auto, column, chunk) == [len(x) for x in want], chunk
    for part in slices(column, 1 << 30):
        ids = c.encode(part)
        assert [np.frombuffer(x, "<i4").tolist() for x in ids.bytes()] == want
        assert c.decode(ids) == [library.decode(x) for x in want]


def test_neighbours_tolerate_each_other_by_definition():
    auto = automaton(PATH)
    rng, pieces = random.Random(5), sorted(auto.ids)
    some = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(4000)]
    for word in rng.sample(pieces, 1500):  # neighbours that share a longer piece are the hard cases
        k = rng.randint(1, max(1, len(word) - 1))
        some += [(word[:k], word[k:]), (word, word[-k:]), (word[:k], word)]
    some += [("ab", "b"), ("s", "ss"), ("▁sports", "ss"), ("▁▁", "▁"), ("▁", "▁a"), ("***", "**"), ("漢", "𝄞")]
    for left, token in some:
        if left in auto.ids and token in auto.ids:
            assert auto._tolerates(left, token) == (auto.merge(left + token) == [left, token]), (left, token)


def test_models_that_change_texts_are_refused(library, monkeypatch):
    class Squeezing(sentencepiece.SentencePieceProcessor):
        def encode(self, text):
            return super().encode(" ".join(text.split()))

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Squeezing)
    with pytest.raises(ValueError, match="alters texts"):
        PieceAutomaton(PATH)


def maps_of(auto, *chunks):
    """A map for each chunk (spaces marked)."""
    pieces = [re.split("(?<=[^▁])(?=▁)", c.replace(" ", "▁")) for c in chunks]
    first = np.cumsum([0] + [len(p) for p in pieces])[:-1]
    return token_counts.chunk_maps(auto, pa.array([x.replace("▁", " ") for p in pieces for x in p], pa.large_string()), first)


def test_chunk_maps_compose_associatively(library):
    auto = automaton(PATH)
    rng = random.Random(2)
    same = lambda x, y: x[:2] == y[:2] and (x.after is None) == (y.after is None)
    for _ in range(200):
        a, b, c = maps_of(auto, *("".join(rng.choice("▁▁aeth") for _ in range(rng.randint(1, 9))) for _ in range(3)))
        left = token_counts.compose(auto, token_counts.compose(auto, a, b), c)
        assert same(left, token_counts.compose(auto, a, token_counts.compose(auto, b, c)))
    maps = maps_of(auto, *("▁the▁ration"[k % 5 : k % 5 + 4] for k in range(13)))
    scan = token_counts.prefix_scan(auto, maps)
    one = maps[0]
    for k in range(1, 13):
        one = token_counts.compose(auto, one, maps[k])
        assert same(scan[k], one)


def test_window_stays_short():
    e = piece_codec.StreamingEncoder(automaton(PATH))
    most = 0
    for ch in "thereation" * 2000:
        e.feed(ch)
        most = max(most, len(e.back))
    assert most <= 3 * e.auto.longest


def test_small_tables_forget_but_stay_right(library, monkeypatch):
    monkeypatch.setattr("landledger.llm.piece_automaton.MOST_STATES", 50)
    monkeypatch.setattr("landledger.llm.piece_codec.MOST_STATES", 50)
    auto, c = automaton(PATH), piece_codec.codec(PATH)
    monkeypatch.setattr(auto.counts, "most", 20)
    some = [*texts(100), *LONG]
    want = [len(library.encode(t)) for t in some]
    assert token_counts.count_tokens(auto, pa.array(some)) == want
    assert c.encode(next(slices(pa.array(some), 1 << 30))).lengths.tolist() == want
    assert len(auto.states) < 9000


def test_frames(spark, library):
    rows = [(1, None, "x", 9), (2, "", "x", 9), (2, "", "x", 9), (None, "Hello  wörld 漢", "x", 9), (4, "th er " * 2000, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, *_ in rows], key=repr)
    assert sorted(map(tuple, token_counts.token_counts(df, PATH).collect()), key=repr) == want
    enc = piece_codec.encode_texts(df, PATH)
    assert sorted([(r[0], r[1]) for r in enc.collect()], key=repr) == sorted([(i, None if t is None else library.encode(t)) for i, t, *_ in rows], key=repr)
    assert sorted(map(tuple, piece_codec.decode_ids(enc, PATH).collect()), key=repr) == sorted([(i, t) for i, t, *_ in rows], key=repr)
    assert all(r["round_trip"] for r in piece_codec.codec_report(df, PATH).collect())
    assert token_counts.token_counts(df.limit(0), PATH).count() == piece_codec.encode_texts(df.limit(0), PATH).count() == 0
