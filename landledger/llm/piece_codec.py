"""SentencePiece encoding and decoding by streaming Viterbi.

The model's encoding is the one path through the piece lattice whose neighbours tolerate each other
(``piece_automaton``); any other path has no weight.  So Viterbi keeps one backpointer for each position,
and only positions from which a piece could still reach the next character survive: no further back
than the longest piece.  The paths of all surviving positions are followed back, and once they meet at
one boundary the ids before it are committed and dropped.  Characters without a piece become bytes.

Ids equal the library's for the model.  Decoding joins pieces and bytes, turns marks into spaces and drops
the space put in front; like the library it can't tell a mark that was in the text from a space.

Odd inputs: a null text encodes as null ids, an empty one as none.  Null ids decode to null.
An empty table gives an empty table.  Repeated rows and ids are all returned.  Other columns are ignored.  Memory: a slice of
texts, or one longer text, with a window of the longest piece for each text that is being encoded.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_automaton import MOST_SEGMENTS, MOST_STATES, SPACE, PieceAutomaton, Remembered, as_segments, automaton, marked_pieces
from .runs import Runs, distinct, runs_of, slices


class StreamingEncoder:
    """Feed characters (spaces marked) and get ids as soon as they are certain."""

    def __init__(self, auto: PieceAutomaton):
        self.auto, self.state = auto, auto.start
        self.back: list[str] = []  # the last token of each position that isn't committed

    def _path(self, end: int) -> list[int]:
        """Ids of the path that ends after ``end`` of the held positions."""
        ids: list[int] = []
        known, back = self.auto.ids.get, self.back
        while end:
            token = back[end - 1]
            end -= len(token)
            one = known(token)
            if one is None:
                ids += reversed(self.auto.tokens_of(token))
            else:
                ids.append(one)
        ids.reverse()
        return ids

    def _meet(self) -> int:
        """The latest boundary that the paths of all surviving positions share."""
        n = len(self.back)
        ends = {n - len(since) for since, _, _ in self.state.live}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - len(self.back[last - 1]))
        return ends.pop()

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        auto, back, state = self.auto, self.back, self.state
        step, window = auto.step, 2 * auto.longest
        for ch in text:
            state = (state.trans.get(ch) or step(state, ch))[1]
            back.append(state.last)
            if len(back) >= window:
                self.state = state
                if at := self._meet():
                    out += self._path(at)
                    del back[:at]
                if len(auto.states) > MOST_STATES:
                    auto.reset()
                    state = auto.state_like(state)
        self.state = state
        return out

    def close(self) -> list[int]:
        out = self._path(len(self.back))
        self.back, self.state = [], self.auto.start
        return out


class Codec:
    def __init__(self, auto: PieceAutomaton):
        self.auto = auto
        self.known = Remembered(MOST_SEGMENTS)
        byte_of = {i: bytes([b]) for b, i in auto.bytes.items()}
        self.table = runs_of([byte_of.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(auto.pieces)], "u1")

    def _segment(self, segment: str) -> bytes:
        """At the end of a segment all paths meet, so its ids can be kept for the next time."""
        known = self.known.older(segment)
        if known is None:
            if len(self.auto.states) > MOST_STATES:
                self.auto.reset()
            one = StreamingEncoder(self.auto)
            known = array("i", one.feed(segment) + one.close()).tobytes()
            if len(segment) <= 40:
                self.known.put(segment, known)
        return known

    def encode(self, texts: pa.Array) -> Runs:
        """The ids of each text (one slice of them).  Each distinct segment goes through the streaming encoder once."""
        pieces, first, ends = marked_pieces(texts)
        number, words = distinct(pieces)
        get, miss = self.known.new.get, self._segment
        found = runs_of([get(s) or miss(s) for s in as_segments(words)], "<i4").take(number)
        stops = np.append(first, len(pieces))
        return found.joined(stops[1:]).joined(ends)

    def decode(self, ids: Runs) -> list[str]:
        raw = self.table.take(ids.flat).joined(ids.ends)
        texts = [b.decode("utf-8", "replace") for b in raw.bytes()]
        return [t[1:] if t[:1] == " " else t for t in texts]


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _codecs:
        _codecs[model_path] = Codec(automaton(model_path))
    return _codecs[model_path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, ids (array of int)."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            done = 0
            for some in slices(b.column(1)):
                ids, missing = c.encode(some), b.column(1).slice(done, len(some)).is_null().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.append(0, ids.ends).astype("int32"), mask=np.append(missing, False))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)), pa.ListArray.from_arrays(offsets, pa.array(ids.flat))], names=["id", "ids"])
                done += len(some)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: the id, text."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            lists = b.column(1)
            texts = c.decode(Runs(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=["id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {kind}, text string").withColumnRenamed("id", id_col)


def codec_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and compare.  Columns: the id, n_ids, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers; 0 and 0 for a null text), round_trip (whether decoding gave the text, marks counted as spaces)."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            done = 0
            for some in slices(b.column(1)):
                ids = c.encode(some)
                crc = [zlib.crc32(x) for x in ids.bytes()]
                same = pc.equal(pa.array(c.decode(ids), pa.large_string()), pc.replace_substring(some, SPACE, " "))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)), pa.array(ids.lengths, pa.int64()), pa.array(crc, pa.int64()), same], names=["id", "n_ids", "ids_crc32", "round_trip"])
                done += len(some)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean").withColumnRenamed("id", id_col)
