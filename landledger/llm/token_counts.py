"""Token counts by a compiled finite-state transducer.

The vocabulary of a SentencePiece byte-pair model is compiled into a deterministic transducer whose
transitions carry the number of tokens they add (``piece_automaton``).  A text is cut into chunks; each
chunk's effect is a map from the state before it to the state after it and the tokens emitted, and such
maps compose associatively, so a parallel prefix scan gives every chunk its starting state and the text
its total.  A map is short: from its first segment boundary on a chunk ends in the same state with
the same count whatever came before, so only the characters before that boundary stay symbolic.

Odd inputs: a null text counts as empty and has 0 tokens and bytes.  An empty table gives an empty table.  Repeated rows and ids
are all returned.  Other columns are ignored.  Memory: a slice of texts (or one long text) and tables of bounded size in each worker,
also inside one long text without spaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_automaton import PieceAutomaton, State, as_segments, automaton, marked_pieces
from .runs import distinct, slices

LIMIT = 4096
#: Bytes of a chunk.
CHUNK = 1 << 12


class ChunkMap(NamedTuple):
    """What a chunk does to a state: read ``head``; then, if ``after`` is set, add ``count`` and be in ``after``."""

    head: str
    count: int
    after: State | None


def chunk_maps(auto: PieceAutomaton, pieces: pa.Array, first: np.ndarray) -> list[ChunkMap]:
    """``pieces`` are cut at segment starts and chunk starts, ``first`` has the number of each chunk's first piece.

    Whole segments inside a chunk count the same whatever came before, each distinct one once; a chunk's first
    piece stays symbolic, and its last one, which the next chunk may continue, gives the state.
    """
    number, words = distinct(pieces)
    known, miss = auto.counts.new.get, auto.count_segment
    counts = np.array([known(s) or miss(s) for s in as_segments(words)], np.int64)  # no segment has 0 tokens
    before = np.concatenate([[0], np.cumsum(counts[number])])
    last = np.append(first[1:], len(pieces))[: len(first)] - 1
    inside = before[last] - before[np.minimum(first + 1, last)]
    out = []
    for head, tail, n, one in zip(as_segments(pieces.take(first)), as_segments(pieces.take(last)), inside.tolist(), (first == last).tolist(), strict=True):
        if one:
            out.append(ChunkMap(head, 0, None))
        else:
            more, state = auto.run(auto.start, tail)
            out.append(ChunkMap(head, n + more, state))
    return out


def compose(auto: PieceAutomaton, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """First ``a``, then ``b``.  Associative."""
    if a.after is None:
        return ChunkMap(a.head + b.head, b.count, b.after)
    more, state = auto.run(a.after, b.head)
    return ChunkMap(a.head, a.count + more + b.count, state if b.after is None else b.after)


def prefix_scan(auto: PieceAutomaton, maps: Sequence[ChunkMap]) -> list[ChunkMap]:
    """Inclusive scan in pairs: half as many maps at each level, so the depth is the logarithm of their number."""
    if len(maps) <= 1:
        return list(maps)
    pairs = [compose(auto, maps[k], maps[k + 1]) for k in range(0, len(maps) - 1, 2)]
    done = prefix_scan(auto, pairs)
    out = [maps[0]]
    for k in range(1, len(maps)):
        out.append(done[k // 2] if k % 2 else compose(auto, done[k // 2 - 1], maps[k]))
    return out


def count_tokens(auto: PieceAutomaton, texts: pa.Array, chunk: int = CHUNK) -> list[int]:
    """Every text takes the same way: the maps of its chunks, their scan, and the whole's map applied to the start state."""
    out: list[int] = []
    for some in slices(texts):
        pieces, first, ends = marked_pieces(some, chunk)
        maps, start = chunk_maps(auto, pieces, first), 0
        for stop in ends.tolist():
            if stop == start:
                out.append(0)
                continue
            whole = prefix_scan(auto, maps[start:stop])[-1]
            out.append(auto.run(auto.start, whole.head)[0] + whole.count)
            start = stop
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Columns: the id, n_bytes, n_tokens, over_limit.  ``model_path`` must be readable on the executors."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count_tokens(auto, b.column(1)), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(per_batch, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
