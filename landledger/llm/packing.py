"""Packing documents into windows of tokens by non-negative least squares.

Each task packs what its partition holds, block by block, so nothing is shuffled and no length, source or
copy group can be hot.  A document's ids (end id included) are cut at full windows, which are sequences
of their own; what remains has a length below the window.  For a block of remainders:

1. Enumerate shallow combinations (two or three lengths that occur) that fill a window exactly.
2. Solve for non-negative repeat counts whose use of each length is nearest, in squares, to the block's
   histogram (Gauss-Seidel), round (largest remainders up), and take as many of each as the block has documents for; once more for
   what is left.
3. Pack the residual greedily: longest first, each time with the longest that still fits, keeping windows
   that are full up to ``GAP`` ids.
4. Lay what is left end to end and cut it where windows end.  An incomplete last window is carried into the next
   block; at the end of the partition it is cut into sequences whose lengths are powers of two, which need no padding.

Ids equal those of the tokenizer library: texts are cut at plain white space, which no token of such a
vocabulary spans, slices of a few megabytes become distinct words and these distinct parts (Arrow kernels), and the library
gives the ids of each distinct part; a table of bounded size remembers some.

Odd inputs: a null or empty text has the end id only.  Repeated rows and ids are each packed, null
ids too.  Other columns are ignored.  An empty table gives no rows.  Memory: a block of ``BLOCK_IDS`` ids.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_automaton import Remembered
from .runs import Runs, chosen, cut, distinct, list_ends, runs_of, slices, strings

WINDOW, END_ID = 4096, 2
BLOCK_IDS = 6_000_000
#: Ids of padding that a greedily packed window may have.
GAP = 2
TRIPLES_PER_LENGTH, SWEEPS = 6, 4
#: The counts are solved for once more on what the first round leaves.
ROUNDS = 2
#: Entries of the table of parts of words, two generations (about 150 bytes an entry).
MOST_PARTS = 120_000
#: Words of printable ASCII and accented Latin letters need no normalizer but lower case, and this form of the library's own pattern.
PLAIN_WORD = "^[!-~À-ÖØ-öø-ÿ]+$"
PART = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


class WordTokenizer:
    """Ids by the ``tokenizers`` library, each distinct part of a slice of texts once.  For vocabularies whose tokens never span white space and that drop it."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel

        self.lib = Tokenizer.from_file(path)
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin = str.maketrans({c: self.as_bytes(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.parts = Remembered(MOST_PARTS)
        self.special = "|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())

    def _part(self, part: str, mapped: bool = False) -> bytes:
        """Ids of one pre-token; ``mapped``: its bytes stand as the library's byte characters."""
        ids = array("I", [t.id for t in self.lib.model.tokenize(part if mapped or part.isascii() else part.translate(self.latin))]).tobytes()
        if len(part) <= 40 and not mapped:
            self.parts.put(part, ids)
        return ids

    def _odd_word(self, word: str) -> bytes:
        """With other characters, or a special string, the library's own steps."""
        if self.special and re.search(self.special, word):
            return array("I", self.lib.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([self._part(p, True) for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(word))])

    def encode(self, texts: pa.Array) -> Runs:
        """For each text its ids (unsigned 32-bit).  Texts become distinct words, and words distinct parts."""
        split = pc.ascii_split_whitespace(texts)
        number, words = distinct(split.flatten())
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(words, self.special))
        lists = cut(pc.utf8_lower(words.filter(plain)), PART)
        part_number, parts = distinct(lists.flatten())
        get, miss = self.parts.new.get, self._part
        of_part = runs_of([(get(p) or self.parts.older(p) or miss(p)) if p else b"" for p in strings(parts)], "<u4")
        of_plain = of_part.take(part_number).joined(list_ends(lists))
        rest = pc.invert(plain)
        of_rest = runs_of([self._odd_word(w) if w else b"" for w in strings(words.filter(rest))], "<u4")
        both, place = chosen(plain.to_numpy(zero_copy_only=False).astype(bool), of_plain, of_rest)
        return both.take(place[number]).joined(list_ends(split))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs, and for each length some triples spread over the range, that add up to ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in lengths if 2 * a <= window and there[window - a]]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (a + 2 * lengths <= window)]
        b = b[there[window - a - b]]
        for k in np.unique(np.linspace(0, len(b) - 1, TRIPLES_PER_LENGTH).astype(int)) if len(b) else ():
            out.append((int(a), int(b[k]), int(window - a - b[k])))
    return out


def repeat_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int]) -> list[float]:
    """min ||A x - h||, x >= 0, by cyclic coordinate descent; A's columns are the patterns."""
    rest = defaultdict(float, histogram)
    uses = [tuple(Counter(p).items()) for p in patterns]
    norms = [sum(c * c for _, c in u) for u in uses]
    x = [0.0] * len(patterns)
    for _ in range(SWEEPS):
        for j, u in enumerate(uses):
            new = max(0.0, x[j] + sum(rest[n] * c for n, c in u) / norms[j])
            if new != x[j]:
                for n, c in u:
                    rest[n] -= c * (new - x[j])
                x[j] = new
    return x


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[int, int]]]:
    """Patterns with repeat counts, and (length, count) of what is to be laid end to end."""
    left = dict(histogram)
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(p: tuple[int, ...], most: int) -> None:
        k = min(most, *(left[n] // c for n, c in Counter(p).items()))
        if k > 0:
            chosen.append((p, k))
            for n in p:
                left[n] -= k

    for _ in range(ROUNDS):
        patterns = combinations(np.array(sorted(n for n, c in left.items() if c > 0), int), window)
        solved = list(zip(patterns, repeat_counts(patterns, left), strict=True))
        for p, x in sorted(solved, key=lambda y: -y[1]):
            take(p, int(x))
        for p, x in sorted(solved, key=lambda y: int(y[1]) - y[1]):  # the largest remainders are rounded up
            take(p, int(x > int(x)))
    keys = sorted(n for n, c in left.items() if c > 0)
    end_to_end: list[tuple[int, int]] = []
    while keys:
        room, p, used = window, [], Counter()
        while room > 0:
            at = bisect.bisect_right(keys, room) - 1
            while at >= 0 and used[keys[at]] >= left[keys[at]]:
                at -= 1
            if at < 0:
                break
            p.append(keys[at])
            used[keys[at]] += 1
            room -= keys[at]
        k = min(left[n] // c for n, c in used.items())
        if room <= GAP:
            chosen.append((tuple(p), k))
        else:
            end_to_end += [(n, c * k) for n, c in used.items()]
        for n, c in used.items():
            left[n] -= c * k
            if not left[n]:
                keys.pop(bisect.bisect_left(keys, n))
    return chosen, end_to_end


class Packer:
    """Packs the documents of one partition.  Sequence ids start at ``first``."""

    def __init__(self, first: int, window: int):
        self.next, self.window = first, window
        self.rows: list[tuple] = []  # (id, start, length, crc, tokens of the document, sequence, offset, ids)
        self.block: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0
        self.tail: list[tuple] = []

    def _emit(self, doc: tuple, start: int, stop: int, sequence: int, offset: int) -> None:
        key, base, ids, total = doc
        part = ids[4 * start : 4 * stop]
        self.rows.append((key, base + start, stop - start, zlib.crc32(part), total, sequence, offset, part))

    def add(self, key: int, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total, self.window):
            doc = (key, start, ids[4 * start : 4 * (start + self.window)], total)
            n = len(doc[2]) // 4
            if n == self.window:
                self._emit(doc, 0, n, self.next, 0)
                self.next += 1
            else:
                self.block[n].append(doc)
                self.held += n
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self, last: bool = False) -> None:
        chosen, end_to_end = plan({n: len(d) for n, d in self.block.items()}, self.window)
        for p, k in chosen:
            for _ in range(k):
                offset = 0
                for n in p:
                    self._emit(self.block[n].pop(), 0, n, self.next, offset)
                    offset += n
                self.next += 1
        stream = self.tail + [self.block[n].pop() for n, k in end_to_end for _ in range(k)]
        self.block, self.held, self.tail = defaultdict(list), 0, []
        remaining = sum(len(d[2]) // 4 for d in stream)
        offset, room = 0, self.window
        for at, doc in enumerate(stream):
            start, stop = 0, len(doc[2]) // 4
            while start < stop:
                if offset == 0:
                    if remaining < self.window:
                        if not last:  # the next block continues here
                            self.tail = [(doc[0], doc[1] + start, doc[2][4 * start :], doc[3]), *stream[at + 1 :]]
                            return
                        room = 1 << (remaining.bit_length() - 1)
                    else:
                        room = self.window
                n = min(stop - start, room - offset)
                self._emit(doc, start, start + n, self.next, offset)
                start, offset, remaining = start + n, offset + n, remaining - n
                if offset == room:
                    offset = 0
                    self.next += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Columns, a row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` also ids."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def per_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, window)
        end = end_id.to_bytes(4, "little")
        encode = word_tokenizer(tokenizer_path).encode
        id_type = None

        def done() -> Iterator[pa.RecordBatch]:
            held, packer.rows = packer.rows, []
            for k in range(0, len(held), 10_000):
                cols = list(zip(*held[k : k + 10_000], strict=True))
                arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in cols[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for b in batches:
            id_type = b.column(0).type
            keys = iter(b.column(0).to_pylist())
            for texts in slices(b.column(1)):
                for ids in encode(texts).bytes():
                    packer.add(next(keys), ids + end)
                    if len(packer.rows) >= 20_000:
                        yield from done()
        packer.flush(last=True)
        yield from done()

    out = rows.mapInArrow(per_partition, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]) + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)
