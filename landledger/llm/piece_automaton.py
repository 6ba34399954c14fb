"""A deterministic transducer for byte-pair encoding with a SentencePiece vocabulary.

The encoding of a prefix of a text is part of the encoding of the text up to a token boundary, and a
sequence of tokens is the encoding of its text exactly if every two neighbours, joined, are encoded
as those two (no merge ever crosses their boundary).  So after each character there is exactly one
token that can end there: the one whose start's own last token tolerates it as a neighbour.

A state holds what later characters can depend on: for each start from which a longer piece could still
come, the characters since, the last token before it, and the token count there less the count here.
The longest piece bounds all of that, so there are finitely many states; they and their transitions
are compiled when first met.  Each transition is annotated with the tokens it adds to the count of
the prefix (fewer than none where a longer token takes the place of several).

Whether two neighbours tolerate each other is decided without encoding them: their last merges are undone in
turn, latest first, and at no time may the parts that then meet at their boundary be a piece of an earlier rank.

Models that alter texts first (folding, squeezing spaces, no space in front) or that aren't of the byte-pair kind
are refused: probes must come out as the library's.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runs import strings

SPACE = "▁"
#: No piece has the space mark after another character; what stands between such places is encoded alone.
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries after which the compiled tables of a process start anew (memory stays bounded; results don't depend on it).
MOST_STATES, MOST_PAIRS, MOST_SEGMENTS = 150_000, 400_000, 300_000
_PROBES = ("a", " two  spaces ", "Hello, world: 3.14159!", "ﬁ Ａ é é ①", "\t tab\nline \r\n", "日本 𝄞 \u200b", "internationalisation of unbelievable misunderstandings", "aaaa    bbbb", "▁a ▁")
_ALWAYS = 1 << 60


class Remembered:
    """A table of bounded size: the entries of the last generation and those of the one before that are asked for again."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def older(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old = dict(self.new)
            self.new.clear()  # the same object stays, so that its bound ``get`` does
        self.new[key] = value


class State:
    __slots__ = ("last", "live", "trans")

    def __init__(self, live: tuple, last: str | None):
        self.live, self.last, self.trans = live, last, {}


class PieceAutomaton:
    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces cross spaces; this vocabulary can't be cut into segments")
        ranks = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.order = {p: ranks[score] for p, score in self.scores.items() if len(p) > 1}
        self.made: dict[str, tuple[int, str, str] | None] = {}
        self.counts = Remembered(MOST_SEGMENTS)
        self.reset()
        for text in _PROBES:
            if [i for s in SEGMENT.findall(escaped(text)) for t in self.merge(s) for i in self.tokens_of(t)] != sp.encode(text):
                raise ValueError("this model is no plain byte-pair model, or alters texts before it encodes them")

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.start = self._state((("", None, 0),), None)

    def _state(self, live: tuple, last: str | None) -> State:
        found = self.states.get((live, last))
        if found is None:
            found = self.states[live, last] = State(live, last)
        return found

    def state_like(self, old: State) -> State:
        """The state of the tables as they are now that stands for one from before a reset."""
        return self._state(old.live, old.last)

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding by its definition: the best-scored merge first, of equals the leftmost.  For short texts."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _made(self, token: str) -> tuple[int, str, str] | None:
        """Rank of the token's last merge, and what it joined.  None if ranks don't rise from merge to merge (pieces of equal scores)."""
        if token in self.made:
            return self.made[token]
        out = None
        if len(token) == 1:
            out = (-1, token, token)
        else:
            parts, last = self._merge(token)
            if len(parts) == 1:
                sides, rank = [self._made(x) for x in last], self.order[token]
                if all(x is not None and x[0] < rank for x in sides):
                    out = (rank, *last)
        if len(self.made) < MOST_PAIRS:
            self.made[token] = out
        return out

    def _tolerates(self, left: str, token: str) -> bool:
        a, b = self._made(left), self._made(token)
        if a is None or b is None:
            return self.merge(left + token) == [left, token]
        limit, rank = _ALWAYS, self.order.get
        while True:
            joined = rank(left + token)
            if joined is not None and joined < limit:
                return False
            if a[0] > b[0]:
                limit, left = a[0], a[2]
                a = self._made(left)
            elif b[0] >= 0:  # of equal ranks the leftmost merge came first: one across the boundary goes before the right side's own
                limit, token = b[0] + 1, b[1]
                b = self._made(token)
            else:
                return True

    def fits(self, left: str | None, token: str) -> bool:
        key = (left, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(token) == [token] if left is None else self._tolerates(left, token)
        return known

    def tokens_of(self, token: str) -> list[int]:
        """Ids of one symbol: its own, or of its bytes."""
        known = self.ids.get(token)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def step(self, state: State, ch: str) -> tuple[int, State]:
        """The transition on ``ch``: tokens added, next state.  Compiled on first use."""
        known = state.trans.get(ch)
        if known is not None:
            return known
        if ch == SPACE and state.last is not None and state.last[-1] != SPACE:
            added, target = self.step(self.start, ch)  # a new segment
        else:
            added = last = None
            for since, before, count in state.live:
                token = since + ch
                if (token in self.ids or not since) and self.fits(before, token):
                    added, last = count + (len(self.tokens_of(token)) if not since else 1), token
                    break
            live = [(since + ch, before, count - added) for since, before, count in state.live if since + ch in self.prefixes]
            live.append(("", last, 0))
            target = self._state(tuple(live), last)
        state.trans[ch] = (added, target)
        return added, target

    def run(self, state: State, text: str) -> tuple[int, State]:
        """Tokens added by ``text``, and the state after it."""
        total, step = 0, self.step
        for at in range(0, len(text), 4096):
            if len(self.states) > MOST_STATES:
                self.reset()
                state = self.state_like(state)
            for ch in text[at : at + 4096]:
                added, state = state.trans.get(ch) or step(state, ch)
                total += added
        return total, state

    def count_segment(self, segment: str) -> int:
        known = self.counts.older(segment)
        if known is None:
            known = self.run(self.start, segment)[0]
            if len(segment) <= 40:
                self.counts.put(segment, known)
        return known


def escaped(text: str) -> str:
    """The text as the model sees it: spaces marked, one put in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def marked_pieces(texts: pa.Array, chunk: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts as the model sees them, but with spaces for its marks, cut at all segment starts and, with ``chunk``, also at
    chunks of about so many bytes (no character is cut).  Returns the pieces, the number of the first piece of each chunk,
    and the number of chunks up to each text's end.  Without ``chunk`` each text that isn't empty is one."""
    plain = pc.replace_substring(texts, SPACE, " ")
    text = lambda t: pa.scalar(t, plain.type)
    marked = pc.if_else(pc.equal(pc.binary_length(plain), 0), text(""), pc.binary_join_element_wise(text(" "), plain, text("")))
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(marked.buffers()[2], np.uint8, high) if high else np.zeros(0, np.uint8)
    starts, stops = offsets[:-1], offsets[1:]
    n = np.minimum(stops - starts, 1) if chunk is None else -(-(stops - starts) // chunk)
    ends = np.cumsum(n)
    cuts, limit = np.repeat(starts, n), np.repeat(stops, n)
    if chunk is not None:
        cuts = cuts + chunk * (np.arange(len(cuts)) - np.repeat(ends - n, n))
        for _ in range(3):
            inside = cuts < limit
            cuts[inside] += (data[cuts[inside]] & 0xC0) == 0x80
        there = cuts < limit
        there[1:] &= ~(there[:-1] & (cuts[1:] == cuts[:-1]))
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        cuts = cuts[there]
    here = data == 32
    begin = np.zeros(high, bool)
    begin[low + 1 : high] = here[low + 1 : high] & ~here[low : high - 1] if high > low else False
    begin[cuts] = True
    at = np.flatnonzero(begin)
    bounds = pa.py_buffer(np.append(at, high).astype(np.int64).tobytes())
    pieces = pa.LargeStringArray.from_buffers(len(at), bounds, marked.buffers()[2] or pa.py_buffer(b""))
    return pieces, np.searchsorted(at, cuts), ends


def as_segments(pieces: pa.Array) -> list[str]:
    return strings(pc.replace_substring(pieces, " ", SPACE))


@lru_cache(maxsize=4)
def automaton(model_path: str) -> PieceAutomaton:
    """One for each process and model."""
    return PieceAutomaton(model_path)
