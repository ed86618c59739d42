"""Where the pre-tokens of byte-level BPE begin, without a regular expression.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is a small automaton once
each code point is replaced by its class, seen with the classes right after it. A class is a function from the state
before to the state after; functions compose associatively, and the few that compositions give are numbered, so a
prefix scan over a block of text is a chain of look-ups in the composition table, made for all blocks at once.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array

import numpy as np

LETTER, DIGIT, OTHER, BLANK, SPACE, LAST, QUOTE1, QUOTE2, END = range(9)
OPEN, IN_LETTERS, IN_DIGITS, IN_OTHERS, IN_BLANKS, JOINED, TAIL1, TAIL2 = range(8)
STATES = 8

# fixed values: white space as the pattern's \s has it
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after, and whether a pre-token begins at the symbol."""
    if symbol == LETTER:
        if state in (IN_LETTERS, JOINED):
            return IN_LETTERS, False
        if state in (TAIL1, TAIL2):
            return (OPEN if state == TAIL1 else TAIL1), False
        return IN_LETTERS, True
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, JOINED)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_OTHERS, JOINED):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, QUOTE1: TAIL1, QUOTE2: TAIL2}[symbol], True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return {SPACE: JOINED, LAST: OPEN, END: OPEN}[symbol], True


class Automaton:
    """The transition functions that compositions of symbols give, numbered, with their composition table."""

    def __init__(self):
        one = [tuple(step(s, c)[0] for s in range(STATES)) for c in range(END + 1)]
        functions = {tuple(range(STATES)): 0}
        todo = list(functions)
        while todo:
            f = todo.pop()
            for g in one:
                h = tuple(g[x] for x in f)
                if h not in functions:
                    functions[h] = len(functions)
                    todo.append(h)
        every = list(functions)
        self.symbols = END + 1
        self.then_symbol = np.array([[functions[tuple(g[x] for x in f)] for g in one] for f in every], np.uint16)
        self.then = np.array([[functions[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
        self.apply = np.array(every, np.uint8)
        self.begins = np.array([[step(s, c)[1] for c in range(END + 1)] for s in range(STATES)])

    def boundaries(self, symbols: np.ndarray, width: int = 64) -> np.ndarray:
        """True where a pre-token begins; the text starts in state OPEN."""
        n = len(symbols)
        count = -(-n // width)
        padded = np.full(count * width, END, np.uint8)
        padded[:n] = symbols
        rows = np.ascontiguousarray(padded.reshape(count, width).T)  # one column a block
        prefix = np.empty((width, count), np.uint16)
        table = self.then_symbol.ravel()
        f = np.zeros(count, np.uint16)
        for i in range(width):
            f = table[f * self.symbols + rows[i]]
            prefix[i] = f
        # inclusive scan of the blocks' functions in log steps, then each block's entry state
        total, k = f.astype(np.intp), 1
        while k < count:
            total = np.concatenate([total[:k], self.then[total[:-k], total[k:]]])
            k *= 2
        entry = np.concatenate([[OPEN], self.apply[total[:-1], OPEN]]).astype(np.uint8)
        after = self.apply.ravel()[prefix * np.uint16(STATES) + entry]
        before = np.vstack([entry[None, :], after[:-1]])
        return self.begins.ravel()[before * self.symbols + rows].T.reshape(-1)[:n]


def class_table() -> np.ndarray:
    """The class of each code point: LETTER, DIGIT, OTHER, BLANK (white space) or SPACE (U+0020)."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = DIGIT
    kinds[WHITE] = BLANK
    kinds[0x20] = SPACE
    return kinds


class PreTokenizer:
    def __init__(self):
        self.kinds = class_table()
        self.automaton = Automaton()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each position's symbol; ``ends`` are the positions after each text's last code point."""
        kinds = self.kinds[points]
        kinds[ends] = END
        following = np.append(kinds[1:], END)
        blank = (kinds == BLANK) | (kinds == SPACE)
        meets = blank & (following <= OTHER)  # white space right before something else
        out = kinds.copy()
        out[blank] = BLANK
        out[meets & (kinds == SPACE)] = SPACE
        out[meets & (kinds == BLANK)] = LAST
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            quotes = quotes[kinds[quotes] == OTHER]
            more = np.append(points, [0, 0]).astype(np.int64)
            a, b = more[quotes + 1], more[quotes + 2]
            out[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE1
            out[quotes[np.isin(a << 21 | b, [ord(x) << 21 | ord(y) for x, y in ("re", "ve", "ll")])]] = QUOTE2
        return out

    def slices(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pre-tokens of the texts in order, and how many each text has."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        starts = np.flatnonzero(self.automaton.boundaries(self.symbols(points, ends)))
        stops = np.append(starts[1:], len(points))
        real = np.ones(len(points), bool)
        real[ends] = False
        keep = real[starts]
        starts, stops = starts[keep], stops[keep]
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())], counts


def segments(text: str, size: int = 1 << 20):
    """A long text in parts of about ``size`` code points, cut only where a pre-token surely begins:
    before a single space with no white space on either side. Without such a place the text stays whole."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Pieces(dict):
    """Pre-token to its place in a growing table of id lists; what is new goes through ``encode``.

    Holds at most ``limit`` entries (checked between blocks): beyond it the table starts anew.
    """

    def __init__(self, encode, limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.reset()

    def reset(self):
        self.clear()
        self.ids = array("i")
        self.starts = array("q")
        self.known = -1

    def __missing__(self, piece: str) -> int:
        self.starts.append(len(self.ids))
        self.ids.extend(self.encode(piece))
        self[piece] = place = len(self.starts) - 1
        return place

    def arrays(self):
        if self.known != len(self.starts):
            self.flat = np.array(self.ids, np.int32)
            self.first = np.array(self.starts, np.int64)
            self.count = np.diff(np.append(self.first, len(self.flat)))
            self.known = len(self.starts)
        return self.flat, self.first, self.count


class Encoder:
    """Texts to ids, block by block; ``encode`` gives the ids of one pre-token."""

    def __init__(self, encode):
        self.pre = PreTokenizer()
        self.pieces = Pieces(encode)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text)"""
        parts, owner = [], []
        for k, text in enumerate(texts):
            for part in segments(text) if len(text) > 1 << 20 else (text,):
                parts.append(part)
                owner.append(k)
        found, sizes, at = [], [], 0
        while at < len(parts):  # a block is one text at least; a very long text goes part by part
            end = at + 1
            held = len(parts[at])
            while end < len(parts) and held + len(parts[end]) <= 1 << 20:
                held += len(parts[end])
                end += 1
            ids, counts = self.some(parts[at:end])
            found.append(ids)
            sizes.append(counts)
            at = end
        counts = np.zeros(len(texts), np.int64)
        if sizes:
            np.add.at(counts, owner, np.concatenate(sizes))
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), counts

    def some(self, texts: list[str]):
        if len(self.pieces) > self.pieces.limit:
            self.pieces.reset()
        words, per_text = self.pre.slices(texts)
        place = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
        flat, first, count = self.pieces.arrays()
        n = count[place] if len(place) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(first[place] - (ends - n), n)] if total else np.zeros(0, np.int32)
        edges = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
        return ids, np.diff(edges)
