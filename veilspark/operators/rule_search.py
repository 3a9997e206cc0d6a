"""Search of lines for the texts of many rules at once: places are compared by the eight bytes that stand there."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers receive the search by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a piece at most: texts are found by a piece of so many, shorter ones whole.
MOST = 8
#: Places that are looked at together, and pairs of a place and a text, or of a line and a rule.
BLOCK, PAIRS = 1 << 19, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _code(text: bytes) -> int:
    """The first eight bytes as a number, the first being the lowest."""
    return int.from_bytes(text[:MOST], "little")


def _lists(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists as one: ``(starts, counts, values)``."""
    counts = np.array([len(r) for r in rows], np.int64)
    return np.cumsum(counts) - counts, counts, np.array([v for r in rows for v in r], np.int64)


def _spread(which: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the lists ``which`` its place in ``which``, and the value."""
    starts, counts, values = lists
    n = counts[which]
    at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(which)), n), values[at]


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Slices of which the counts are ``PAIRS`` together at most, or one alone."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        yield slice(start, stop)
        start = stop


class TextSearch:
    """Finds for each line the rules that may match it: those of which it holds a text of each set, and few more.

    ``rules`` have sets of texts, lower-cased, one set at least; of the lines ASCII letters are lower-cased. A text is found by the
    one of its pieces that the fewest texts share, and then by its first and last eight bytes. Rules are looked up by the one of their
    sets that the fewest rules share, so that common texts gather no crowd of rules.
    """

    def __init__(self, rules: list[list[list[str]]]):
        named: dict[tuple[str, ...], int] = {}
        own = [[named.setdefault(tuple(texts), len(named)) for texts in sets] for sets in rules]
        numbers: dict[str, int] = {}
        of_text: list[list[int]] = []
        for texts, k in named.items():
            for text in texts:
                if numbers.setdefault(text, len(of_text)) == len(of_text):
                    of_text.append([])
                of_text[numbers[text]].append(k)
        self.sets = _lists(of_text)  # of a text
        sharing = Counter(k for sets in own for k in sets)
        crowd = {k: sum(sharing[x] for text in texts for x in of_text[numbers[text]]) for texts, k in named.items()}
        by_set: list[list[int]] = [[] for _ in named]
        self.also = np.zeros((len(rules), max([1, *map(len, own)]) - 1), np.int64)  # a rule's other sets
        for rule, sets in enumerate(own):
            first, *others = sorted(sets, key=lambda k: (crowd[k], k))
            by_set[first].append(rule)
            self.also[rule] = (others + [first] * self.also.shape[1])[: self.also.shape[1]]
        self.rules = _lists(by_set)  # of a set
        self._index([t.encode() for t in numbers])

    @classmethod
    def of(cls, state: dict) -> TextSearch:
        """From ``vars()`` of another: plain arrays, which travel without the class."""
        found = cls.__new__(cls)
        found.__dict__.update(state)
        return found

    def _index(self, texts: list[bytes]) -> None:
        pieces = [sorted({t[i : i + MOST] for i in range(max(1, len(t) - MOST + 1))}) for t in texts]
        shared = Counter(p for some in pieces for p in some)
        chosen = [min(some, key=lambda p: (shared[p], p)) for some in pieces]
        self.offset, self.length = (np.array(x, np.int64) for x in ([t.find(p) for t, p in zip(texts, chosen, strict=True)], [len(t) for t in texts]))
        self.first, self.last = (np.array(x, np.uint64) for x in ([_code(t) for t in texts], [_code(t[-MOST:]) for t in texts]))
        self.sizes = []
        for size in sorted({len(p) for p in chosen}):
            held: dict[int, list[int]] = {}
            for k, piece in enumerate(chosen):
                if len(piece) == size:
                    held.setdefault(_code(piece), []).append(k)
            keys = np.array(sorted(held), np.uint64)
            shift = np.uint64(64 - max(12, (16 * len(keys)).bit_length()))
            known = np.zeros(1 << (64 - int(shift)), bool)
            known[(keys * _MIX) >> shift] = True
            self.sizes.append((size, np.uint64((1 << 8 * size) - 1), shift, known, keys, _lists([held[int(k)] for k in keys])))

    def _held(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Lines and the sets of which they hold a text, as numbers ``line * sets + set``, by blocks of places."""
        for at in range(0, len(codes), BLOCK):
            here = codes[at : at + BLOCK].astype(np.uint64)
            for size, mask, shift, known, keys, texts in self.sizes:
                own = here if size == MOST else here & mask
                some = np.flatnonzero(known[(own * _MIX) >> shift])
                key = np.minimum(np.searchsorted(keys, own[some]), len(keys) - 1)
                same = keys[key] == own[some]
                some, key = some[same] + at, key[same]
                for part in _slices(texts[1][key]):
                    place, text = _spread(key[part], texts)
                    begin = some[part][place] - self.offset[text]
                    line = np.searchsorted(bounds, begin + self.offset[text], "right") - 1
                    end = begin + self.length[text]
                    inside = (begin >= bounds[line]) & (end <= bounds[line + 1])
                    line, text, begin, end = line[inside], text[inside], begin[inside], end[inside]
                    if size == MOST:
                        whole = (codes[begin] == self.first[text]) & (codes[end - MOST] == self.last[text])
                        line, text = line[whole], text[whole]
                    line, text = np.divmod(np.unique(line * len(self.length) + text), len(self.length))
                    place, found = _spread(text, self.sets)
                    yield np.unique(line[place] * len(self.rules[0]) + found)

    def _numbers(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Lines and rules as numbers ``line * rules + rule``, in order."""
        codes = np.ndarray(len(data), "<u8", np.concatenate([_LOWER[data], np.zeros(MOST, np.uint8)]).data, strides=(1,))
        sets, rules = len(self.rules[0]), len(self.also)
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *self._held(codes, bounds)]))
        # Which sets a line holds is told by a hash, which is wrong at times: a rule more is tried then.
        shift = np.uint64(64 - max(12, (8 * len(held)).bit_length()))
        seen = np.zeros(1 << (64 - int(shift)), bool)
        seen[(held.astype(np.uint64) * _MIX) >> shift] = True
        line, key = np.divmod(held, sets)
        found = [np.zeros(0, np.int64)]
        for part in _slices(self.rules[1][key]):
            place, rule = _spread(key[part], self.rules)
            own = line[part][place]
            for other in range(self.also.shape[1]):
                both = seen[((own * sets + self.also[rule, other]).astype(np.uint64) * _MIX) >> shift]
                own, rule = own[both], rule[both]
            found.append(own * rules + rule)
        return np.unique(np.concatenate(found))

    def numbers(self, lines: pa.Array) -> pa.Array:
        """For each line the numbers of the rules that may match it, each once and in order; none for a null."""
        lines = lines.cast(pa.large_string())
        bounds = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
        line, rule, at = [], [], 0
        while at < len(lines):
            stop = max(at + 1, min(len(lines), int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1))
            own, found = np.divmod(self._numbers(data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]), len(self.also))
            line.append(own + at)
            rule.append(found)
            at = stop
        line, rule = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (line, rule))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(len(lines) + 1)), pa.int32()), pa.array(rule, pa.int32()))
