"""Byte-pair encoding as a deterministic automaton over tokens, compiled once to tables.

Every text has one correct tokenisation, and the sequences that are correct form a regular
language. Its automaton starts with one state and a loop per byte. Each merge (u, v) -> w, in order
of rank, adds a gadget: where u can be followed by v, an arc w bypasses the two and the arc v
leaves the state behind u. All arcs of one label end in one state, so a state is the token read
last: the new state w copies the arcs of v, the new label w stands where u stood.

Most states keep most labels, so a row of the table lists the labels that are gone. Labels are numbered
so that a label and the copies made of it after any merge have numbers in a row; what a gadget takes away from a
state is then one interval, and a state's row a few disjoint ones.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import regex

#: Pre-split pattern of the tokenizer; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the other bytes for the code points from 256 on."""
    own = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    letters, spare = {}, 256
    for b in range(256):
        letters[chr(b if b in own else spare)] = b
        spare += b not in own
    return letters


def read_merges(content: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token ids and merges, by bytes, from the text of a byte-level BPE file."""
    model = json.loads(content)["model"]
    letters = byte_letters()
    raw = lambda t: bytes(letters[c] for c in t)
    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return ids, [(raw(a), raw(b)) for a, b in pairs]


def _numbered(parent: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
    """For every label its number and that of the last copy of it, and the copies made of it directly, the latest first.
    The first 256 labels are no copies."""
    n = len(parent)
    size, copies = [1] * n, [[] for _ in range(n)]
    for c in range(n - 1, 255, -1):
        size[parent[c]] += size[c]
        copies[parent[c]].append(c)
    place, free = [0] * n, 0
    for b in range(256):
        place[b] = free
        free += size[b]
    for t in range(n):  # copies come after what they were made of
        at = place[t] + 1
        for c in copies[t]:
            place[c] = at
            at += size[c]
    return place, [p + k for p, k in zip(place, size)], copies


class Automaton:
    """States and labels are tokens, numbered: bytes first, then merges in order.

    place: the number of each label; row, begin, end: the labels without an arc, by state; step: transitions of the tree
    of labels by byte; spells: the label that ends in a node of the tree, -1 for none; id, text: of each label."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.text = [bytes([b]) for b in range(256)]
        known = {t: k for k, t in enumerate(self.text)}
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            known[a + b] = len(self.text)
            self.text.append(a + b)
            left.append(known[a])
            right.append(known[b])
        n = len(self.text)
        self.id = array("i", (ids[t] for t in self.text))
        place, last, copies = _numbered(left)
        gone: list[list[int]] = [[] for _ in range(n)]  # merges whose gadget took labels from a state
        reach = [0] * n  # of a merge: the end of the interval of labels that it takes
        made = [True] * n
        for w in range(256, n):
            u, v = left[w], right[w]
            # the arc v must be there: a token whose parts never meet gets no state and no gadget
            made[w] = made[u] and made[v] and not any(place[right[g]] <= place[v] < reach[g] for g in gone[u])
            if not made[w]:
                continue
            gone[w] = gone[v].copy()
            later = [c for c in copies[v] if c >= w]
            reach[w] = last[later[-1]] if later else place[v] + 1
            gone[u].append(w)
        self.place = array("i", place)
        self._rows(gone, np.array([place[right[w]] if w > 255 else 0 for w in range(n)]), np.array(reach))
        self._tree(made)

    def _rows(self, gone: list[list[int]], begin: np.ndarray, reach: np.ndarray) -> None:
        """Every state's intervals, sorted and united."""
        counts = np.array([len(g) for g in gone])
        state = np.repeat(np.arange(len(gone)), counts)
        gadget = np.fromiter((w for g in gone for w in g), np.int64, int(counts.sum()))
        base = np.int64(len(gone) + 1)
        lo, hi = state * base + begin[gadget], state * base + reach[gadget]
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        furthest = np.maximum.accumulate(hi) if len(hi) else hi
        fresh = np.concatenate([[True], lo[1:] > furthest[:-1]])[: len(lo)]
        first = np.flatnonzero(fresh)
        lo, hi = lo[first], np.maximum.reduceat(hi, first) if len(first) else hi
        self.row = array("i", np.searchsorted(lo // base, np.arange(len(gone) + 1)).astype(np.int32).tobytes())
        self.begin, self.end = (array("i", (x % base).astype(np.int32).tobytes()) for x in (lo, hi))

    def _tree(self, made: list[bool]) -> None:
        self.step: dict[int, int] = {}
        self.spells = array("i", [-1])
        for t, text in enumerate(self.text):
            node = 0
            if made[t]:
                for byte in text:
                    node = self.step.setdefault(node << 8 | byte, len(self.spells))
                    if node == len(self.spells):
                        self.spells.append(-1)
                self.spells[node] = t

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc b leaves the state a."""
        p, lo = self.place[b], self.row[a]
        k = bisect_right(self.begin, p, lo, self.row[a + 1])
        return k == lo or p >= self.end[k - 1]

    def labels(self, word: bytes, at: int) -> list[int]:
        """Labels that the word spells from a place on, the longest last."""
        out, node, step, spells = [], 0, self.step, self.spells
        for byte in word[at:]:
            node = step.get(node << 8 | byte)
            if node is None:
                break
            if spells[node] >= 0:
                out.append(spells[node])
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of the one path of the automaton that spells the word.

        Every prefix has one tokenisation, so a place is reached in one way only, and one from
        which the end was not reached is not entered again."""
        path: list[int] = []
        open_: list[list[int]] = []
        dead: set[int] = set()
        at, choice = 0, self.labels(word, 0)
        while at < len(word):
            while choice:
                t = choice.pop()
                end = at + len(self.text[t])
                if end not in dead and (not path or self.follows(path[-1], t)):
                    path.append(t)
                    open_.append(choice)
                    at, choice = end, self.labels(word, end)
                    break
            else:
                dead.add(at)
                choice = open_.pop()
                at -= len(self.text[path.pop()])
        return [self.id[t] for t in path]


class Encoder:
    """Texts to ids. Chunks between blanks repeat, so their ids are kept as bytes of int32."""

    #: Chunks kept per Python worker; beyond it the memory starts anew, which changes no result.
    KEPT = 400_000

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.words: dict[str, list[int]] = {}
        self.inner, self.first = _Kept(self, " "), _Kept(self, "")
        self.split = regex.compile(PATTERN).findall
        self.blank_run = regex.compile(r" (?!\S)").search
        self.at_blank = regex.compile(r"(?= \S)", regex.V1).split

    def chunk(self, text: str) -> bytes:
        out: list[int] = []
        for w in self.split(text):
            ids = self.words.get(w)
            if ids is None:
                if len(self.words) >= self.KEPT:
                    self.words.clear()
                ids = self.words[w] = self.automaton.encode(w.encode("utf-8"))
            out += ids
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as bytes of int32. No pre-split word goes on over a blank that a non-blank
        follows, so the text may be cut there."""
        if self.blank_run(text):
            return b"".join([self.first[c] for c in self.at_blank(text)])
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.inner.__getitem__, rest))


class _Kept(dict):
    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= Encoder.KEPT:
            self.clear()
        ids = self.encoder.chunk(self.before + chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids
