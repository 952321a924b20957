"""Tokenizer libraries over distinct pieces of text.

Texts are cut only where no token can cross (see SAFE and white_pieces); each distinct piece is given to the library
once per worker while it is remembered, and the ids of a text are put together from those of its pieces. What is
remembered has a bound (MOST entries); beyond it, the pieces seen least are forgotten.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import KEPT, lean, spread

MOST = 600_000
#: Printable characters other than the space are white space to no library. Between two of them, a single space starts
#: a new match of the pattern of byte-level BPE, whatever else the text holds, so the text may be cut before it.
_SOLID = "!-~¡-ᙿ"
SAFE = re.compile(f"(?<=[{_SOLID}]) (?=[{_SOLID}])")


def spaced_pieces(text: str) -> list[str]:
    """The text cut at safe spaces; all pieces but the first have lost the space they start with."""
    if text.replace("\n", "").isprintable() and "  " not in text and "\n " not in text and " \n" not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return SAFE.split(text)


class Ids(dict):
    """Piece -> number; the ids of a piece stand in `flat` from `starts` on. New pieces wait in `fresh`."""

    def __init__(self, encode, keep_ids: bool = True, most: int = MOST, batch_bytes: int = 1 << 16, code: str = "I"):
        super().__init__()
        self.encode, self.keep_ids, self.most, self.batch_bytes, self.code = encode, keep_ids, most, batch_bytes, code
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.fresh: list = []
        self.flat, self.lens, self.starts = array(self.code), array("q"), array("q")
        self.seen = np.zeros(0, dtype=np.int64)

    def thin_out(self) -> None:
        """Keeps the pieces that were looked up most, at most half as many as the bound."""
        least = max(2, int(np.partition(self.seen, -(self.most // 2))[-(self.most // 2)]) + 1)
        keep = np.flatnonzero(self.seen >= least)
        names = np.fromiter(self, dtype=object, count=len(self))[keep].tolist()
        lens, flat, seen = np.array(self.lens, dtype=np.int64), np.array(self.flat, dtype=self.code), self.seen[keep] // 2
        self.drop()
        self.update(zip(names, range(len(names)), strict=True))
        own = lens[keep]
        self.lens, self.seen = array("q", own.tobytes()), seen
        if self.keep_ids:
            self.flat = array(self.code, flat[spread((np.cumsum(lens) - lens)[keep], own)].tobytes())
            self.starts = array("q", (np.cumsum(own) - own).tobytes())

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n

    def learn(self) -> None:
        """Encodes the waiting pieces, in batches of about batch_bytes."""
        i = 0
        while i < len(self.fresh):
            j, size = i, 0
            while j < len(self.fresh) and (j == i or size + len(self.fresh[j]) <= self.batch_bytes):
                size += len(self.fresh[j])
                j += 1
            for ids in self.encode(self.fresh[i:j]):
                self.lens.append(len(ids))
                if self.keep_ids:
                    self.starts.append(len(self.flat))
                    self.flat.extend(ids)
            i = j
        self.fresh = []

    def look_up(self, pieces: list) -> np.ndarray:
        if len(self) > self.most:
            self.thin_out()
        at = np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if self.fresh:
            self.learn()
        self.seen = np.pad(self.seen, (0, len(self) - len(self.seen))) + np.bincount(at, minlength=len(self))
        return at

    def counts(self, pieces: list) -> np.ndarray:
        at = self.look_up(pieces)
        return np.asarray(self.lens)[at] if len(at) else np.zeros(0, dtype=np.int64)

    def ids(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each piece has."""
        at = self.look_up(pieces)
        if not len(at):
            return np.zeros(0, dtype=self.code), np.zeros(0, dtype=np.int64)
        # views, gone before anything is added: nothing the size of the memo is copied for a slice
        lens = np.asarray(self.lens)[at]
        return np.asarray(self.flat)[spread(np.asarray(self.starts)[at], lens)], lens


def kept(name: str, make) -> Ids:
    """What make() gives, one for all tasks of a worker process that ask by the same name; another name takes its place."""
    lean(but=name)
    if name not in KEPT:
        KEPT[name] = make()
    return KEPT[name]


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups with the given lengths, which may be 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]
