"""Texts cut into stretches that tokenizers encode on their own, and a worker's table of them.

A text is cut before every space that follows a character other than white space.  No token of
a byte-level BPE with the usual word pattern runs over such a place, nor does a piece of a
vocabulary whose space marks only begin pieces; so the tokens of a text are those of its
stretches, one after the other, however long the text is.  Each stretch but the first begins
with a space, which is left out of its name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np

from pitgrid.llm.tokencount import WHITE

#: White space before a space: there the text is not cut.
JOINED = re.compile(f"[{WHITE}] ")
BLANK = frozenset(WHITE)
#: A table starts anew beyond so many stretches, ids or code points.
REMEMBERED, MOST_IDS, MOST_CHARS = 1_000_000, 16_000_000, 32_000_000
#: Stretches that are encoded as one text.
AT_ONCE = 64


def cut(text: str) -> list[str]:
    """The stretches of a text, without the space that each but the first begins with."""
    parts = text.split(" ")
    if not JOINED.search(text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        last = out[-1]
        if (last == "" and len(out) > 1) or (last != "" and last[-1] in BLANK):
            out[-1] = f"{last} {p}"
        else:
            out.append(p)
    return out


class StretchTable:
    """Ids of stretches by one or more encoders, as one array per encoder.

    A name is a string, for the stretch of a space and it, or a tuple of one string, for a
    text's first stretch, which has no space before it.  The table is bounded: ``room`` empties
    it where it has grown too large, and must be called between two groups of texts.
    """

    def __init__(self, *encoders: Callable[[list[str]], list[bytes]]):
        self.encoders = encoders
        self.empty()

    def empty(self) -> None:
        self.at: dict = {}
        self.chars = 0
        self.ids = [np.zeros(1 << 16, np.int32) for _ in self.encoders]
        self.ends = [np.zeros(1 << 14, np.int64) for _ in self.encoders]

    def room(self) -> None:
        n = len(self.at)
        if n > REMEMBERED or self.chars > MOST_CHARS or max(int(e[n]) for e in self.ends) > MOST_IDS:
            self.empty()

    def learn(self, names: list) -> None:
        texts = [f" {x}" if isinstance(x, str) else x[0] for x in names]
        n, more = len(self.at), len(names)
        for side, encode in enumerate(self.encoders):
            found = encode(texts)
            sizes = np.fromiter(map(len, found), np.int64, more) // 4
            ends, ids = self.ends[side], self.ids[side]
            old = int(ends[n])
            total = old + int(sizes.sum())
            if n + more + 1 > len(ends):
                ends = self.ends[side] = np.concatenate((ends, np.zeros(max(len(ends), more + 1), np.int64)))
            if total > len(ids):
                ids = self.ids[side] = np.concatenate((ids, np.zeros(max(len(ids), total), np.int32)))
            ends[n + 1 : n + 1 + more] = old + np.cumsum(sizes)
            ids[old:total] = np.frombuffer(b"".join(found), np.int32)
        self.at.update(zip(names, range(n, n + more)))
        self.chars += sum(map(len, texts))

    def find(self, names: list) -> np.ndarray:
        """Rows of the table; what it doesn't hold yet is encoded, in one batch."""
        rows = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh = [names[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(fresh)))
            rows[missing] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        return rows

    def take(self, side: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after the other, and how many each row has."""
        ends = self.ends[side]
        first = ends[rows]
        n = ends[rows + 1] - first
        upto = np.cumsum(n)
        at = np.repeat(first - (upto - n), n)
        at += np.arange(len(at))
        return self.ids[side][at], n


def groups(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Texts in order, in groups of at most ``most`` code points, a longer text alone; with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, texts[first:]


class ByteBpe:
    """A byte-level BPE's ids of stretches, as bytes of 32-bit numbers.

    Stretches that begin with a space and end with something else than white space can follow
    each other in one text without sharing a token, so many are encoded at once; the bytes of
    the tokens tell where each ends.
    """

    def __init__(self, path: str, special: bool):
        """``special``: whether strings of special tokens are ordinary text."""
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special
        # a character of a byte-level entry is a byte
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        apart = [i for i, t in enumerate(texts) if t and (t[0] != " " or t[-1] in BLANK)]
        other = set(apart)
        joint = [i for i, t in enumerate(texts) if t and i not in other]
        lots = [joint[i : i + AT_ONCE] for i in range(0, len(joint), AT_ONCE)]
        for lot, ids in zip(lots, self.encode(["".join([texts[i] for i in lot]) for lot in lots])):
            stops = np.cumsum([len(texts[i].encode("utf-8", "surrogatepass")) for i in lot])
            ends = np.cumsum(self.size[ids])
            cuts = np.searchsorted(ends, stops)
            if len(ids) == 0 or ends[-1] != stops[-1] or (ends[cuts] != stops).any():
                apart += lot
                continue
            told, first = ids.tobytes(), 0
            for i, k in zip(lot, (4 * (cuts + 1)).tolist()):
                out[i] = told[first:k]
                first = k
        for i, ids in zip(apart, self.encode([texts[i] for i in apart])):
            out[i] = ids.tobytes()
        return out
