"""SentencePiece encoding and decoding, and sampled segmentations.

No piece has the space mark inside, so a text falls into units of "space marks, then the rest
up to the next space mark" that are encoded on their own; each Python worker remembers short
units, in a table of bounded size.

Sampling draws k distinct segmentations of a whole text without replacement, from the
distribution in which a segmentation's log probability is ``alpha`` times the sum of its
piece scores (of a byte-pair model these are merge ranks below zero, which then only stand
for log probabilities).  It is a best-first (A-star) search over sets of segmentations: a set's key is
the largest Gumbel-perturbed log probability in it.  The set with the largest key is taken,
the segmentation that attains it is drawn, which is a draw from the set by backward sums over
the lattice, and what is left of the set is split by the first unit where a segmentation
differs from the drawn one; the parts' keys are Gumbel variables cut off at the set's key.
The order in which segmentations are drawn is then Gumbel top-k.

The texts of a group are searched together, one set of each at a time: all units that leave
their likeliest segmentation are then drawn at once, in arrays over units of one length.
Every random number is a hash of the row's key, the turn and the unit, so neither grouping
nor repetition changes what is drawn.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.shingling import mix

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Units in a worker's table before it starts anew, and the longest that is remembered.
REMEMBERED, SHORT = 550_000, 48
#: Units up to this length are weighed in arrays, of so many cells at once; longer ones one by one.
ARRAYED, CELLS = 64, 2_000_000
#: Code points of texts that are worked on together.
GROUP = 1_500_000
ALPHA, SAMPLES, SEED = 0.002, 3, 7
BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def uniforms(seeds, turn: int, unit, step) -> np.ndarray:
    """Numbers in (0, 1) for each row's seed, turn, unit and step."""
    with np.errstate(over="ignore"):
        own = mix(np.asarray(seeds, np.uint64) + np.uint64(turn + 1) * np.uint64(0xA0761D6478BD642F))
        at = np.asarray(unit).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.asarray(step).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
        return ((mix(own + at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattice:
    """Arcs and backward log masses of one unit.  A segmentation is the tuple of its pieces' ends."""

    __slots__ = ("arcs", "best", "mass", "top", "way")

    def __init__(self, unit: str, codec: Codec):
        n, pieces, beginnings = len(unit), codec.pieces, codec.beginnings
        self.arcs: list[list[tuple[int, tuple[int, ...], float]]] = []
        for p in range(n):
            found = []
            for e in range(p + 1, n + 1):
                part = unit[p:e]
                piece = pieces.get(part)
                if piece is not None:
                    found.append((e, piece[0], piece[1]))
                elif e == p + 1:
                    found.append((e, tuple(codec.bytes[b] for b in part.encode("utf-8", "surrogatepass")), codec.fallback))
                if part not in beginnings:
                    break
            self.arcs.append(found)
        mass, best, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * n
        exp, log = math.exp, math.log
        for p in range(n - 1, -1, -1):
            arcs = self.arcs[p]
            if len(arcs) == 1:
                e, _, s = arcs[0]
                mass[p], best[p], way[p] = s + mass[e], s + best[e], e
                continue
            logs = [s + mass[e] for e, _, s in arcs]
            top = max(logs)
            mass[p] = top + log(sum([exp(x - top) for x in logs]))
            best[p], way[p] = max([(s + best[e], e) for e, _, s in arcs])
        self.mass, self.best, self.way = mass, best[0], way
        self.top = self.best_path()

    def best_path(self) -> tuple[int, ...]:
        path, p = [], 0
        while p < len(self.way):
            p = self.way[p]
            path.append(p)
        return tuple(path)

    def told(self, path: tuple[int, ...]) -> bytes:
        """The pieces of a segmentation."""
        ids, p = [], 0
        for end in path:
            ids += next(a for a in self.arcs[p] if a[0] == end)[1]
            p = end
        return np.array(ids, np.int32).tobytes()

    def path(self, ids: bytes) -> tuple[int, ...]:
        """The segmentation that has these pieces."""
        left, path, p = tuple(np.frombuffer(ids, np.int32).tolist()), [], 0
        while p < len(self.way):
            p, piece, _ = next(a for a in self.arcs[p] if left[: len(a[1])] == a[1])
            left = left[len(piece) :]
            path.append(p)
        return tuple(path)

    def draw(self, without: list[tuple[tuple[int, ...], float]], rand) -> tuple[tuple[int, ...], float]:
        """A segmentation by its probability and its log probability; none of ``without``, which come with theirs."""
        p, path, total = 0, [], 0.0
        all_arcs, mass, n = self.arcs, self.mass, len(self.way)
        live = [(x, lp + mass[0]) for x, lp in without]  # and what is left of their log weight
        while p < n:
            arcs, here = all_arcs[p], mass[p]
            if len(arcs) == 1 and not live:
                e, _, s = arcs[0]
                path.append(e)
                total += s
                p = e
                continue
            weights = [math.exp(s + mass[e] - here) for e, _, s in arcs]
            if live:
                depth, ends = len(path), [a[0] for a in arcs]
                for x, rest in live:
                    at = ends.index(x[depth])
                    weights[at] = max(0.0, weights[at] - math.exp(rest - here))
            u, at = rand(p) * sum(weights), 0
            while at < len(arcs) - 1 and u >= weights[at]:
                u -= weights[at]
                at += 1
            while weights[at] <= 0.0 and at > 0:
                at -= 1
            end, _, s = arcs[at]
            if live:
                live = [(x, rest - s) for x, rest in live if x[depth] == end]
            path.append(end)
            total += s
            p = end
        return tuple(path), min(0.0, total - mass[0])


class PieceTable:
    """Pieces and their beginnings by the hash of their characters, with open addressing.

    A piece's weight is exp(score + drift * length): the drift is the same for all segmentations
    of a unit, and keeps sums of weights within the range of doubles.
    """

    BITS = 19

    def __init__(self, pieces: dict[str, tuple[tuple[int, ...], float]], beginnings: set[str], drift: float):
        texts = [*pieces, *sorted(beginnings - pieces.keys())]
        self.longest, self.drift = max(map(len, pieces)), drift
        self.up = np.multiply.accumulate(np.full(self.longest + 1, BASE, np.uint64))
        hashes = np.zeros(len(texts), np.uint64)
        for n in {len(p) for p in texts}:
            own = [i for i, p in enumerate(texts) if len(p) == n]
            hashes[own] = (self.codes([texts[i] for i in own], n) * self.up[:n]).sum(axis=1, dtype=np.uint64)
        self.ids = np.array([x[0] for x, _ in pieces.values()], np.int32)
        self.scores = np.array([s for _, s in pieces.values()])
        sizes = np.array([len(p) for p in pieces])
        self.weights = np.append(np.exp(self.scores + drift * sizes), 0.0)  # the last for no piece
        self.lengths = dict(zip(self.ids.tolist(), sizes.tolist()))
        self.piece = np.array([i if i < len(pieces) else -1 for i in range(len(texts))], np.int32)
        self.goes_on = np.array([p in beginnings for p in texts])
        self.keys, self.rows = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        slots = self.slot(hashes).tolist()
        for row, (h, at) in enumerate(zip(hashes.tolist(), slots)):
            while self.rows[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.rows[at] = h, row

    @staticmethod
    def codes(texts: list[str], n: int) -> np.ndarray:
        """A mixed number for each character of texts of length ``n``."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return mix(flat.astype(np.uint64) + np.uint64(1)).reshape(len(texts), n)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among pieces and beginnings, or -1."""
        at = self.slot(hashes)
        rows = self.rows[at]
        same = self.keys[at] == hashes
        out = np.where(same, rows, -1)
        left = np.flatnonzero((rows >= 0) & ~same)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
            rows = self.rows[at[left]]
            same = (self.keys[at[left]] == hashes[left]) & (rows >= 0)
            out[left[same]] = rows[same]
            left = left[(rows >= 0) & ~same]
        return out


class Lattices:
    """Arcs and backward sums of weights of many units of one length, each of whose characters is a piece."""

    def __init__(self, units: list[str], table: PieceTable):
        count, n = len(units), len(units[0])
        width = min(n, table.longest)
        codes = table.codes(units, n).ravel()
        self.length, self.width, self.table = n, width, table
        # for each place the pieces that begin there, by length
        rows = np.full((count * n, width), -1, np.int32)
        at, hashes = np.arange(count * n), codes * table.up[0]
        for w in range(width):
            found = table.find(hashes)
            rows[at, w] = np.where(found >= 0, table.piece[found], -1)
            on = np.flatnonzero((found >= 0) & table.goes_on[found] & (at % n + w + 1 < n))
            at = at[on]
            if len(at) == 0:
                self.width = width = w + 1
                rows = rows[:, :width]
                break
            if w + 1 < width:
                hashes = hashes[on] + codes[at + w + 1] * table.up[w + 1]
        self.rows = rows.reshape(count, n, width)
        self.weights = table.weights[self.rows]
        self.mass, self.best = np.zeros((count, n + width)), np.zeros((count, n + width))
        self.mass[:, n] = self.best[:, n] = 1.0
        self.way = np.zeros((count, n), np.int64)
        every = np.arange(count)
        for p in range(n - 1, -1, -1):
            w = min(width, n - p)
            own = self.weights[:, p, :w]
            self.mass[:, p] = np.einsum("nw,nw->n", own, self.mass[:, p + 1 : p + 1 + w])
            here = own * self.best[:, p + 1 : p + 1 + w]
            self.way[:, p] = here.argmax(axis=1)
            self.best[:, p] = here[every, self.way[:, p]]

    def sound(self) -> np.ndarray:
        """Units whose sums stay within the range of doubles."""
        return (self.best[:, : self.length].min(axis=1) > 1e-280) & (self.mass[:, : self.length].max(axis=1) < 1e280)

    def stays(self) -> np.ndarray:
        """The log probability of each unit's likeliest segmentation."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.minimum(0.0, np.log(self.best[:, 0] / self.mass[:, 0]))

    def told(self, taken: np.ndarray) -> list[bytes]:
        """The pieces of each row's steps; -1 where there is none."""
        some = taken >= 0
        flat = self.table.ids[taken[some]].tobytes()
        ends = (np.cumsum(some.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def tops(self) -> list[bytes]:
        """The pieces of each unit's likeliest segmentation."""
        at, every = np.zeros(len(self.way), np.int64), np.arange(len(self.way))
        taken = []
        while len(every):
            w = self.way[every, at[every]]
            step = np.full(len(self.way), -1, np.int32)
            step[every] = self.rows[every, at[every], w]
            taken.append(step)
            at[every] += w + 1
            every = every[at[every] < self.length]
        return self.told(np.stack(taken, axis=1))

    def draw(self, unit: np.ndarray, barred: dict[int, tuple[bytes, float]], rand) -> tuple[list[bytes], np.ndarray]:
        """A segmentation of each of the units numbered ``unit`` other than the likeliest or the one ``barred`` has.

        ``rand`` gives numbers for rows and positions.  Returns the pieces and the log probabilities.
        """
        count, n = len(unit), self.length
        rest = self.best[unit, 0].copy()
        way = self.way[unit] if barred else None
        for i, (ids, lp) in barred.items():
            p, rest[i] = 0, math.exp(lp) * self.mass[unit[i], 0]
            for piece in np.frombuffer(ids, np.int32).tolist():
                way[i, p] = self.table.lengths[piece] - 1
                p += way[i, p] + 1
        at, total, live = np.zeros(count, np.int64), np.zeros(count), np.ones(count, bool)
        every, taken = np.arange(count), []
        reach = np.arange(1, self.width + 1)
        while len(every):
            p, u = at[every], unit[every]
            own = self.weights[u, p]
            weights = own * self.mass[u[:, None], p[:, None] + reach]
            on = np.flatnonzero(live[every])
            step = way[every[on], p[on]] if way is not None else self.way[u[on], p[on]]
            weights[on, step] = np.maximum(0.0, weights[on, step] - rest[every[on]])
            sums = np.cumsum(weights, axis=1)
            over = sums > (rand(every, p) * sums[:, -1])[:, None]
            pick = np.where(over[:, -1], over.argmax(axis=1), weights.argmax(axis=1))
            row = np.full(count, -1, np.int32)
            row[every] = picked = self.rows[u, p, pick]
            rest[every[on]] /= own[on, pick[on]]
            live[every[on]] = pick[on] == step
            total[every] += self.table.scores[picked]
            taken.append(row)
            at[every] += pick + 1
            every = every[at[every] < n]
        logs = total + self.table.drift * n - np.log(self.mass[unit, 0])
        return self.told(np.stack(taken, axis=1)), np.minimum(0.0, logs)


def log_less(a: float, b: float) -> float:
    """log(exp(a) - exp(b)), minus infinity where nothing is left."""
    return a + math.log1p(-math.exp(b - a)) if b < a - 1e-12 else -math.inf


def rest_of(logs: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)), minus infinity where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.where(logs < -1e-12, np.log(-np.expm1(np.minimum(logs, 0.0))), -np.inf)


class Search:
    """The sets of one text's segmentations that are still open, and those drawn so far."""

    __slots__ = ("drawn", "queue", "seed", "tick", "units")

    def __init__(self, units: np.ndarray, seed: int):
        self.units, self.seed, self.tick = units, seed, 0
        # a set: its key, the unit from which it is open, what that unit may not be, the log probability of the
        # units before, and those of them that leave their best, with the log probabilities and pieces of their choice
        none = (np.empty(0, np.int64), np.empty(0), [])
        self.queue: list = [(math.log(-math.log(float(uniforms(seed, 0, 0, 2)))), 0, (0, [], 0.0, none))]
        self.drawn: list[tuple[tuple, float, float]] = []

    def split(self, start: int, barred: list, chosen: tuple, likely, lp: np.ndarray, ahead: np.ndarray, keys: np.ndarray, more: int) -> None:
        """Opens the parts of what is left of a set, by the first unit that differs from ``chosen``, that may be among the next ``more``."""
        at, logs, ids = chosen
        for c in np.argpartition(-keys, more)[:more].tolist() if len(keys) > more else range(len(keys)):
            if keys[c] == -math.inf:
                continue
            i = start + c
            m = int(np.searchsorted(at, i))
            own = (ids[m], float(logs[m])) if m < len(at) and at[m] == i else likely(self.units[i])
            self.tick += 1
            heapq.heappush(self.queue, (-float(keys[c]), self.tick, (i, [*(barred if c == 0 else []), own], float(ahead[c] - lp[c]), (at[:m], logs[:m], ids[:m]))))


class Codec:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[tuple[int, ...], float]] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.pieces[piece] = ((i,), alpha * max(self.model.get_score(i), -1e5))
                self.raw.append(piece.replace(MARK, " ").encode())
        #: What a longer piece goes on from.
        self.beginnings = {piece[:n] for piece in self.pieces for n in range(1, len(piece))}
        self.fallback = -alpha * self.model.get_piece_size()
        ascii_ = {chr(b): ((self.bytes[b],), self.fallback) for b in range(128) if chr(b) not in self.pieces and b in self.bytes}
        self.table = PieceTable(ascii_ | self.pieces, self.beginnings, alpha * self.model.get_piece_size() / 10)
        single = "".join(re.escape(p) for p in ascii_ | self.pieces if len(p) == 1)
        self.arrayed = re.compile(f"[{single}]{{1,{ARRAYED}}}")
        self.forget()

    def forget(self) -> None:
        """Starts the table of units anew.  Of each: its pieces by the library, the likeliest ones, and what they and all others weigh."""
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and where their units are
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.tops: list[bytes] = []
        self.stay, self.leave, self.sizes = np.empty(1024), np.empty(1024), np.empty(1024, np.int64)

    def units(self, text: str) -> list[str]:
        return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def by_length(self, at: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Parts of ``at`` of one size each, as large as the arrays over them may be."""
        order = np.argsort(sizes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            n = max(1, int(sizes[own[0]])) if len(own) else 1
            step = max(1, CELLS // (n * min(n, self.table.longest)))
            for a in range(0, len(own), step):
                yield at[own[a : a + step]]

    def learn(self, units: list[str]) -> None:
        """Adds new units to the table."""
        told = self.model.encode([u[1:].replace(MARK, " ") for u in units], num_threads=1)
        first, count = len(self.names), len(self.names) + len(units)
        sizes = [len(x) for x in told]
        flat = np.fromiter(chain.from_iterable(told), np.int32, sum(sizes)).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        self.names += units
        self.ids += [flat[a:b] for a, b in zip([0, *ends], ends)]
        if MARK in units:  # the library drops a space that ends a text
            self.ids[first + units.index(MARK)] = np.array(self.pieces[MARK][0], np.int32).tobytes()
        self.tops += [b""] * len(units)
        if count > len(self.stay):
            self.stay, self.leave, self.sizes = (np.resize(x, 2 * count) for x in (self.stay, self.leave, self.sizes))
        fits = self.arrayed.fullmatch
        self.sizes[first:count] = [len(u) if fits(u) else 0 for u in units]
        for own in self.by_length(np.arange(first, count), self.sizes[first:count]):
            names = [self.names[i] for i in own.tolist()]
            one_by_one = own.tolist()
            if self.sizes[own[0]]:
                found = Lattices(names, self.table)
                self.stay[own] = found.stays()
                for i, top in zip(one_by_one, found.tops(), strict=True):
                    self.tops[i] = top if top != self.ids[i] else self.ids[i]
                one_by_one = own[~found.sound()].tolist()
            for i in one_by_one:
                found = Lattice(self.names[i], self)
                self.sizes[i], self.stay[i], self.tops[i] = 0, min(0.0, found.best - found.mass[0]), found.told(found.top)
        self.leave[first:count] = rest_of(self.stay[first:count])

    def read_all(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's units in the table; they hold until the next call."""
        if len(self.known) > REMEMBERED or len(self.names) > 2 * REMEMBERED:
            self.forget()
        lines = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        flat = "".join(lines)
        if not flat:
            return [np.empty(0, np.int64)] * len(texts)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.cumsum([0, *map(len, lines)])
        mark = codes == ord(MARK)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[firsts[:-1][np.diff(firsts) > 0]] = True
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(codes))
        # units by hash: the sum of mixed characters times powers by their place within the unit
        place = np.arange(len(codes)) - np.repeat(at, ends - at)
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, BASE, np.uint64))
        hashes, one, which = np.unique(np.add.reduceat(mix(codes.astype(np.uint64) + np.uint64(1)) * power[place], at), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        found = np.full(len(hashes), -1, np.int64)
        hit = np.flatnonzero(place < len(self.known))
        hit = hit[self.known[place[hit]] == hashes[hit]]
        found[hit] = self.number[place[hit]]
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            number, names = len(self.names), [flat[a:b] for a, b in zip(at[one[fresh]].tolist(), ends[one[fresh]].tolist())]
            self.learn(names)
            found[fresh] = np.arange(number, len(self.names))
            short = fresh[ends[one[fresh]] - at[one[fresh]] <= SHORT]
            self.known, self.number = np.insert(self.known, place[short], hashes[short]), np.insert(self.number, place[short], found[short])
        return np.split(found[which], np.searchsorted(at, firsts[1:-1]))

    def read(self, text: str) -> tuple[list[str], np.ndarray]:
        """The units of a text and their numbers."""
        return self.units(text), self.read_all([text])[0]

    def encode(self, text: str) -> bytes:
        return self.joined(self.read(text)[1])

    def joined(self, units: np.ndarray) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in units.tolist()])

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        line = b"".join([raw[i] for i in np.frombuffer(ids, np.int32).tolist()]).decode("utf-8", "replace")
        return line[1:] if line.startswith(" ") else line

    def draw(self, turn: int, unit: np.ndarray, seeds: np.ndarray, at: np.ndarray, barred: dict[int, list[tuple[bytes, float]]]) -> tuple[list[bytes], np.ndarray]:
        """A segmentation of each unit that is none of its barred ones, or not the likeliest where none are given."""
        ids: list[bytes] = [b""] * len(unit)
        logs = np.zeros(len(unit))
        one_by_one = np.fromiter((i for i, x in barred.items() if len(x) > 1), np.int64)
        sizes = self.sizes[unit]
        sizes[one_by_one] = 0
        for own in self.by_length(np.arange(len(unit)), sizes):
            if len(own) and sizes[own[0]]:
                names, row = np.unique(unit[own], return_inverse=True)
                lattices = Lattices([self.names[i] for i in names.tolist()], self.table)
                own_barred = {j: barred[i][0] for j, i in enumerate(own.tolist()) if i in barred} if barred else {}
                drawn, logs[own] = lattices.draw(row, own_barred, lambda rows, p: uniforms(seeds[own[rows]], turn, at[own[rows]], p + 3))
                for i, x in zip(own.tolist(), drawn, strict=True):
                    ids[i] = x
                continue
            for i in own.tolist():
                lattice = Lattice(self.names[unit[i]], self)
                without = [(lattice.path(x), lp) for x, lp in barred.get(i) or [(self.tops[unit[i]], float(self.stay[unit[i]]))]]
                path, logs[i] = lattice.draw(without, lambda p: float(uniforms(seeds[i], turn, at[i], p + 3)))
                ids[i] = lattice.told(path)
        return ids, logs

    def sample_all(self, texts: list[np.ndarray], k: int, seeds: list[int]) -> list[list[tuple[bytes, float, float, float]]]:
        """For each text up to k of (ids, log probability, perturbed log probability, inclusion probability)."""
        searches = [Search(units, seed) for units, seed in zip(texts, seeds, strict=True)]
        likely = lambda unit: (self.tops[unit], float(self.stay[unit]))
        for turn in range(k):
            taken = [(s, heapq.heappop(s.queue)) for s in searches if s.queue]
            if not taken:
                break
            # the open units of all sets, one after the other
            starts = np.array([x[2][0] for _, x in taken])
            units = np.concatenate([s.units[a:] for (s, _), a in zip(taken, starts.tolist())])
            counts = np.array([len(s.units) for s, _ in taken]) - starts
            ends = np.cumsum(counts)
            heads = ends - counts
            at = np.arange(len(units)) - np.repeat(heads - starts, counts)
            own = np.repeat(np.array([s.seed for s, _ in taken], np.uint64), counts)
            lp, other = self.stay[units], self.leave[units]
            gone = uniforms(own, turn, at, 0) < np.exp(other)
            barred = {int(head): x[2][1] for (_, x), head in zip(taken, heads) if x[2][1]}
            gone[list(barred)] = True  # the unit at the start must differ from those
            where = np.flatnonzero(gone)
            ids, logs = self.draw(turn, units[where], own[where], at[where], {int(np.searchsorted(where, head)): no for head, no in barred.items()})
            back = [j for j in np.searchsorted(where, list(barred)).tolist() if ids[j] == self.tops[units[where[j]]]]
            lp[where], other[where] = logs, rest_of(logs)
            for head, no in barred.items():
                other[head] = log_less(0.0, min(0.0, math.log(math.exp(lp[head]) + sum(math.exp(p) for _, p in no))))
            if back:  # the likeliest after all
                lp[where[back]] = self.stay[units[where[back]]]
                same = set(back)
                ids = [x for j, x in enumerate(ids) if j not in same]
                where, logs = np.delete(where, back), np.delete(logs, back)
            ahead = np.empty(len(units))
            for (_, x), a, b in zip(taken, heads.tolist(), ends.tolist()):
                np.cumsum(lp[a:b], out=ahead[a:b])
                ahead[a:b] += x[2][2]
            mass = ahead - lp + other
            with np.errstate(divide="ignore", over="ignore"):
                keys = -np.log(np.repeat(np.exp([x[0] for _, x in taken]), counts) - np.log(uniforms(own, turn, at, 1)) * np.exp(-mass))
            keys[mass < -600] = -math.inf
            cuts = np.searchsorted(where, [0, *ends.tolist()]).tolist()
            place = at[where]
            for j, ((s, (key, _, (start, no, base, before))), a, b) in enumerate(zip(taken, heads.tolist(), ends.tolist())):
                c, d = cuts[j], cuts[j + 1]
                chosen = (np.concatenate((before[0], place[c:d])), np.concatenate((before[1], logs[c:d])), before[2] + ids[c:d])
                s.drawn.append((chosen, float(ahead[b - 1]) if b > a else base, -key))
                s.split(start, no, chosen, likely, lp[a:b], ahead[a:b], keys[a:b], k - turn)
        return [self.listed(s, k) for s in searches]

    def listed(self, s: Search, k: int) -> list[tuple[bytes, float, float, float]]:
        limit = -s.queue[0][0] if s.queue and len(s.drawn) == k else -math.inf
        tops, made = self.tops, []
        base = [tops[i] for i in s.units.tolist()]
        for (at, _, ids), total, key in s.drawn:
            own = list(base)
            for i, x in zip(at.tolist(), ids, strict=True):
                own[i] = x
            made.append((b"".join(own), total, key, -math.expm1(-math.exp(min(50.0, total - limit))) if limit > -math.inf else 1.0))
        return made

    def sample(self, units: list[str], told: np.ndarray, k: int, seed: int) -> list[tuple[bytes, float, float, float]]:
        """``sample_all`` of one text."""
        return self.sample_all([told], k, [seed])[0]


_known: dict[tuple[str, float], Codec] = {}


def codec(path: str, alpha: float) -> Codec:
    if (path, alpha) not in _known:
        _known[path, alpha] = Codec(path, alpha)
    return _known[path, alpha]


def row_rng(key, seed: int) -> int:
    """The seed of a row's random numbers."""
    return int(mix(np.array([zlib.crc32(f"{key}:{seed}".encode()) + (seed << 32)], np.uint64))[0])


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in order, in groups of bounded length (a longer text is a group of its own), each with its first place."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 64
        if i > first and size + n > GROUP:
            yield first, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


IDS = pa.list_(pa.int32())
DRAWN = {"n_tokens": pa.int64(), "ids_crc": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64()}


def as_ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids, the library's pieces of each whole text; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path(), ALPHA)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [as_ids(c.joined(units)) for _, group in grouped(texts) for units in c.read_all(group)]
            ids = [None if t is None else x for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, IDS)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and text of rows of ids; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path(), ALPHA)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int32).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return coded.select(key, ids).mapInArrow(run, f"`{key}` {coded.schema[key].dataType.simpleString()}, text string")


def sample(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, rank, ids, log_prob, perturbed, inclusion: up to k distinct segmentations of each text, by falling key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path(), alpha)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, rows, names = [], [], keys.to_pylist()
            for first, group in grouped(texts):
                seeds = [row_rng(names[first + i], seed) for i in range(len(group))]
                for i, drawn in enumerate(c.sample_all(c.read_all(group), k, seeds), first):
                    at += [i] * len(drawn)
                    rows += [(r + 1, as_ids(ids), *rest) for r, (ids, *rest) in enumerate(drawn)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int32(), IDS, pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *[pa.array(list(x), t) for x, t in zip(cols, kinds, strict=True)]],
                names=[key, "rank", "ids", "log_prob", "perturbed", "inclusion"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, rank int, ids array<int>, log_prob double, perturbed double, inclusion double")


def digest(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: what ``encode``, ``decode`` and ``sample`` give, as counts and checksums.

    n_tokens, ids_crc (crc32 of the ids as 32-bit numbers), round_trip (decoding gives the
    text), and samples with the same of each drawn segmentation.  A null text counts as
    empty: no tokens and one empty segmentation.  Repeated rows give repeated rows and the
    same draws; other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()
    kinds = pa.list_(pa.struct([pa.field(n, t) for n, t in DRAWN.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path(), alpha)
        for batch in batches:
            n, crc, back, samples = [], [], [], []
            names = batch.column(0).to_pylist()
            for first, group in grouped(batch.column(1).to_pylist()):
                read = c.read_all(group)
                for t, units in zip(group, read, strict=True):
                    ids = c.joined(units)
                    n.append(len(ids) // 4), crc.append(zlib.crc32(ids)), back.append(c.decode(ids) == t)
                for drawn in c.sample_all(read, k, [row_rng(names[first + i], seed) for i in range(len(group))]):
                    samples.append([{"n_tokens": len(s) // 4, "ids_crc": zlib.crc32(s), "log_prob": lp, "perturbed": g, "inclusion": pi} for s, lp, g, pi in drawn])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_()), pa.array(samples, kinds)],
                names=[key, "n_tokens", "ids_crc", "round_trip", "samples"],
            )

    out = "n_tokens long, ids_crc long, round_trip boolean, samples array<struct<n_tokens:long,ids_crc:long,log_prob:double,perturbed:double,inclusion:double>>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {out}")
