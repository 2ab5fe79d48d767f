"""Language identification in two steps: the family, then the language within it.

A text is a bag of hashed byte n-grams of its letters.  One linear support vector machine per
family, one against the rest, picks the family; within it one per pair of languages, one
against the other, votes for the language; the sum of margins breaks ties, and then the later
name.  The machines learn from a sample of bounded size of the labelled rows; whole texts, and
single sentences of them so that short texts are known too.  Prediction reads each whole text
once, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families of languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tt".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "indic": "hi ur bn pa mr gu ne si".split(),
    "semitic": "ar he am mt".split(),
}
BITS = 13
ORDERS = (1, 2, 3, 4)
#: Bounds of the sample: rows per language, sentences taken from each.
SAMPLE_ROWS, SENTENCES = 250, 3
LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed n-gram counts, or None where there is no letter."""
    line = LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, line)):  # other numerals than digits are left in
        return None
    b = np.frombuffer(f" {line} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for n in ORDERS:
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        spread = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        out += np.bincount(spread, minlength=1 << BITS).astype(np.float32) / np.float32(len(code) or 1)
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    share = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) / 2
    diag = 1 / (2 * cost * share)
    square = (x * x).sum(axis=1) + diag
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    """``families`` and, for each, its languages; a matrix of machines for every choice of more than one.

    ``top`` has a machine per family, ``within`` one per pair of a family's languages, in the order of ``combinations``.
    """

    families: list[str]
    members: dict[str, list[str]]
    top: np.ndarray | None
    within: dict[str, np.ndarray]

    @staticmethod
    def choose(machines: np.ndarray | None, x: np.ndarray) -> tuple[int, float]:
        if machines is None:
            return 0, 1.0
        margin = machines[:, :-1] @ x + machines[:, -1]
        share = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        best = int(np.argmax(margin))
        return best, float(share[best] / share.sum())

    @staticmethod
    def vote(machines: np.ndarray | None, x: np.ndarray, k: int) -> tuple[int, float]:
        if machines is None:
            return 0, 1.0
        first, second = np.triu_indices(k, 1)
        margin = machines[:, :-1] @ x + machines[:, -1]
        votes = np.bincount(np.where(margin > 0, first, second), minlength=k)
        sums = np.bincount(first, margin, k) - np.bincount(second, margin, k)
        best = int(np.lexsort((sums, votes))[-1])
        share = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        won = np.bincount(first, share, k) + np.bincount(second, 1 - share, k)
        return best, float(won[best] / len(margin))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text is not None else None
        if x is None or not self.families:
            return UNKNOWN, 0.0
        f, p = self.choose(self.top, x)
        name = self.families[f]
        lang, q = self.vote(self.within.get(name), x, len(self.members[name]))
        return self.members[name][lang], p * q


def learn(rows: list[tuple[str, np.ndarray]]) -> Model:
    """A model of (language, features) rows."""
    langs = np.array([lang for lang, _ in rows], object)
    x = np.stack([f for _, f in rows]) if rows else np.empty((0, 1 << BITS), np.float32)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    of = np.array([family(lang) for lang in langs], object)
    against = lambda own, x, labels: np.stack([svm(x, np.where(labels == k, 1.0, -1.0)) for k in own])
    top = against(families, x, of) if len(families) > 1 else None
    within = {}
    for f, m in members.items():
        if len(m) > 1:
            pairs = [(a, b, (langs == a) | (langs == b)) for a, b in combinations(m, 2)]
            within[f] = np.stack([svm(x[own], np.where(langs[own] == a, 1.0, -1.0)) for a, b, own in pairs])
    return Model(families, members, top, within)


def pieces(text: str, key: int) -> list[str]:
    """The text and up to ``SENTENCES`` of its sentences, picked by the hash of their place."""
    parts = [p for p in re.split(r"[.!?|\n]+", text) if len(p.split()) > 1]
    parts.sort(key=lambda p: zlib.crc32(p.encode("utf-8", "surrogatepass"), key & 0xFFFFFFFF))
    return [text, *parts[:SENTENCES]]


def sample(docs: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, np.ndarray]]:
    """Features of about ``SAMPLE_ROWS`` rows for each language, at most twice as many in all, those of the least hash."""
    sizes = {r[lang]: r["count"] for r in docs.groupBy(lang).count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(SAMPLE_ROWS / n))])
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    few = docs.where(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.crc32(F.col(key).cast("string")).alias("place"), place.alias("_p"))
    few = few.orderBy("_p", "text").limit(2 * SAMPLE_ROWS * len(sizes)).drop("_p").repartition(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang_, text_, place_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = [f for f in map(features, pieces(text_, place_ or 0)) if f is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * len(made), pa.string()), pa.array([f.astype(np.float16).tobytes() for f in made], pa.binary())], names=["lang", "f"]
                )

    got = few.mapInArrow(run, "lang string, f binary").collect()
    return sorted(((r.lang, np.frombuffer(r.f, np.float16).astype(np.float32)) for r in got), key=lambda r: (r[0], r[1].tobytes()))


def held_out(key: str, folds: int = 5):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Learns from the rows that aren't held out (crc32 of the key modulo ``folds`` is not 0) and
    whose text and language aren't null.  A null text, or one without a letter, is "und" with
    score 0, and so is every text where there is nothing to learn from.  A null key isn't held
    out.  Repeated rows give repeated rows; other columns aren't read.
    """
    out = held_out(key, folds)
    model = learn(sample(docs.where(~out & F.col(text).isNotNull() & F.col(lang).isNotNull()), key, text, lang))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights per language
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col(key), out.alias("held_out"), F.col(text)).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
