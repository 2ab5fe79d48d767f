"""Token counts without the tokens.

An Arrow function gets batches of texts and returns lengths only.  Texts are split at
safe boundaries: a byte-level BPE with the usual word pattern joins neither a character
that isn't white space to white space after it, nor a letter to a character after it that
is none, so the text falls into units whose counts add up to the count of the text, however
long it is.  The texts of a batch are cut together, and what they have of units not met before
is encoded in batches of about equal bytes that run across texts; the counts of short units
are remembered by each Python worker, in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: White space, then: a whole run of letters; or other characters up to white space; or all up to white space.
UNITS = re.compile(
    f"[{WHITE}]*(?:[{LATIN}]+(?![^\\W\\d_])|[^{WHITE}{LATIN}]+(?=[{WHITE}]|$)|[^{WHITE}]+)|[{WHITE}]+"
)

BATCH_BYTES = 1 << 20
REMEMBERED = 1_000_000
SHORT = 48
#: Code points of texts that are cut into units together; a longer text is cut alone.
GROUP = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_known: dict[str, UnitCounts] = {}


def unit_counts(path: str) -> UnitCounts:
    """The worker's table for a tokenizer file."""
    if path not in _known:
        _known[path] = UnitCounts(path)
    return _known[path]


class UnitCounts(dict):
    """Tokens of a unit of text; ``add`` encodes units that it doesn't hold yet."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, units: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def add(self, units: list[str]) -> None:
        batch, size = [], 0
        for unit in units:
            batch.append(unit)
            size += 4 * len(unit)
            if size >= BATCH_BYTES:
                self.update(zip(batch, self.encode(batch)))
                batch, size = [], 0
        if batch:
            self.update(zip(batch, self.encode(batch)))

    def count_all(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if len(self) > REMEMBERED:
            self.clear()
        units = [UNITS.findall(t) for t in texts]
        found = [list(map(self.get, own)) for own in units]
        fresh = list(dict.fromkeys([u for own, n in zip(units, found) if None in n for u, k in zip(own, n) if k is None]))
        self.add(fresh)
        out = [sum(map(self.__getitem__, own)) if None in n else sum(n) for own, n in zip(units, found)]
        for unit in fresh:
            if len(unit) > SHORT:
                del self[unit]
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in groups of bounded length."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > GROUP:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs``.

    A null text counts as empty (0 and 0).  Repeated rows give repeated rows, a null key
    stays null, an empty table gives an empty table; other columns are not read.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = unit_counts(path or default_path())
        for batch in batches:
            found = [n for group in groups(batch.column(2).to_pylist()) for n in counts.count_all(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(key, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
        .mapInArrow(lengths, f"`{key}` {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
