"""Main text of web pages by consensus host paths.

Each page is read once into a flat list of blocks, every block with the path of elements
that hold it.  Containers on those paths are scored by the text they hold, less link text,
and each page votes for the generalised path (tag and class names, digits folded) of its
best ones.  Spark adds up the votes per host; the winning paths go back to the host's pages,
whose text is taken again from all containers on the best-placed winning path, or on the path
of the page's own best container where no winner is on the page.

Names that tell of menus, shares, widgets and the like drop a container only where the rest of
the page has text: one that holds nearly all of it holds the article, whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.llm.staging import stage

#: Fixed values of HTML: elements without content, elements inside a line, and those that the
#: start of a block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html main menu nav ol p pre section table ul".split())
#: Elements whose text is never part of an article, and those whose content isn't markup.
DROPPED = frozenset("head nav footer header aside button select textarea iframe object svg canvas noscript template dialog menu title style script".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Elements that names never drop, and those dropped like names.
KEPT, NAMED = frozenset(("html", "body", "main", "article")), frozenset(("form",))
#: Class, id and role names of what isn't the article; those of comments and adverts drop a container whatever it holds.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|comments?|respond|reply|disqus|cookies?|consent|popup|modal)(?:$|[\s_-])", re.I)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|aside|menu|nav\w*|breadcrumbs?|comments?|respond|reply|disqus|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|social|related|footer|header|masthead|login|search|widget|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LIKELY = {"article": 3.0, "main": 2.0, "section": 1.2, "div": 1.0, "td": 0.9, "body": 0.6, "html": 0.3}
PATHS = 3
#: A page whose text is this part or less outside named containers gets the largest of them back.
REST = 0.05
#: Parts into which a host's pages are dealt where its paths are joined to them.
SALTS = 32


class Page:
    """Blocks of one page: ``blocks`` has (text, letters in links, index of the holding container)."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["html"]
        self.never: list[bool] = [False]
        self.named: list[bool] = [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._read(source)
        self.dropped = self._dropped()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their containers
        text: list[str] = []
        links = 0
        inside_link = 0
        holder = 0

        def flush() -> None:
            nonlocal links
            if text:
                line = " ".join(entities.unescape("".join(text)).split())
                if line:
                    self.blocks.append((line, links, holder))
                text.clear()
            links = 0

        at, size = 0, len(source)
        while at < size:
            found = TAG.search(source, at)
            end = found.start() if found else size
            if end > at:
                piece = source[at:end]
                text.append(piece)
                if inside_link:
                    links += len(piece)
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                text.append(" ")
                continue
            if name in INLINE:
                if name == "a":
                    inside_link = 0 if found[1] else 1
                continue
            flush()
            if found[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                holder = stack[-1][1]
                continue
            if name in RAW:
                close = re.compile(f"</{name}[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
                continue
            if name in CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                stack.pop()
            if name in VOID:
                holder = stack[-1][1]
                continue
            parent = stack[-1][1]
            labels = " ".join(x[1] or x[2] or x[3] for x in NAMES.findall(found[3])) if found[3] else ""
            kinds = [a or b or c for k, a, b, c in NAMES.findall(found[3]) if k.lower() == "class"] if labels else []
            if name in ("html", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr") and not (labels and (NOISE.search(labels) or NEVER.search(labels)) and name not in KEPT):
                stack.append((name, parent))
            else:
                step = name + "".join("." + re.sub(r"\d+", "#", c) for k in kinds for c in sorted(k.split()))
                self.paths.append(f"{self.paths[parent]}>{step}")
                self.parents.append(parent)
                self.tags.append(name)
                told = name not in KEPT and bool(labels)
                self.never.append(self.never[parent] or name in DROPPED or (told and bool(NEVER.search(labels))))
                self.named.append(name in NAMED or (told and bool(NOISE.search(labels))))
                stack.append((name, len(self.paths) - 1))
            holder = stack[-1][1]
        flush()

    def _held(self) -> list[float]:
        """Text outside links that each container holds itself, without what is never an article."""
        own = [0.0] * len(self.paths)
        for line, links, at in self.blocks:
            if not self.never[at]:
                own[at] += max(0, len(line) - 2 * links)
        return own

    def _dropped(self) -> list[bool]:
        named, own = self.named, self._held()
        whole = list(own)
        for i in range(len(own) - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
        while True:
            out = [False] * len(own)
            tops, rest = [], 0.0
            for i in range(len(own)):
                above = i > 0 and out[self.parents[i]]
                out[i] = above or self.never[i] or named[i]
                if named[i] and not above and not self.never[i]:
                    tops.append(i)
                if not out[i]:
                    rest += own[i]
            largest = max(tops, key=lambda i: (whole[i], -i), default=None)
            if largest is None or rest > REST * whole[0] or whole[largest] <= rest:
                return out
            named[largest] = False

    def scores(self) -> list[float]:
        """For each container the text outside links that it holds, weighted by what it is."""
        own = [0.0] * len(self.paths)
        for line, links, at in self.blocks:
            if not self.dropped[at]:
                own[at] += max(0, len(line) - 2 * links)
        for i in range(len(own) - 1, 0, -1):
            own[self.parents[i]] += own[i]
        return [0.0 if self.dropped[i] else own[i] * LIKELY.get(self.tags[i], 0.8) for i in range(len(own))]

    def ranked(self) -> list[int]:
        scores = self.scores()
        return [i for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)) if scores[i] > 0]

    def text(self, path: str) -> str:
        """The blocks under containers on ``path`` that aren't under something dropped, in page order."""
        inside = [False] * len(self.paths)
        for i in range(len(inside)):
            inside[i] = (self.paths[i] == path or (i > 0 and inside[self.parents[i]])) and not self.dropped[i]
        return " ".join(line for line, _, at in self.blocks if inside[at])


def extract(source: str | None, winners: list[str] | None) -> str:
    page = Page(source or "")
    order = page.ranked()
    if not order:
        return ""
    there = {page.paths[i] for i in order}
    return page.text(next((p for p in winners or () if p in there), page.paths[order[0]]))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and its ``PATHS`` paths with most votes, best first.

    A page gives each of its best containers a vote that falls with its place; votes add up
    before they are shuffled, so a host with a third of all pages is no heavier than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                for place, i in enumerate(page.ranked()[:PATHS]):
                    tally[host, page.paths[i]] = tally.get((host, page.paths[i]), 0.0) + 1 / (1 + place)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.float64())],
                names=["host", "path", "vote"],
            )

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, vote double")
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    best = summed.withColumn("place", place).where(F.col("place") <= PATHS)
    return best.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("winners"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null or empty html, or a page of nothing but menus and the like, has the text "".  Pages
    without a readable host share the host "".  Repeated rows give repeated rows; other
    columns aren't read.  Ties of containers go to the first on the page, ties of paths to the
    smaller name.
    """
    winners = stage(host_paths(pages, url, html), "hosts")
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    # a host may have a third of all pages: its pages are dealt to parts, and its paths go to each
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
    dealt = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(dealt, ["host", "_salt"], "left").select("page_id", "url", "html", "winners")
    kind = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
