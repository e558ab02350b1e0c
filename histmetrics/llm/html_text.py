"""HTML extraction by consensus host paths.

Each page is cut into tags and texts once, without building a tree library: a
stack of open elements gives every text its path of tag-class steps, generalised
so that digits in classes and ids do not matter. Containers are scored by the
text they hold themselves or in their paragraphs, less link text. Each page votes
for the path of its best container with a weight that grows with the text; votes
are summed per host and path in Spark, partly before the shuffle, and the path
with the most votes wins (ties: the smallest path). Every page is then extracted
again from all containers on its host's winning path, or from its own best
container if the host's path is not on the page. Hosts' winners are one row per
host and are joined by host.

Left out inside the container: scripts, styles, navigation, headers, footers,
asides, forms, buttons, adverts, notices, sidebars, menus and reader comments, by
tag, role or class words. A comment of the markup never counts as text. A class
word alone does not take the article away: names that state something of the page
(``no-sidebar``, ``with-footer``, ``comments-enabled``) do not count, and an element
that is named so is kept if it holds the winning container, ``main``, an article
that outweighs what stands outside such elements, or nearly all running text.

Defined results: null and empty pages give an empty text; a null or odd url has
the empty host; repeated rows get the same text each; an empty table gives an
empty result. Character references are decoded once; white space inside a block
becomes one space. Whole pages are read, nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, written

#: A comment, a declaration, or a tag with its attributes (quoted values may hold ">").
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
DIGITS = re.compile(r"[0-9]+")
WORDS = re.compile(r"[a-z]+")

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED_TAGS = frozenset(
    "head nav header footer aside form button select option fieldset menu dialog audio video canvas object figure picture".split()
) - {"figure"}
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIPPED_WORDS = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer foot
    header masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted
    related respond reply replies share sharing sidebar social sponsor sponsored subscribe topbar toolbar widget widgets skip""".split()
)
READER_WORDS = frozenset("comment comments disqus respond reply replies".split())
# Words of a name that tell what a page has or is, before and after the word they are about.
STATES_BEFORE = frozenset("no not has have with without is".split())
STATES_AFTER = frozenset("enabled disabled open closed on off".split())
#: An element that is named like an advert is the article if it holds so much running text, and so many times what stands outside.
LEAST_ARTICLE, OUTWEIGHS = 200, 4
#: Blocks of so many characters are running text.
RUNNING = 25
CLOSES_PARAGRAPH = frozenset(
    """address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul
    figure details""".split()
)
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())


def host_of(url) -> Column:
    """Host of an address in lower case, without port or user; empty if there is none."""
    host = F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)*([^/?#:]*)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


class Page:
    """Blocks of text with their containers. ``blocks``: (numbers of the open containers, text, linked characters)."""

    def __init__(self, markup: str):
        self.paths: list[str] = [""]  # of each container, from the root, which holds all
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.left_out: dict[int, bool] = {}  # containers that are left out by a word; True: reader comments
        self._read(markup)
        self._keep_articles()

    @staticmethod
    def _step(tag: str, attributes: str) -> tuple[str, bool, set[str]]:
        """Generalised step of an element, whether its text is left out, and words that speak for leaving it out."""
        skip, words = tag in SKIPPED_TAGS, set()
        if not attributes or tag in ("body", "html", "article", "main") and "class" not in attributes and "role" not in attributes:
            return tag, skip, words
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        classes = found.get("class", "").lower()
        step = ".".join([tag, *sorted({DIGITS.sub("0", c) for c in classes.split()})])
        if tag not in ("body", "html", "article", "main"):
            for name in (*classes.split(), found.get("id", "").lower()):
                parts = WORDS.findall(name)
                for before, word, after in zip(["", *parts], parts, [*parts[1:], ""]):
                    if word in SKIPPED_WORDS and before not in STATES_BEFORE and after not in STATES_AFTER:
                        words.add(word)
        style = found.get("style", "").replace(" ", "").lower()
        skip = skip or found.get("role", "").lower() in SKIPPED_ROLES
        skip = skip or "hidden" in found or "display:none" in style or re.search(r"\shidden(?=[\s/]|$)", attributes) is not None
        return step, skip, words

    def _read(self, markup: str) -> None:
        # One entry for each open element: (tag, path, skipped, container number or -1).
        stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
        containers: list[int] = [0]
        text: list[str] = []
        linked, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                self.blocks.append((tuple(containers), whole, min(linked, len(whole))))
            text.clear()
            linked = 0

        def close(upto: int) -> None:
            nonlocal in_link
            while len(stack) > upto:
                tag, _, _, number = stack.pop()
                in_link -= tag == "a"
                if number >= 0:
                    containers.pop()

        def add(part: str) -> None:
            nonlocal linked
            if part and not stack[-1][2]:
                text.append(part)
                linked += len(part) * (in_link > 0)

        end = len(markup)
        while at < end:
            m = MARKUP.search(markup, at)
            if m is None:
                add(markup[at:])
                break
            add(markup[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if text and tag not in INLINE:
                flush()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(markup, at)
                at = stop.start() if stop else end
                continue
            if tag in CLOSES_PARAGRAPH:
                self._close_open(stack, ("p",), close)
            if tag in CLOSED_BY_SAME:
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                self._close_open(stack, same, close)
            step, skip, words = self._step(tag, m[3])
            if tag in INLINE:
                skip = skip or bool(words)
            _, path, skipped, _ = stack[-1]
            number = -1
            if tag not in INLINE:
                path, number = f"{path}/{step}", len(self.paths)
                self.paths.append(path)
                containers.append(number)
                if words:
                    self.left_out[number] = bool(words & READER_WORDS)
            stack.append((tag, path, skipped or skip, number))
            in_link += tag == "a"
        flush()

    @staticmethod
    def _close_open(stack, tags, close) -> None:
        """Closes the innermost open element of these kinds, unless a block lies between."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                close(k)
                return
            if stack[k][0] not in INLINE:
                return

    def _keep_articles(self) -> None:
        """Takes back the leaving out of elements that hold the page's article, one at a time, the largest first."""
        while self.left_out:
            held: dict[int, int] = defaultdict(int)
            outside, all_of = 0, self.left_out
            for containers, text, linked in self.blocks:
                value = len(text) - linked if len(text) >= RUNNING else 0
                if all_of.keys().isdisjoint(containers):
                    outside += value
                reader = any(all_of.get(c, False) for c in containers)
                for k, c in enumerate(containers):
                    # Reader comments do not make an element an article; they count for themselves alone.
                    if c in all_of and (not reader or all_of[c]):
                        held[c] += value
                    if c in all_of and self._is_article(containers, k, value, all_of):
                        held[-c] += value
            good = [
                c
                for c, reader in all_of.items()
                if held[-c] > outside or not reader and held[c] >= LEAST_ARTICLE and held[c] > OUTWEIGHS * outside
            ]
            if not good:
                return
            del self.left_out[max(good, key=lambda c: (held[c], -c))]

    def _is_article(self, containers: tuple[int, ...], k: int, value: int, left_out: dict[int, bool]) -> bool:
        """Whether a block lies in a main or article element inside container k, with none that is left out between."""
        for c in reversed(containers[k + 1 :]):
            if c in left_out:
                return False
            if value and self.paths[c].rpartition("/")[2].split(".")[0] in ("article", "main"):
                step = self.paths[c].rpartition("/")[2]
                return READER_WORDS.isdisjoint(WORDS.findall(step))
        return False

    def _kept(self) -> Iterator[tuple[tuple[int, ...], str, int]]:
        return (b for b in self.blocks if self.left_out.keys().isdisjoint(b[0]))

    def best(self) -> int:
        """Number of the container that holds the most running text itself or in its children; -1 if none."""
        score: dict[int, float] = defaultdict(float)
        for containers, text, linked in self._kept():
            value = (len(text) - 2 * linked) * (1.0 if len(text) >= RUNNING else 0.25)
            score[containers[-1]] += 0.5 * value
            # The parent gathers its paragraphs; a grandparent (sections of one article) gathers half of them.
            if len(containers) > 1:
                score[containers[-2]] += value
            if len(containers) > 2:
                score[containers[-3]] += 0.9 * value
        good = {k: v for k, v in score.items() if v > 0}
        best = max(good, key=lambda k: (good[k], -k), default=-1)
        # An article or main element around the best container is the better border.
        if best >= 0:
            path = self.paths[best]
            for k in range(best - 1, -1, -1):
                outer = self.paths[k]
                if path.startswith(outer + "/") and outer.rpartition("/")[2].split(".")[0] in ("article", "main"):
                    return k
        return best

    def text_of(self, chosen: set[int]) -> str:
        """Blocks inside the chosen containers, without what is left out inside them."""
        parts = []
        for containers, text, _ in self.blocks:
            at = next((k for k, c in enumerate(containers) if c in chosen), None)
            if at is not None and self.left_out.keys().isdisjoint(containers[at + 1 :]):
                parts.append(text)
        return " ".join(parts)

    def vote(self) -> tuple[str, float]:
        best = self.best()
        if best < 0:
            return "", 0.0
        held = sum(len(t) for c, t, _ in self._kept() if best in c)
        return self.paths[best], float(held) ** 0.5

    def extract(self, winner: str) -> str:
        """Text of the containers on the winning path, or of the page's own best one."""
        chosen = {k for k, path in enumerate(self.paths) if path == winner and path}
        text = self.text_of(chosen) if chosen else ""
        return text or self.text_of({self.best()})


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: the container path that each host's pages vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, markup in zip(batch.column(0).to_pylist(), batch.column(1)):
                path, weight = Page((markup.as_py() or b"").decode("utf-8", "replace")).vote()
                if path:
                    votes[host, path] += weight
            if votes:
                hosts, paths = zip(*votes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts), pa.array(paths), pa.array(votes.values(), type=pa.float64())], ["host", "path", "votes"]
                )

    voted = pages.select(host_of("url").alias("host"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "host string, path string, votes double")
    summed = voted.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # Rounded, so that the order of adding does not decide; of equals the smallest path wins.
    best = F.min_by("path", F.struct((-F.round("votes", 6)).alias("v"), F.col("path")))
    return summed.groupBy("host").agg(best.alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host_path."""
    keyed = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    # The table of paths is written first: the planner broadcasts it if its files are small, and else joins by host.
    joined = keyed.join(written(host_paths(pages), "host_paths"), "host", "left")
    both = joined.select("page_id", "url", "path", F.concat_ws("\n", F.coalesce("path", F.lit("")), F.coalesce("html", F.lit(""))).alias("both"))

    def run(texts):
        found = []
        for text in texts:
            winner, _, markup = (text or b"\n").decode("utf-8", "replace").partition("\n")
            found.append(Page(markup).extract(winner))
        return found, [len(t) for t in found]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    done = annotate(both, "both", run, fields, ["page_id", "url", "path"])
    return done.select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", "n_chars", F.col("row.path").alias("host_path")
    )
