"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by their
own figures: marked boilerplate (menus, footers, adverts, forms, comments, ...)
and blocks full of links are bad; long blocks with enough stop words are good;
short blocks without links are left open. Pass two gives every open block the
label of its nearest decided neighbours: of both if they agree, else of the
nearer one. The edge of an ``article`` or ``main`` element counts as a good
neighbour of the blocks inside.

Defined cases: null or empty html gives an empty text; unclosed and misnested
tags, comments and quotes end at the page's end at the latest; whole pages are
read, whatever their length; repeated rows are extracted one by one.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches

#: Blocks under SHORT characters are left open; blocks of LONG or more need fewer stop words.
SHORT, LONG = 70, 200
STOP_HIGH, STOP_LOW, LINKS_MOST = 0.25, 0.10, 0.4

STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they
this to was we were what when which who will with you
au aux avec ce dans de des du elle en est et il je la le les lui mais ne nous on ou par pas pour qu que qui sa se ses
son sur un une vous
als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist
mit nach nicht oder sich sie sind so über und von war wie wir zu zum zur
al como con de del el ella en es esta este la las lo los más me mi muy no o para pero por que se si sin sobre su sus un
una y
""".split())

BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td textarea tfoot th thead title tr ul
""".split())
#: Elements whose extent is followed; the others (p, li, ...) are only block limits.
CONTAINERS = frozenset("""
article aside button details dialog div dl fieldset figure footer form head header iframe main menu nav noscript object
ol section select svg table template textarea title ul
""".split())
BAD_TAGS = frozenset("""
aside button dialog footer form head iframe menu nav noscript object select svg template textarea title
""".split())
BAD_NAMES = frozenset("""
ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup
promo related reply replies search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar
widget
""".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.I | re.X)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN = "good", "bad", "open"


#: Beginnings and ends of a compound name that say something about the element, not what it is.
ABOUT_FIRST = frozenset("no has with without is not hide show layout".split())
ABOUT_LAST = frozenset("enabled disabled open closed on off ready left-open".split())
#: Names of texts whose own header carries the title.
TEXT_NAMES = frozenset("article content entry page post story".split())


def _bad_name(name: str) -> bool:
    """True if a whole class name, id or role says boilerplate: ``ad-slot``, ``site-footer``; not ``no-sidebar``."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if not parts or parts[0] in ABOUT_FIRST or parts[-1] in ABOUT_LAST:
        return len(parts) == 1 and parts[0] in BAD_NAMES
    if parts[0] in TEXT_NAMES and parts[-1] == "header":
        return False
    return parts[0] in BAD_NAMES or parts[-1] in BAD_NAMES


def _marked(attrs: str) -> bool:
    if "=" not in attrs:
        return False
    names = " ".join(a or b or c for a, b, c in _MARK.findall(attrs)).lower()
    return any(map(_bad_name, names.split()))


class _Page:
    """Blocks of one page as (text, characters in links, bad elements around, number of the article around or 0)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, tuple, int]] = []
        self.stack: list[tuple[str, tuple, int]] = []
        # numbers of the elements around that are marked by name; 0 for one that is bad by its tag
        self.bad: tuple = ()
        self.article, self.articles, self.marks = 0, 0, 0
        self.pieces: list[str] = []
        self.links: list[str] = []
        self.in_link = False

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.in_link:
            self.links.append(raw)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join(entities.unescape("".join(self.pieces)).split())
            if text:
                linked = len(" ".join(entities.unescape(" ".join(self.links)).split())) if self.links else 0
                self.blocks.append((text, linked, self.bad, self.article))
            self.pieces, self.links = [], []

    def open(self, name: str, attrs: str) -> None:
        if name == "a":
            self.in_link = True
        elif name == "br":
            self.text(" ")
        if name in BLOCK_TAGS:
            self.end_block()
            self.in_link = False
        if name in CONTAINERS and not attrs.endswith("/"):
            self.end_block()
            self.stack.append((name, self.bad, self.article))
            mark = ()
            if name in BAD_TAGS or (name == "header" and not self.article):
                mark = (0,)
            elif _marked(attrs):
                self.marks += 1
                mark = (self.marks,)
            if name in ("article", "main"):
                within = any(n == "article" for n, _, _ in self.stack[:-1])
                self.bad = (self.bad if within else ()) + mark
                self.articles += 1
                self.article = self.articles
            else:
                self.bad = self.bad + mark

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in BLOCK_TAGS or name in CONTAINERS:
            self.end_block()
        if name in CONTAINERS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    _, self.bad, self.article = self.stack[i]
                    del self.stack[i:]
                    break


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """Blocks as (text, characters in links, bad by markup, number of the article around or 0)."""
    p, at = _Page(), 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            p.text(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name:
            if m["close"] or m["close2"]:
                p.close(name.lower())
            else:
                p.open(name.lower(), m["attrs"] or m["attrs2"] or "")
    if at < len(page):
        p.text(page[at:])
    p.end_block()
    if not p.marks:
        return [(t, n, bool(bad), a) for t, n, bad, a in p.blocks]
    # an element around most of the page's text is no boilerplate, whatever its name, unless an article is free of marks
    size = [0 if 0 in bad or n > LINKS_MOST * len(t) else len(t) for t, n, bad, _ in p.blocks]
    good = [s and first_pass(t, n, False, a) == GOOD for s, (t, n, _, a) in zip(size, p.blocks)]
    inside: dict[int, list] = {}
    for s, ok, (_, _, bad, _) in zip(size, good, p.blocks):
        for mark in bad:
            one = inside.setdefault(mark, [0, False])
            one[0], one[1] = one[0] + s, one[1] or ok
    free = any(a and not bad for _, _, bad, a in p.blocks)
    outer = set() if free else {mark for mark, (s, ok) in inside.items() if mark and ok and 2 * s > sum(size)}
    # within such elements, what is marked itself stays so, unless it holds most of the text as well
    return [(t, n, any(m not in outer for m in bad), a) for t, n, bad, a in p.blocks]


def first_pass(text: str, linked: int, bad: bool, article: int) -> str:
    """Label of one block by its own figures."""
    if bad or linked > LINKS_MOST * len(text):
        return BAD
    if len(text) < SHORT:
        return OPEN
    found = _WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(len(found), 1)
    if density >= (STOP_LOW if len(text) >= LONG else STOP_HIGH):
        return GOOD
    # odd text inside an article is left to its neighbours
    return OPEN if article or density >= STOP_LOW else BAD


def second_pass(labels: list[str], articles: list[int]) -> list[bool]:
    """Which blocks are good, open ones by their nearest decided neighbours."""
    n = len(labels)

    def look(order, step):
        out, near, label = [None] * n, 0, BAD
        for i in order:
            j = i - step
            inside = articles[i] and not (0 <= j < n and articles[j] == articles[i])
            if inside:
                near, label = 0, GOOD  # the edge of the article
            elif 0 <= j < n and labels[j] != OPEN:
                near, label = 0, labels[j]
            near += 1
            out[i] = (near, label)
        return out

    before, after = look(range(n), 1), look(range(n - 1, -1, -1), -1)
    good = []
    for i, label in enumerate(labels):
        if label == OPEN:
            (d1, l1), (d2, l2) = before[i], after[i]
            label = l1 if l1 == l2 or d1 < d2 else l2 if d2 < d1 else GOOD if articles[i] else BAD
        good.append(label == GOOD)
    return good


def main_text(page: str | None) -> str:
    # what an article marks as boilerplate is no neighbour of its text
    found = [b for b in blocks(page or "") if not (b[2] and b[3])]
    keep = second_pass([first_pass(*b) for b in found], [b[3] for b in found])
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    small_batches(pages.sparkSession)
    slim = pages.select("page_id", "url", "html")
    kinds = [slim.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "html"):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return slim.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string").withColumn(
        "n_chars", F.length("text").cast("long"))
