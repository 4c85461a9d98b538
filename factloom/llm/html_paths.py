"""Main text of web pages by tag-path ratios.

A page's text falls into blocks, each with its root-to-leaf tag path (tags with their classes). Text length and
punctuation are summed per path and divided by the path's number of blocks; the two ratios are fused, smoothed over
neighbouring blocks in page order, averaged per path again, and paths at or above a share of the level of the path that holds most
text are content. So are blocks that stand between them at the same place, and headings right before them.
Paths under what is boilerplate by its nature (menus, forms, adverts, reader comments ...) weigh nothing. Where a
page states which element is its article and that holds most of the text outside links, this shifts the threshold: down
for paths inside, linked headings and lists included, and up for paths outside.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import appended, others

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|([^<]+)|(<)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}
#: Elements that never hold main text, and whole names in class, id or role that mark them so, alone or as one of the compounds.
NEVER = frozenset("head nav aside footer form button select option datalist script style noscript template svg iframe object canvas dialog menu textarea title".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer "
    "sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments commentlist comment-list disqus replies respond pagination pager toolbar complementary contentinfo hidden".split()
)
COMMENTS = frozenset("comment comments commentlist comment-list disqus replies respond".split())
KINDS = (
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments pagination pager toolbar"
).split()
PARTS = "area bar block blocks box banner button buttons container content form icons inner items label link links list menu notice panel popup posts articles stories section slot top unit widget widgets wrap wrapper".split()
PLACES = "site page main global top bottom left right primary secondary footer header sidebar nav user post article entry google dfp".split()
COMPOUNDS = frozenset([f"{k}-{p}" for k in KINDS for p in PARTS] + [f"{p}-{k}" for k in KINDS for p in PLACES])
OUTSIDE = frozenset(["header", "topbar", *(f"{p}-header" for p in ("site", "page", "main", "global")), *(f"header-{p}" for p in PARTS)])
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
HEADING = re.compile(r"h[1-6](?:\.|$)")
#: The share of the main path's level that content reaches, and by how much a stated article lowers it inside and raises it outside.
THRESHOLD, INSIDE, OUTSIDE_MORE = 0.65, 0.65, 0.25
#: Marked text of so many times the length of the article beside it is not boilerplate.
TEASER = 8


class Path:
    """A root-to-leaf tag path: its last step and the path above it. Equal paths of one page are one object, so a page's memory is linear in its elements, however deep they lie."""

    __slots__ = ("above", "step", "below")

    def __init__(self, above: Path | None, step: str):
        self.above, self.step, self.below = above, step, {}

    def to(self, step: str) -> Path:
        if step not in self.below:
            self.below[step] = Path(self, step)
        return self.below[step]

    def __str__(self) -> str:
        steps, at = [], self
        while at.above:
            steps.append(at.step)
            at = at.above
        return "/" + "/".join(reversed(steps))


class _Element:
    __slots__ = ("tag", "path", "never", "article", "link", "mark")

    def __init__(self, tag, path, never, article, link, mark=0):
        self.tag, self.path, self.never, self.article, self.link, self.mark = tag, path, never, article, link, mark


def _standing(found: list[tuple], marks: list[tuple[int, bool, bool]]) -> list[bool]:
    """Whether what lies under each mark is boilerplate: not if its element holds the article or most of the text outside links.

    ``marks``: (mark around it, in an article, named as readers' comments) in page order; the first is no mark. Beside an article
    comments may outweigh it, and so may other marked text unless the article is a mere teaser by comparison.
    """
    under, articles = [0] * len(marks), [0] * len(marks)
    for _, text, linked, never, article, mark in found:
        size = 0 if never else max(0, len(text) - linked)
        under[mark] += size
        articles[mark] += size if article else 0
    for k in range(len(marks) - 1, 0, -1):
        under[marks[k][0]] += under[k]
        articles[marks[k][0]] += articles[k]
    stands, taken = [False] * len(marks), 0  # taken: article text under marks that stand
    for k in range(1, len(marks)):
        around, inside, comments = marks[k]
        if stands[around]:
            stands[k] = True
            continue
        elsewhere = articles[0] - articles[k] - taken
        holds = articles[k] > 0 and not inside and not elsewhere
        most = 2 * under[k] > under[0] and (not elsewhere or not comments and under[k] > TEASER * elsewhere)
        stands[k] = not (holds or most)
        taken += articles[k] if stands[k] else 0
    return stands


def blocks(html: str) -> list[tuple[Path, str, int, bool, bool]]:
    """(path, text, characters in links, boilerplate by nature, in the article) of every block with text, in page order."""
    root = _Element("", Path(None, ""), False, False, False)
    stack, out, at = [root], [], 0
    opened: dict[str, int] = defaultdict(int)  # open elements by tag, so that a stray end tag costs no walk up the stack

    def pop(k: int):
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]
    marks = [(0, False, False)]
    texts: list[str] = []
    link_chars, owner = 0, root

    def flush():
        nonlocal texts, link_chars
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append((owner.path, text, link_chars, owner.never, owner.article, owner.mark))
            texts, link_chars = [], 0

    end = len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        run = m.group(7) or m.group(8)
        if run:
            top = stack[-1]
            if not texts:
                owner = next(e for e in reversed(stack) if e.tag not in INLINE)
                if (top.never, top.mark) != (owner.never, owner.mark):
                    owner = _Element(owner.tag, owner.path, top.never, owner.article, False, top.mark)
            elif (top.never, top.mark) != (owner.never, owner.mark):  # an inline advert inside a block
                flush()
                owner = next(e for e in reversed(stack) if e.tag not in INLINE)
                owner = _Element(owner.tag, owner.path, top.never, owner.article, False, top.mark)
            decoded = unescape(run) if "&" in run else run
            texts.append(decoded)
            if top.link:
                link_chars += len(decoded)
            continue
        closing, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append(" ") if texts else None
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if opened[tag]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = html.find(">", close.start()) + 1 or end if close else end
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            gone = CLOSES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in gone:
                    pop(k)
                    if stack[-1].tag not in gone:
                        break
                elif stack[k].tag not in INLINE:
                    break
        top = stack[-1]
        named, hidden = "", False
        if rest and not rest.isspace():
            given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
            named = " ".join(given.get(k, "") for k in ("class", "id", "role")).lower()
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        article = top.article or tag in ("article", "main") or "role" in rest and named.endswith("main")
        names = set(named.replace("_", "-").split()) if named else set()
        never, mark = top.never or tag in NEVER or hidden, top.mark
        if not article and tag in OUTSIDE:
            never = True
        if tag in ("html", "body"):
            never = False
        elif not never and (not MARKED.isdisjoint(names) or not COMPOUNDS.isdisjoint(names) or not article and not OUTSIDE.isdisjoint(names)):
            marks.append((mark, top.article, any(n in COMMENTS or n.startswith(("comment-", "comments-")) for n in names)))
            mark = len(marks) - 1
        key = f"{tag}.{'.'.join(sorted(named.split()))}" if named else tag
        stack.append(_Element(tag, top.path.to(key), never, article, top.link or tag == "a", mark))
        opened[tag] += 1
    flush()
    stands = _standing(out, marks)
    return [(path, text, linked, never or stands[mark], article) for path, text, linked, never, article, mark in out]


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones_like(values), kernel, "full")[2:-2]
    return np.convolve(values, kernel, "full")[2:-2] / weight


def content(found: list[tuple[Path, str, int, bool, bool]], threshold: float = THRESHOLD) -> list[bool]:
    """For each block whether it is content: its path's fused, smoothed ratio reaches ``threshold`` times that of the path with most text outside links."""
    sums = defaultdict(lambda: np.zeros(4))  # characters, punctuation, blocks, characters in links
    for path, text, linked, never, _ in found:
        if not never:
            sums[path] += (len(text), len(PUNCTUATION.findall(text)), 1, linked)
    if not sums:
        return [False] * len(found)
    fused = {p: (s[0] - s[3]) / s[2] * (1 + s[1] / s[2]) * (1 - min(1.0, s[3] / s[0])) for p, s in sums.items()}
    line = _smooth(np.log1p([0.0 if never else fused[path] for path, _, _, never, _ in found]))
    mean = defaultdict(list)
    for (path, _, _, never, _), v in zip(found, line):
        if not never:
            mean[path].append(v)
    value = {p: min(float(np.mean(v)), float(np.log1p(fused[p]))) for p, v in mean.items()}  # its own ratio too: its neighbours may be the article
    unlinked = {p: s[0] - s[3] for p, s in sums.items()}
    level = value[max(unlinked, key=unlinked.get)]
    stated = {p for p, _, _, never, article in found if article and not never}
    trusted = 2 * sum(unlinked[p] for p in stated) > sum(unlinked.values())
    shift = {p: (-INSIDE if p in stated else OUTSIDE_MORE) if trusted else 0.0 for p in sums}
    chosen = {p for p in sums if value[p] >= (threshold + shift[p]) * level and (fused[p] > 0 or p in stated and trusted)}
    if not chosen:
        chosen = {p for p in fused if fused[p] > 0}
    taken = [not never and path in chosen for path, _, _, never, _ in found]
    homes = {p.above for p in chosen}
    if any(taken):
        first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
        while first and not found[first - 1][3] and HEADING.match(found[first - 1][0].step) and found[first - 1][0].above in homes:
            first -= 1
        for k in range(first, last + 1):
            path, _, _, never, _ = found[k]
            if not never and path.above in homes and (fused[path] > 0 or HEADING.match(path.step)):
                taken[k] = True
    return taken


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of one page: its content blocks in page order, joined by an empty line; empty if there is none."""
    found = blocks(html or "")
    return "\n\n".join(text for (_, text, _, _, _), take in zip(found, content(found, threshold)) if take)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points); a row for each row.

    Null and empty html give an empty text. Columns of ``pages`` that are called ``text`` or ``n_chars`` give way.
    """
    extra = [pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                gone = pa.nulls(part.num_rows, pa.string())  # the html does not go back
                added = [gone, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *added], schema=pa.schema([*batch.schema, *extra]))

    frame = pages.select(*others(pages, html_col, "text", "n_chars"), F.col(html_col).cast("string").alias("_html"))
    return appended(frame, run, "text string", "n_chars long").drop("_html")


def op4_html(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
