"""Main text of a page by the distribution of its line blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from factsheet.llm.common import map_text

#: Elements that begin a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not markup: it ends at the next end tag of their name.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Elements that never hold the text of an article, and those that do only if they hold most of a page.
FURNITURE = frozenset("nav footer menu dialog button select svg math canvas audio video object head".split())
SUSPECT = frozenset("aside form search".split())
#: Words in class, id or role of furniture.
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs colophon comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login masthead menu modal more nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Those of what readers add, which may be longer than the article, and is never part of it.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Beginnings of words that name furniture whatever stands beside them, and words that begin so and do not.
STEMS = ("comment", "cookie", "consent", "advert", "sponsor", "newsletter", "disqus")
NO_STEMS = frozenset("commentary commentator consenting".split())
#: Words beside a name that say something of a box and do not name it: ``no-comments``, ``comments-open``.
STATES = frozenset("allow allowed closed count counts disabled enabled has hide hidden no not number off on open show status with without".split())
#: Words that may stand beside such a name in a class or id: ``site-footer`` is furniture, ``has-sidebar`` is not.
BESIDE = frozenset(
    "area article articles aside bar block blog body bottom box btn button buttons card cards center col column container dfp entry facebook feed first fixed floating form global google group icon icons inline inner item items js label last layer left leaderboard line link links list lower main middle mobile mod module native news outer page pane panel post posts primary right row section secondary single site slot small sticky stories story sub table tertiary thread title top twitter unit upper web wide wrap wrapper".split()
)
FIELDS = frozenset("input select textarea".split())
#: Characters of text under which a suspect is furniture, and from which a span is text on its own.
SHORT, ENOUGH = 250, 80
#: Lower-casing a page would move what stands after some letters, so end tags are found in the page itself.
RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open paragraph, item, cell or row ends before: what the same kind closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^>])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)


def named(token: str) -> set[str]:
    """The names of furniture in a class or id, if all its other words may stand beside one, and words that begin as such a name must."""
    parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
    if parts & STATES:
        return set()
    stems = {stem for p in parts - NO_STEMS for stem in STEMS if p.startswith(stem)}
    return stems | (parts & NAMES if parts <= NAMES | BESIDE else set())


def suspicion(name: str, attributes: str, inside: bool) -> str:
    """``never`` for an element without article text, also one of readers' comments, ``suspect`` if its text must tell, else empty.

    ``inside`` an article, a header may hold its headline. An outermost article is suspect by no name, but may be a comment.
    """
    if name in FURNITURE:
        return "never"
    found = "suspect" if name in SUSPECT or (name == "header" and not inside) else ""
    if not attributes or name in ("html", "body", "main"):
        return found
    outermost = name == "article" and not inside
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if not outermost and (key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value.lower()))):
            return "never"
        if key in ("class", "id", "role"):
            for one in value.split():
                names = named(one)
                if names & COMMENTS:
                    return "never"
                if names and not outermost and not (inside and names == {"header"}):
                    found = "suspect"
    return found


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``text``, and what opens, closes or is void, in order, with attributes; closed in pairs, also where a tag is left out."""
    open_, at = [], 0
    often: Counter[str] = Counter()  # of each name, how many are open

    def closed() -> str:
        often[open_[-1]] -= 1
        return open_.pop()

    while at < len(page):
        found = MARKUP.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            yield "text", text, ""
        if not found:
            break
        at = found.end()
        if (name := (found["name"] or "").lower()) == "":
            continue
        if not found["end"]:
            if name in RAW:
                if name in FIELDS:
                    yield "void", name, found["rest"]
                close = RAW_END[name].search(page, at)
                at = close.start() if close else len(page)
                continue
            while open_ and (open_[-1] in CLOSES.get(name, ()) or (open_[-1] == "p" and name in BLOCKS)):
                yield "close", closed(), ""
            if name in VOID:
                yield "void", name, found["rest"]
            else:
                open_.append(name)
                often[name] += 1
                yield "open", name, found["rest"]
        elif often[name]:
            while True:
                yield "close", (last := closed()), ""
                if last == name:
                    break
        elif name == "p":
            yield "void", "p", ""
    while open_:
        yield "close", open_.pop(), ""


@dataclass
class Element:
    """Sums over a page up to where an element opens, and over the element when it has closed."""

    kind: str
    name: str
    text: int = 0
    fields: int = 0
    marks: int = 0


def furniture(marked_up: Sequence[tuple[str, str, str]]) -> set[int]:
    """Numbers of the events that open furniture.

    A suspect goes if its own text is short, or little beside its fields, or less than half of the page's (a quarter
    for what holds the headline or an article). Text of links does not count.
    """
    suspects, never, stack, depth, links = {}, set(), [], 0, 0
    hidden, text, fields, marks = 0, 0, 0, 0
    for i, (what, name, rest) in enumerate(marked_up):
        if what == "text":
            text += len(" ".join(name.split())) if not (hidden or links) else 0
        elif what == "void":
            fields += name in FIELDS and not hidden and "hidden" not in rest.lower()
        elif what == "open":
            kind = suspicion(name, rest, depth > 0)
            fields += name in FIELDS and not hidden
            if kind == "never":
                never.add(i)
            elif kind:
                suspects[i] = Element(kind, name, text, fields, marks)
            stack.append((i, kind))
            hidden += kind == "never"
            depth += name in ("article", "main")
            marks += name in ("article", "main", "h1") and not hidden
            links += name == "a"
        else:
            at, kind = stack.pop()
            hidden -= kind == "never"
            depth -= name in ("article", "main")
            links -= name == "a"
            if at in suspects:
                e = suspects[at]
                e.text, e.fields, e.marks = text - e.text, fields - e.fields, marks - e.marks
    for i, e in suspects.items():
        holds = 2 * e.text > text or (e.marks > 0 and 4 * e.text > text)
        long = e.text >= SHORT or (e.text == text and (e.marks > 0 or e.name == "form"))
        if not (holds and long and e.text >= 40 * e.fields):
            never.add(i)
    return never


@dataclass
class Line:
    text: str = ""
    linked: int = 0


@dataclass
class Stripped:
    """Lines of a page in order, with the number of their article (0 outside); a gap of empty lines where furniture stood."""

    gap: int
    lines: list[Line] = field(default_factory=list)
    article: list[int] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def end_line(self, inside: int) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.lines.append(Line(text, self.linked))
            self.article.append(inside)
        self.parts.clear()
        self.linked = 0

    def end_region(self, inside: int) -> None:
        self.end_line(inside)
        self.lines.extend(Line() for _ in range(self.gap))
        self.article.extend([inside] * self.gap)


def strip(page: str, gap: int) -> Stripped:
    """Markup away; furniture away, whose place outside an article becomes a gap."""
    marked_up = list(events(page))
    gone = furniture(marked_up)
    out, open_, skipped, links, depth, inside = Stripped(gap), 0, None, 0, 0, 0
    for i, (what, name, _) in enumerate(marked_up):
        if what == "text":
            if skipped is None:
                out.parts.append(name)
                out.linked += len(name.strip()) if links else 0
        elif what == "void":
            if skipped is None and name == "br":
                out.parts.append(" ")
            elif skipped is None and name in BLOCKS:
                out.end_line(inside if depth else 0)
        elif what == "open":
            if skipped is None:
                if i in gone:
                    skipped = open_
                    if not depth:
                        out.end_region(0)
                    elif name in BLOCKS:
                        out.end_line(inside)
                elif name in ("article", "main"):
                    if depth:
                        out.end_line(inside)
                    else:
                        out.end_region(0)
                        inside += 1
                    depth += 1
                elif name in BLOCKS:
                    out.end_line(inside if depth else 0)
                links += name == "a"
            open_ += 1
        else:
            open_ -= 1
            if skipped is not None:
                if skipped == open_:
                    skipped = None
            elif name in ("article", "main"):
                depth -= 1
                if depth:
                    out.end_line(inside)
                else:
                    out.end_region(inside)
            elif name in BLOCKS:
                out.end_line(inside if depth else 0)
            links -= name == "a" and links > 0 and skipped is None
    out.end_line(inside if depth else 0)
    return out


def spans(lengths: np.ndarray, window: int, least: float, whole: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """From each surge to the dive after it: in every run of lines, the first window with ``least`` of the highest sum to the last.

    A run goes on while the window that begins at a line has any length. One that never reaches so much counts whole
    if it lies between two that do. In runs that begin at a line which is ``whole``, any length is enough. Lines
    without length at either end of a span stay outside.
    """
    padded = np.concatenate([lengths, np.zeros(window - 1, np.int64)])
    sums = np.convolve(padded, np.ones(window, np.int64), "valid") if len(lengths) else lengths
    live = np.concatenate([[False], sums > 0, [False]])
    begins, ends = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
    runs = []
    for a, b in zip(begins.tolist(), ends.tolist()):
        first = a + int(np.argmax(lengths[a:b] > 0))
        high = a + np.flatnonzero(sums[a:b] >= (1 if whole is not None and whole[first] else least * sums.max()))
        runs.append((int(high[0]), min(int(high[-1]) + window, b), True) if len(high) else (a, b, False))
    reached = [i for i, run in enumerate(runs) if run[2]]
    for a, b, _ in runs[reached[0] : reached[-1] + 1] if reached else []:
        inside = np.flatnonzero(lengths[a:b] > 0) + a
        yield int(inside[0]), int(inside[-1]) + 1


def main_text(page: str | None, window: int = 3, least: float = 0.25, boost: int = 2) -> str:
    """The text between surges and dives of a page, a block a line.

    The text of lists of links has no length outside an article. There a line surges, and later dives, where the
    window at it passes ``ENOUGH`` text, or ``least`` of the highest window sum where that is less: so rows of short lines,
    such as menus, before and after the text go whatever they are called. A span that is not mostly links counts, and one between two
    such; each article's spans are whole and count together, with ``boost`` times their text. What is outside stays if it has the weight of the heaviest article, and an
    article if it, or all together, has half the weight of what is outside.
    """
    if not page:
        return ""
    stripped = strip(page, window)
    lines, article = stripped.lines, stripped.article
    weigh = [len(line.text) if inside or 2 * line.linked <= len(line.text) else 0 for line, inside in zip(lines, article)]
    free = [0 if inside else n for n, inside in zip(weigh, article)]
    top, top_free = (max((sum(x[i : i + window]) for i in range(len(x))), default=0) for x in (weigh, free))
    enough = min(ENOUGH, least * top_free)
    found = list(spans(np.array(weigh, dtype=np.int64), window, enough / max(top, 1), np.array(article) > 0))
    own = [sum(len(x.text) - x.linked for x in lines[a:b]) for a, b in found]
    within = [article[a] for a, _ in found]
    dense = [sum(weigh[a:b]) and 2 * n >= sum(len(x.text) for x in lines[a:b]) for n, (a, b) in zip(own, found)]
    sound = [i for i, n in enumerate(own) if not within[i] and n >= enough and dense[i]]
    outside = [i for i, n in enumerate(own) if not within[i] and dense[i] and sound and sound[0] <= i <= sound[-1]]
    around = sum(own[i] for i in outside)
    weights = {}
    for i, (a, b) in enumerate(found):
        if within[i]:
            weights[within[i]] = weights.get(within[i], 0) + boost * sum(weigh[a:b])
    kept = set(outside) if around >= max(weights.values(), default=0) else set()
    together = 2 * sum(weights.values()) >= around
    kept |= {i for i, g in enumerate(within) if g and (together or 2 * weights[g] >= around)}
    return "\n".join(x.text for i, (a, b) in enumerate(found) if i in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame, *, keep: tuple[str, ...] | None = None, window: int = 3) -> DataFrame:
    """``keep`` (all columns but ``html`` by default) with ``text`` and ``n_chars`` of every page.

    A null, empty or text-free page has the empty text. Pages are parsed whole and each alone, however long, repeated
    ones too; an empty table gives an empty table. Added columns replace those of their name.
    """
    names = [c for c in pages.columns if c != "html"] if keep is None else list(keep)

    def run(pages):
        texts = [main_text(p, window) for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_text(pages, "text string, n_chars long", run, names, column="html")
