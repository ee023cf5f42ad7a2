"""HTML into text blocks: the leaf sequence of a page, each leaf with its tag path."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that begin and end a block of text; all others run on inside one.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg canvas audio video".split())
#: Of these, the ones that hold no elements: without an end tag they go on to the end of the page.
RAW = frozenset("script style".split())
#: Elements that can stand in a head; any other start tag ends it, and so does text.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these kinds, as far up as the nearest of the limits.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
LIMITS = frozenset("ul ol dl table select div section article body".split())
SPACE = " \t\n\f\r"
#: The inside of a tag up to its >: a quote opens a value only right after a =, and is an ordinary character elsewhere.
_INSIDE = re.compile(r"""(?:[^=>]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>]*+))*+>""")
_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_RAW_END = {name: re.compile(rf"</{name}[ \t\n\f\r/>]", re.I) for name in ("script", "style")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r"'>]++))""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of a tag path that a block keeps, the innermost ones; texts are kept at any depth.
PATH_PARTS = 64
#: So many tags may run to the end of the page with an open quote; from then on quotes count for nothing.
LOST_TAGS = 3


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int = 0
    parts: list[str] = field(default_factory=list)


def name_parts(attributes: str) -> list[str]:
    """The words of an element's class, id and role: `class="sideBar ad-box"` gives side, bar, ad, box."""
    found: list[str] = []
    if "=" not in attributes:
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        found += [p.lower() for p in _NAME_PART.findall(m[2] or m[3] or m[4] or "")]
    return found


@dataclass(slots=True)
class Tag:
    start: int
    end: int
    closing: bool
    name: str
    inside: str
    #: Where the element ends that this tag begins: after its end tag; none for one that has no end tag.
    element_end: int | None = None


def tags_of(page: str) -> list[Tag]:
    """The tags of a page in order, without those in comments and in scripts and styles. Time is linear in the page.

    A < without a letter, /, ! or ? after it is text, and so is a tag that never ends. A tag whose quote is never closed
    ends at the next >.
    """
    out: list[Tag] = []
    at, lost = 0, 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            out.append(Tag(start, close + 3 if close >= 0 else len(page), False, "", ""))
            at = out[-1].end
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if not name:
            if page[at : at + 1] in ("!", "?", "/") and at < len(page):
                if (close := page.find(">", at)) < 0:
                    break
                out.append(Tag(start, close + 1, False, "", ""))
                at = close + 1
            continue
        inside = _INSIDE.match(page, name.end()) if lost < LOST_TAGS else None
        end = inside.end() if inside else page.find(">", name.end()) + 1
        lost += inside is None
        if not end:
            break
        tag = Tag(start, end, closing, name[0].lower(), page[name.end() : end - 1])
        out.append(tag)
        at = end
        if not closing and tag.name in RAW and not tag.inside.endswith("/"):
            close = _RAW_END[tag.name].search(page, at)
            over = page.find(">", close.end() - 1) if close else -1
            at = tag.element_end = over + 1 if over >= 0 else len(page)
    begun: dict[str, list[Tag]] = {}
    for tag in out:
        if tag.name and tag.name not in RAW and not tag.inside.endswith("/"):
            if not tag.closing:
                begun.setdefault(tag.name, []).append(tag)
            elif begun.get(tag.name):
                begun[tag.name].pop().element_end = tag.end
    return out


def blocks_of(page: str) -> list[Block]:
    """Every leaf of the page with some text, in page order; character references decoded, white space made one space.

    What pictures, players and embedded objects hold (their fallback text too) is no text of the page; the sentence that
    they stand in goes on after them.
    """
    out: list[Block] = []
    #: Open blocks with their tag paths, and how many of each name are open.
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_names: Counter = Counter()
    run: list[str] = []
    linked, in_link, in_head = 0, False, False

    def flush() -> None:
        nonlocal linked
        if not run:
            return
        text = " ".join("".join(run).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else (), linked))
        run.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if in_link:
                linked += len(text)

    def leave(depth: int) -> None:
        for name, _ in stack[depth:]:
            open_names[name] -= 1
        del stack[depth:]

    at = 0
    for tag in tags_of(page):
        if tag.start < at:
            continue
        before, name = page[at : tag.start], tag.name
        in_head = in_head and not before.strip()
        add(before)
        at = tag.end
        if not name:
            continue
        if tag.closing:
            in_head = in_head and name not in ("head", "body", "html", "br")
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                flush()
                if open_names[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    leave(depth)
            continue
        in_head = in_head and name in IN_HEAD
        if name == "head":
            flush()
            in_head = True
        elif in_head and name in ("title", "noframes"):
            end = tag.element_end or page.find("<", at)
            at = end if end >= 0 else len(page)
        elif name in SILENT:
            at = tag.element_end or at
        elif name == "br":
            run.append(" ")
        elif name == "a":
            in_link = True
        elif name in BLOCKS:
            flush()
            if name in VOID:
                continue
            closed = CLOSES.get(name, ())
            if any(open_names[n] for n in closed):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in closed:
                        leave(depth)
                        break
                    if stack[depth][0] in LIMITS:
                        break
            own = (f"<{name}>", *name_parts(tag.inside))
            stack.append((name, ((stack[-1][1] if stack else ()) + own)[-PATH_PARTS:]))
            open_names[name] += 1
    add(page[at:])
    flush()
    return out
