"""From HTML to leaf blocks: a forgiving tokenizer that keeps the tag path of every run of text."""

from __future__ import annotations

import html
import re

# Elements by their part in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
UNSEEN = RAW | frozenset("noscript template select button object svg math canvas audio video map datalist noframes".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HOLDS = frozenset("ul ol dl table body article section div main td th".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def element(tag: str, attributes: str) -> str:
    """The tag followed by the parts of its class, id, role and itemprop, lower-cased."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag
    names = [tag]
    for name, value in _ATTRIBUTE.findall(attributes):
        names += [p.lower() for p in _PIECE.findall(value)] if value else [name.lower()]
    return " ".join(names)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of elements, text, characters inside links) of every non-empty block, in page order.

    A block ends where an element that is not inline begins or ends; br is white space. Character references are
    decoded after the tags are found; white space becomes one space. Comments, declarations and elements that show no
    text of the page (scripts, styles, controls) are left out up to their end tags. Such an element without an end tag
    of its own, unless it holds raw text, ends where the next block does or begins, so that it swallows no more than its
    label. Tags may be unclosed, crossed or cut off; pages may be of any length.
    """
    out: list = []
    stack: list[tuple[str, str]] = []
    buffer: list[str] = []
    linked = links = at = 0
    end = len(page)
    muted, never = False, set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((tuple(e for _, e in stack), text, linked))
            buffer.clear()
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal links
        for tag, _ in stack[place:]:
            links -= tag == "a"
        del stack[place:]

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not muted:
            buffer.append(page[at:lt])
            linked += (lt - at) * (links > 0)
        if lt == end:
            break
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            continue
        if not (follows.isalpha() or follows == "/"):
            buffer.append("<" * (not muted))
            at = lt + 1
            continue
        match = _TAG.match(page, lt)
        if match:
            closing, tag, attributes, at = match[1], match[2].lower(), match[3], match.end()
        else:  # a quote that never ends, an end tag without a name, or a cut-off tag
            close = page.find(">", lt)
            if close < 0:
                break
            at = close + 1
            names = re.match(r"</?\s*([a-zA-Z][^\s/>]*)", page[lt:at])
            if not names:
                continue
            closing, tag, attributes = "/" * (follows == "/"), names[1].lower(), ""
        if tag in UNSEEN:
            if not closing and not attributes.endswith("/"):
                mark = rf"<(/){tag}\s*>?" if tag in RAW else rf"<(/?){tag}(?![^\s/>])[^<>]*>?"
                close = None if tag in never else re.compile(mark, re.IGNORECASE).search(page, at)
                if close is None:
                    never.add(tag)
                if close is not None and close[1]:
                    at = close.end()
                elif tag in RAW:
                    at = end
                else:
                    muted = True
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            muted = False
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if tag in ENDS or tag in ENDS_P:
            also = ENDS.get(tag, frozenset())
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in also or (name == "p" and tag in ENDS_P):
                    pop_to(k)
                    break
                if name in HOLDS:
                    break
        stack.append((tag, element(tag, attributes)))
        links += tag == "a"
    flush()
    return out
