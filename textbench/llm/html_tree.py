"""Pages as trees of block elements with text blocks as leaves.

A reader for the HTML that is found on the web: optional end tags, misnested
inline elements, unquoted attributes, raw-text elements, comments without an end.
One pass over the page; elements deeper than ``MOST_DEPTH`` open no node of their
own (their text goes to the ancestor there), so the work is linear.

A block is the text between two borders of block elements.  Inline elements join
their texts, ``<br>`` counts as white space, and white space (Unicode's) becomes
one space.  Text of ``DROPPED`` elements is no text.
"""

from __future__ import annotations

import re
from html import unescape

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no mark-up.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | set("template noscript select datalist button svg object audio video canvas head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var".split()) | (VOID - {"hr"})
#: Elements whose start ends an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements that end an open one of their kind, up to the elements that hold them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: No end tag reaches across these.
BARRIERS = {"table", "td", "th", "caption"}
HOLDERS = set("article section aside nav main header footer form body blockquote".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MOST_DEPTH = 512

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|(?<==)\"[^\"]*\"|(?<=[=\s])'[^']*'|(?<=\s)\"[^\"]*\"|[\"'])*+>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)"
                        r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _names(attributes: str) -> str:
    """What an element is called: class, id, role and property; hidden ones are 'hidden'."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.append("hidden")
        elif key not in ("aria-hidden", "style"):
            found.append(value)
    return " ".join(found)


class Page:
    """Elements in page order (``parent``, ``tag``, ``names``; the first is the page)
    and text blocks (``owner`` element, ``text``, ``linked`` characters in links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names = [-1], ["html"], [""]
        self.owner, self.text, self.linked = [], [], []
        self._parts, self._linked = [], 0
        self._stack, self._open = [("html", 0)], {}
        self._read(html)
        self._flush()

    # ------------------------------------------------------------ tokens

    def _read(self, html: str) -> None:
        at, n, closed = 0, len(html), True
        while at < n:
            tag = html.find("<", at)
            if tag < 0:
                tag = n
            if tag > at:
                self._write(html[at:tag])
            if tag == n:
                return
            after = html[tag + 1:tag + 2]
            if after in ("!", "?"):
                if html.startswith("<!--", tag):
                    end = html.find("-->", tag + 2)  # "<!-->" is a whole comment
                    if end < 0:
                        return
                    at = end + 3
                else:
                    end = html.find(">", tag)
                    if end < 0:
                        return
                    at = end + 1
                continue
            name = _NAME.match(html, tag + 1)
            if name is None:
                self._write("<")
                at = tag + 1
                continue
            found = _ATTRIBUTES.match(html, name.end()) if closed else None
            if found is None:  # no ">" follows: the rest is text
                closed = False
                self._write("<")
                at = tag + 1
                continue
            kind, at = name[1].lower(), found.end()
            if after == "/":
                self._end(kind)
            else:
                attributes = html[name.end():at - 1]
                if kind in RAW:
                    self._border(kind)
                    close = re.compile(f"</{kind}(?=[\\s/>])", re.I).search(html, at)
                    if close is None:
                        return
                    stop = html.find(">", close.end())
                    at = stop + 1 if stop >= 0 else n
                else:
                    self._start(kind, attributes)

    # ------------------------------------------------------------ text

    def _write(self, data: str) -> None:
        if self._open.get("#dropped"):
            return
        data = unescape(data) if "&" in data else data
        self._parts.append(data)
        if self._open.get("a"):
            self._linked += len(data.strip())

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                owner = next(node for _, node in reversed(self._stack) if node >= 0)
                self.owner.append(owner)
                self.text.append(text)
                self.linked.append(min(self._linked, len(text)))
            self._parts, self._linked = [], 0

    def _border(self, kind: str) -> None:
        if kind not in INLINE and kind not in ("script", "style", "title"):
            self._flush()

    # ------------------------------------------------------------ elements

    def _count(self, kind: str, by: int) -> None:
        self._open[kind] = self._open.get(kind, 0) + by
        if kind in DROPPED:
            self._open["#dropped"] = self._open.get("#dropped", 0) + by

    def _pop_to(self, place: int) -> None:
        """Closes all elements from a place of the stack on."""
        if any(node >= 0 for _, node in self._stack[place:]):
            self._flush()
        for kind, _ in self._stack[place:]:
            self._count(kind, -1)
        del self._stack[place:]

    def _up_to(self, kinds: set, stops: set) -> int:
        for place in range(len(self._stack) - 1, 0, -1):
            if self._stack[place][0] in kinds:
                return place
            if self._stack[place][0] in stops:
                return 0
        return 0

    def _start(self, kind: str, attributes: str) -> None:
        if kind in ("html", "body"):
            if self._open.get("head"):
                self._end("head")
            return
        if kind in VOID:
            if kind == "br":
                self._write(" ")
            elif kind == "hr":
                self._close_p()
                self._flush()
            return
        if kind in ENDS_P:
            self._close_p()
            if self._open.get("head"):
                self._end("head")
        if kind in SIBLINGS and any(self._open.get(k) for k in SIBLINGS[kind][0]):
            kinds, stops = SIBLINGS[kind]
            if place := self._up_to(kinds, stops | HOLDERS):
                self._pop_to(place)
        elif kind in HEADINGS and self._stack[-1][0] in HEADINGS:
            self._pop_to(len(self._stack) - 1)
        elif kind == "a" and self._open.get("a"):
            for place in range(len(self._stack) - 1, 0, -1):
                if self._stack[place][1] >= 0:
                    break
                if self._stack[place][0] == "a":
                    self._pop_to(place)
                    break
        inline = kind in INLINE or kind not in ENDS_P and kind not in SIBLINGS and kind not in DROPPED \
            and "-" not in kind and kind not in _BLOCKS
        if not inline:
            self._flush()
        if len(self._stack) >= MOST_DEPTH:
            return
        node = -1
        if not inline and kind not in DROPPED:
            node = len(self.tag)
            self.parent.append(next(x for _, x in reversed(self._stack) if x >= 0))
            self.tag.append(kind)
            self.names.append(_names(attributes) if attributes else "")
        self._stack.append((kind, node))
        self._count(kind, 1)

    def _close_p(self) -> None:
        if self._open.get("p") and (place := self._up_to({"p"}, BARRIERS)):
            self._pop_to(place)

    def _end(self, kind: str) -> None:
        if kind == "br":
            self._write(" ")
        if len(self._stack) >= MOST_DEPTH and (kind in _BLOCKS or kind in ENDS_P):
            self._flush()
        if not self._open.get(kind):
            if kind == "p":  # stands for an empty paragraph
                self._flush()
            return
        inline = kind in INLINE
        for place in range(len(self._stack) - 1, 0, -1):
            name, node = self._stack[place]
            if name == kind:
                if inline and any(x >= 0 for _, x in self._stack[place:]):
                    del self._stack[place]  # misnested: the blocks inside stay open
                    self._count(kind, -1)
                else:
                    self._pop_to(place)
                return
            if name in BARRIERS and kind not in BARRIERS and kind not in ("tr", "tbody", "thead", "tfoot"):
                return


_BLOCKS = set("caption colgroup legend optgroup option rtc tbody td tfoot th thead tr body html listing plaintext marquee "
              "frameset frame".split())
