"""A small HTML reader: the block elements of a page as a tree, and the text runs they own.

Tolerant in the usual ways: unclosed and unopened tags, implied ends of p, li, td and the
like, attributes with or without quotes, comments, raw text elements. Inline elements
(a, b, span ...) are not nodes; their text belongs to the block around them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements whose content is raw text up to their own end tag, and no text of the page.
RAW = {"script", "style", "template", "textarea", "title", "iframe"}
#: Elements with content that a page shows as drawing or form control, or not at all; one without an
#: end tag ends with the element around it.
NO_TEXT = {"svg", "select", "datalist", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img", "br", "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac",
          "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mfenced"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag of the key ends an open element of the value (up to the nearest container).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
NO_BLOCK_IN_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl",
                 "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
                 "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_STOPS = {"ul", "ol", "table", "div", "section", "article", "dl", "body", "main", "aside", "nav"}


@dataclass
class Node:
    tag: str
    marks: str            # class, id and role, lower case
    parent: int
    hidden: bool = False
    gold: str | None = None
    no_text: bool = False
    chars: int = 0        # text of its own runs
    link_chars: int = 0   # ... inside links
    points: int = 0       # sentence marks in them


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, normalised text) in page order


def parse(html: str) -> Page:
    """Tree and runs of a page. Node 0 is the root."""
    page = Page([Node("#root", "", -1)])
    nodes, open_ids, open_tags = page.nodes, [0], ["#root"]
    links = 0
    pending: list[str] = []
    pending_link = 0

    def flush():
        nonlocal pending_link
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text and not nodes[open_ids[-1]].no_text:
                node = nodes[open_ids[-1]]
                page.runs.append((open_ids[-1], text))
                node.chars += len(text)
                node.link_chars += min(pending_link, len(text))
                node.points += sum(map(text.count, ".?!,;"))
            pending_link = 0

    def close(upto: int):
        flush()
        del open_ids[upto:], open_tags[upto:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        start = m.start() if m else n
        if start > at:
            text = unescape(html[at:start])
            pending.append(text)
            if links:
                pending_link += len(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue  # comment or declaration
        name = name.lower()
        if m[1] or m[4]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "p" and "p" not in open_tags:
                flush()
            elif name not in INLINE:
                for i in range(len(open_tags) - 1, 0, -1):
                    if open_tags[i] == name:
                        close(i)
                        break
            continue
        if name == "br":
            pending.append(" ")
            continue
        if name == "a":
            links += 1
        if name in INLINE:
            continue
        attrs = m[3] or m[6] or ""
        if name in RAW and not attrs.rstrip().endswith("/"):
            flush()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in NO_BLOCK_IN_P and "p" in open_tags:
            close(len(open_tags) - 1 - open_tags[::-1].index("p"))
        elif name in ENDS:
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i] in ENDS[name]:
                    close(i)
                    break
                if open_tags[i] in _STOPS:
                    break
        flush()
        if name in VOID or name in NO_TEXT and attrs.rstrip().endswith("/"):
            continue
        marks, hidden, gold = "", False, None
        if attrs and not attrs.isspace():
            for key, *values in _ATTR.findall(attrs):
                key, value = key.lower(), values[0] or values[1] or values[2]
                if key in ("class", "id", "role", "aria-label"):
                    marks += " " + value.lower()
                elif key == "data-gold":
                    gold = value
                elif key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
        nodes.append(Node(name, marks, open_ids[-1], hidden, gold, name in NO_TEXT or nodes[open_ids[-1]].no_text))
        open_ids.append(len(nodes) - 1)
        open_tags.append(name)
        links = 0
    flush()
    return page
