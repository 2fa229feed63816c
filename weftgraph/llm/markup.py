"""Title, links and visible text of an HTML page, read in one forward pass.

Time is linear in the page: a tag, a quoted value, a comment or a script that is never closed takes the rest of the page.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

#: A tag's name and attributes; a > inside a quoted value doesn't end it.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"?|'[^']*+'?)?+)*+)>?""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
#: Elements that end a line of text.
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 nav header footer article section title head body html blockquote pre hr dt dd dl form option".split())
LINKS = frozenset("a link area img script iframe source".split())
#: Elements whose content is no visible text; unclosed, the first two take the rest of the page.
UNSEEN = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "noscript", "template", "title")}
#: Numbers of characters that no character has; leading zeros.
HUGE = re.compile(r"&#(?:0*+[1-9]\d{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")


def plain(text: str) -> str:
    """Character references decoded."""
    if "&#" in text:
        text = ZEROS.sub(r"\1", HUGE.sub("�", text))
    return unescape(text)


def read(html: str, url: str) -> tuple[str, str, list[dict]]:
    """(title, text, links): links as path and URL, resolved against ``url``; text with block elements on lines of their own."""
    title, pieces, links = None, [], []
    none_left: set[str] = set()
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            pieces.append(html[at:])
            break
        pieces.append(html[at:lt])
        m = TAG.match(html, lt)
        if not m:
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
                pieces.append(" ")
            elif html[lt + 1 : lt + 2] in ("!", "?"):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
                pieces.append(" ")
            else:
                pieces.append("<")
                at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        pieces.append("\n" if name in BREAKS else " ")
        if m[1]:
            continue
        if name in LINKS:
            for a in ATTRIBUTE.finditer(m[3]):
                attribute = a[1].lower()
                if attribute in ("href", "src"):
                    links.append({"path": f"{name.upper()}@/{attribute}", "url": resolved(url, a[2] or a[3] or a[4] or "")})
                    break
        if name in UNSEEN and name not in none_left:
            shut = UNSEEN[name].search(html, at)
            if shut:
                if name == "title":
                    title = html[at : shut.start()] if title is None else title
                    pieces.append(html[at : shut.start()])
                at = shut.start()
            elif name in ("script", "style"):
                break
            else:
                none_left.add(name)
    lines = (" ".join(line.split()) for line in plain("".join(pieces)).split("\n"))
    return " ".join(plain(title or "").split()), "\n".join(line for line in lines if line), links


def resolved(url: str, target: str) -> str:
    target = plain(target).strip()
    try:
        return urljoin(url, target)
    except ValueError:
        return target
