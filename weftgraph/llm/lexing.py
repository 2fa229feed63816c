"""Reads source and configuration text into name-literal pairs; the secret scans score them.

One forward pass cuts a text into names, literals of all forms (quoted, prefixed, triple-quoted, backtick, block scalars,
bare values), operators, brackets and markup. A pattern takes what it has read also where a literal is never closed, so
the time is linear in the text. The value of a pair is all that its expression holds: literals, names, and the pairs that
calls (``f("x")``), annotations (``a: str = "x"``) and chained assignments make. A key inside it is a pair of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""
      (?P<space>[ \t\r\f\v]++|\\\r?\n)
    | (?P<line>\n)
    | (?P<literal>
          (?:(?<!\w)[rRbBuUfFL$@]{1,2})?\"\"\"(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:\"\"\")?
        | (?:(?<!\w)[rRbBuUfFL$@]{1,2})?\'\'\'(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:\'\'\')?
        | (?:(?<!\w)[rRbBuUfFL$@]{1,2}|(?<![\d)\]]))"(?:[^"\\\n]++|\\.)*+"?
        | (?:(?<!\w)[rRbBuUfFL$@]{1,2}|(?<![\w)\]]))'(?:[^'\\\n]++|\\.)*+'?
        | `(?:[^`\\]++|\\[\s\S])*+`?)
    | (?P<define>\#[ \t]*+define[ \t]++\w++)
    | (?P<flag>(?<![\w-])--[A-Za-z][\w-]*+)
    | (?P<tag><[A-Za-z][\w:.\-]*+(?=[^<>]*+>))
    | (?P<close></[A-Za-z][\w:.\-]*+[ \t]*+>?)
    | (?P<name>[A-Za-z_$][\w$]*+(?:(?:[.\-]|::|->)[A-Za-z_$][\w$]*+)*+)
    | (?P<compare>===?|!==?|[<>]=(?!>))
    | (?P<assign>:=|=>|<-|\?\?=|\|\|=|[?+.]?=|:(?!:))
    | (?P<join>\|\||&&|\?\?|\.\.|[+.?|&])
    | (?P<open>[(\[{])
    | (?P<shut>[)\]}])
    | (?P<end>[,;])
    | (?P<word>[^\s"'`,;(){}\[\]<>=:+.?|&$A-Za-z_#!-]++)
    | (?P<rest>[\s\S])
    """,
    re.X | re.A,
)
QUOTES = re.compile(r"\"\"\"|'''|[\"'`]")
#: What a bare value may hold: no blanks, quotes, brackets or separators.
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=]++=*+(?![^\s"'`,;(){}\[\]<>])""")
#: Bare values that are names, numbers or operators of an expression.
EXPRESSION = re.compile(r"[A-Za-z_$+.:?!&|*/=\-]*+|[+-]?[\d.]+", re.A)
BLOCK = re.compile(r"[ \t]*+[|>][+\-\d]{0,2}[ \t]*+\r?\n")
BLANKS = re.compile(r"[ \t]*+")
BODY = re.compile(r"[^<>]*+>([^<]++)</([A-Za-z][\w:.\-]*+)")
ATTRIBUTE = re.compile(r"""([\w:.\-]++)\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)')""")
SUBSCRIPT = re.compile(r"""\[\s*+["']([\w.\-]++)["']\s*+\]""")
KEY = re.compile(r"[A-Za-z_$@][\w$.\- ]*+", re.A)
#: What follows a name that is part of an expression.
CALLED = frozenset("\"'`([")
#: Calls whose first literal names what they look up.
LOOKUPS = frozenset("getenv environ env get lookup input prompt getpass read open load find fetch var param property config".split())


@dataclass(slots=True)
class Pair:
    """A name, and what its value holds: literals (start, end), names, and pairs inside the expression."""

    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    #: Bare values, which are names if the text defines them.
    bare: list[tuple[int, int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    inner: list[Pair] = field(default_factory=list)
    quoted: bool = False


@dataclass(slots=True)
class Frame:
    """An open bracket: the pair that is being read in it, and the pair that gets what belongs to no key."""

    bracket: str = ""
    owner: Pair | None = None
    pair: Pair | None = None
    choice: bool = False  # a ? has been read, so a : separates
    skip: int = 0  # literals to leave out: a lookup's name

    def reader(self) -> Pair | None:
        return self.pair or self.owner


def within(token: str, start: int) -> tuple[int, int]:
    """Where the characters of a literal token lie between its quotes, closed or not."""
    quote = QUOTES.search(token)
    low, mark = quote.end(), quote[0]
    high = len(token)
    if high - low >= len(mark) and token.endswith(mark):
        before = high - len(mark)
        slashes = before - len(token[:before].rstrip("\\"))
        if slashes % 2 == 0 or before - slashes < low:
            high = before
    return start + low, start + max(low, high)


def pairs(text: str) -> list[Pair]:
    """All pairs of a text, in the order in which they begin."""
    out: list[Pair] = []
    frames = [Frame()]
    key: str | None = None
    last, at, end, judged = "line", 0, len(text), 0
    before = ""  # what stands before the key

    def begin(name: str) -> Pair:
        """A pair in the open frame; one that is being read there holds it if its name begins that one's value."""
        pair, top = Pair(name), frames[-1]
        if top.pair and before in ("assign", "name"):
            top.pair.inner.append(pair)
        out.append(pair)
        top.pair = pair
        return pair

    def bare(at: int, pair: Pair) -> int:
        """Add the bare value that may begin after blanks to a pair; the place after it, or where it would begin."""
        nonlocal judged
        at = BLANKS.match(text, at).end()
        if at < judged:  # inside a run that was found to be an expression, and so all of its ends are
            return at
        m = BARE.match(text, at)
        if not m:
            return at
        if EXPRESSION.fullmatch(m[0]):
            judged = m.end()
            return at
        high = at + len(m[0].rstrip(".,;:!?"))
        if high == at or text[m.end() : m.end() + 1] in CALLED:
            return at
        pair.bare.append((at, high))
        return m.end()

    def ahead(at: int) -> str:
        """The operator after blanks, '' if none assigns."""
        at = BLANKS.match(text, at).end()
        m = TOKEN.match(text, at) if text[at : at + 1] in (":", "=", "<", "?", "+", "|", ".") else None
        return m[0] if m and m.lastgroup == "assign" else ""

    while at < end:
        m = TOKEN.match(text, at)
        kind, start, token, at = m.lastgroup, at, m[0], m.end()
        top = frames[-1]
        if kind == "space":
            continue
        follows, last = last, kind
        if kind == "literal":
            low, high = within(token, start)
            operator = ahead(at)
            if operator and not (operator == ":" and top.choice) and KEY.fullmatch(text, low, high):
                key, before = text[low:high], follows
            else:
                key = None
                if top.skip:
                    top.skip -= 1
                elif reader := top.reader():
                    reader.literals.append((low, high))
                    reader.quoted = True
        elif kind in ("name", "define", "flag"):
            before = follows
            key = token.lstrip("#- \t").removeprefix("define").strip() if kind != "name" else token
            if kind == "define":
                top.pair = None
                begin(key)
            elif kind == "flag":
                first = BLANKS.match(text, at).end()
                if first > at and first < end and text[first] not in "-=\n":
                    top.pair = None
                    at = bare(first, begin(key))
            elif (reader := top.reader()) and not ahead(at):
                reader.names.append(token)
        elif kind == "assign":
            if token == ":" and top.choice:
                top.choice = False
            elif key is not None and not (token == ":" and text.startswith("//", at)):
                pair = begin(key)
                block = BLOCK.match(text, at) if token == ":" else None
                if block:
                    at = block_scalar(text, start, block.end(), pair)
                    top.pair, last = None, "line"
                else:
                    at = bare(at, pair)
            key = None
        elif kind == "open":
            sub = SUBSCRIPT.match(text, start) if token == "[" and follows == "name" and key else None
            if sub and ahead(sub.end()):
                key, at, last = f"{key}.{sub[1]}", sub.end(), "name"
                continue
            frame = Frame(token, top.reader())
            if token == "(" and follows == "name" and key:
                call = Pair(key)
                if frame.owner:
                    frame.owner.inner.append(call)
                out.append(call)
                frame.owner = call
                frame.skip = re.split(r"[.:>_\-]", key.lower())[-1] in LOOKUPS
            elif token == "[" and follows in ("name", "shut"):
                frame.skip = end  # a subscript is no value
            frames.append(frame)
            key = None
        elif kind == "shut":
            if len(frames) > 1:
                frames.pop()
            key = None
        elif kind == "end":
            if token == ";" or top.bracket or follows != "literal":
                top.pair, top.choice = None, False
            key = None
        elif kind == "line":
            if follows == "join" and top.pair:
                last = "join"
            elif top.bracket in ("", "{"):
                top.pair, top.choice = None, False
            key = None
        elif kind == "tag":
            out += markup(text, token[1:], at)
            key = None
        else:
            if token == "?":
                top.choice = True
            key = None
    return out


def block_scalar(text: str, colon: int, at: int, pair: Pair) -> int:
    """The lines after ``key: |`` that are indented more than the key; the place after them."""
    line = text.rfind("\n", 0, colon) + 1 if colon else 0
    indent = BLANKS.match(text, line).end() - line
    first, stop = -1, at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        own = BLANKS.match(text, at).end()
        if text[own:end].strip():
            if own - at <= indent:
                break
            first, stop = own if first < 0 else first, end
        at = end + 1
    if first >= 0:
        pair.literals.append((first, stop))
        pair.quoted = True
    return min(at, len(text))


def markup(text: str, name: str, at: int) -> list[Pair]:
    """An element's text as a pair with its name, and its value attribute as one with its key or name attribute."""
    out = []
    body = BODY.match(text, at)
    if body and body[2] == name and (inside := body[1].strip()):
        low = body.start(1) + body[1].index(inside[0])
        out.append(Pair(name.rpartition(":")[2], [(low, low + len(inside))], quoted=True))
    head = text[at : text.index(">", at)]
    found = {m[1].lower(): (at + m.start(m.lastindex), at + m.end(m.lastindex)) for m in ATTRIBUTE.finditer(head)}
    named = found.get("key") or found.get("name")
    if named and "value" in found and text[named[0] : named[1]]:
        out.append(Pair(text[named[0] : named[1]], [found["value"]], quoted=True))
    return out
