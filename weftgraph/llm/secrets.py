"""Operator 9, secret scans: fixed patterns plus assignment-aware lexing.

The base patterns give spans of kinds assign, access and hex. The lexer (see lexing) reads source and configuration syntax
into name-literal pairs. Constants are propagated through names, whether they are defined before or after their use, and
literals are scored by how sensitive the names are that they reach, and by their own strength. Text inside a literal, such
as a connection string, is read as configuration once more.

Cases: a null text is empty and has no spans; an empty table gives an empty table; repeated rows get equal results; a very
long text is read whole, in time linear in its length, also where it is one line or never closes a literal; other columns
are not read. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import map_batches, map_rows
from weftgraph.llm.lexing import Pair, pairs

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Maximal runs, so a least length in the pattern equals dropping the short matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Name parts, in the singular, and their weight in a name's sensitivity.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "credential": 0.9, "auth": 0.6, "bearer": 0.8, "signing": 0.6, "encryption": 0.6, "salt": 0.5, "key": 0.4, "cert": 0.4,
}
#: Parts that count inside a longer run of letters too, as in dbpassword.
INSIDE = tuple(x for x, w in SENSITIVE.items() if len(x) >= 6 and w >= 0.9)
#: A text or a name without any of these has no sensitive name: every part above holds one.
HINT = re.compile(r"pass|pwd|secret|token|key|cred|auth|bearer|sign|encrypt|salt|cert", re.I)
PLACEHOLDER = re.compile(r"example|changeme|change_me|placeholder|your[-_]?|dummy|sample|todo|redacted|^(.)\1*$|^[$%#]?\{|^<|^(none|null|true|false|undefined)$", re.I | re.A)
CONSTANT = re.compile(r"[A-Z0-9]+(?:_[A-Z0-9]+)+")
THRESHOLD = 0.8
#: Bits of a random literal of about ten characters, and the most that count.
BITS, MOST_BITS = 35.0, 52.5


@lru_cache(65_536)
def sensitivity(name: str) -> float:
    """The greatest weight of a name's parts, or of two neighbouring ones together."""
    if not HINT.search(name):
        return 0.0
    low = [p.lower().removesuffix("s") if len(p) > 3 else p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
    both = [a + b for a, b in zip(low, low[1:], strict=False)]
    return max([SENSITIVE.get(p, 0.0) for p in (*low, *both)] + [SENSITIVE[x] for p in low for x in INSIDE if x in p], default=0.0)


def strength(literal: str) -> tuple[float, int]:
    """Bits of entropy, and the kinds of characters as a set of bits; none for placeholders and names of constants."""
    if not literal or CONSTANT.fullmatch(literal) or PLACEHOLDER.search(literal):
        return 0.0, 0
    n = len(literal)
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    kinds = any(map(str.isdigit, literal)) | any(map(str.isupper, literal)) << 1 | any(map(str.islower, literal)) << 2 | (not literal.isalnum()) << 3
    return bits, kinds


class Values:
    """What pairs hold together, over the names in their values: a graph of pairs and names, each gone through once."""

    def __init__(self, text: str, pairs: list[Pair]):
        self.pairs = pairs
        place = {id(p): i for i, p in enumerate(pairs)}
        names: dict[str, int] = {}
        for p in pairs:
            names.setdefault(p.name, len(pairs) + len(names))
        self.own: list[list[tuple[int, int]]] = []
        self.next: list[list[int]] = []
        for p in pairs:
            to = [names[x] for x in p.names if x in names] + [place[id(x)] for x in p.inner]
            known = [names[text[s:e]] for s, e in p.bare if text[s:e] in names]
            self.own.append(p.literals + [x for x in p.bare if text[x[0] : x[1]] not in names])
            self.next.append(to + known)
        self.next += [[] for _ in names]
        for i, p in enumerate(pairs):
            self.next[names[p.name]].append(i)
        self.strengths = [[strength(text[s:e]) for s, e in own] for own in self.own]
        self.sums: list[tuple[float, int, int, bool] | None] = [None] * len(self.next)

    def held(self, root: int) -> tuple[float, int, int, bool]:
        """(bits, kinds, length, quoted) of all that a pair's value reaches; a cycle's end adds nothing."""
        stack = [(root, False)]
        while stack:
            at, done = stack.pop()
            if done:
                bits, kinds, size, quoted = 0.0, 0, 0, False
                if at < len(self.pairs):
                    quoted = self.pairs[at].quoted
                    for (s, e), (b, k) in zip(self.own[at], self.strengths[at], strict=True):
                        bits, kinds, size = bits + b, kinds | k, size + (e - s if b else 0)
                for x in self.next[at]:
                    b, k, n, q = self.sums[x] or (0.0, 0, 0, False)
                    bits, kinds, size, quoted = bits + b, kinds | k, size + n, quoted or q
                self.sums[at] = min(bits, MOST_BITS), kinds, min(size, 1 << 30), quoted
            elif self.sums[at] is None:
                self.sums[at] = (0.0, 0, 0, False)
                stack.append((at, True))
                stack += [(x, False) for x in self.next[at] if self.sums[x] is None]
        return self.sums[root]

    def score(self, at: int) -> float:
        weight = sensitivity(self.pairs[at].name)
        if not weight:
            return 0.0
        bits, kinds, size, quoted = self.held(at)
        return weight * ((bits / BITS) * (0.35 + 0.3 * kinds.bit_count()) + 0.3 * quoted) if size >= 6 else 0.0


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, value, score) of the literals that reach a sensitive name, through constants too."""
    if not HINT.search(text):
        return []
    found = pairs(text)
    for low, high in [x for p in found for x in p.literals]:
        if HINT.search(text, low, high):
            value = text[low:high]
            for p in pairs(value) if "=" in value or ":" in value else ():
                found.append(shifted(p, low))
    values = Values(text, found)
    scored = sorted(((x, i) for i in range(len(found)) if (x := values.score(i)) >= THRESHOLD), reverse=True)
    out: dict[tuple[int, int], float] = {}
    seen = [False] * len(values.next)
    for score, root in scored:
        stack = [root]
        while stack:
            at = stack.pop()
            if seen[at]:
                continue
            seen[at] = True
            stack += values.next[at]
            if at < len(found):
                for (s, e), (bits, _) in zip(values.own[at], values.strengths[at], strict=True):
                    if e > s and bits:
                        out.setdefault((s, e), score)
    return [(s, e, text[s:e], x) for (s, e), x in sorted(out.items())]


def shifted(p: Pair, by: int) -> Pair:
    """A pair of a text inside a literal; pairs inside it stand in the list on their own."""
    return Pair(p.name, [(s + by, e + by) for s, e in p.literals], [(s + by, e + by) for s, e in p.bare], quoted=p.quoted)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        at = 0
        for line in text.split("\n"):  # no match of this pattern crosses a line
            if "=" in line or ":" in line:
                out += [(at + m.start(), 0, at + m.end()) for m in ASSIGN.finditer(line) if len(m[2]) >= 6]
            at += len(line) + 1
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + [(s, 3, e) for s, e, _, _ in literals(text)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at, upto = [], 0, -1
    for s, _, e in spans:
        if s >= upto:
            out += [text[at:s], mask]
        at = upto = max(upto, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and what each document holds by kind."""
    def make():
        def one(doc_id, text):
            base, spans = all_spans(text or "")
            n = Counter(k for _, k, _ in spans)
            return doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]

        return one

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def mask(docs: DataFrame) -> DataFrame:
    """Whole rows with every span in text replaced by a mask, and n_chars (if there is one) counted anew."""
    text = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        def clean(batch):
            old = batch.column(text).to_pylist()
            new = [t and redact(t, all_spans(t)[1]) for t in old]
            columns = list(batch.columns)
            columns[text] = pa.array(new, columns[text].type)
            if chars is not None:
                sizes = [n if t == u or u is None else len(u) for n, t, u in zip(columns[chars].to_pylist(), old, new, strict=True)]
                columns[chars] = pa.array(sizes, columns[chars].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return clean

    return map_batches(docs, make)
