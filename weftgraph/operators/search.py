"""Full-text and vector search.

A query's terms are known when it is planned, so scoring doesn't depend on an inverted index: without one, term counts are
folds over each text's tokens and document frequencies one aggregate. Where CREATE FULLTEXT INDEX has made one (see textindex),
counts come from the postings of the query's terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vector import METRICS, doubles

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_GAP), lambda t: t != "")


@dataclass
class Node:
    """A query: term, phrase, prefix, wildcard, fuzzy, range, or a boolean of others."""

    kind: str
    text: str = ""
    column: str | None = None
    distance: int = 1
    low: str | None = None
    high: str | None = None
    must: list[Node] = field(default_factory=list)
    should: list[Node] = field(default_factory=list)
    must_not: list[Node] = field(default_factory=list)


PIECE = re.compile(
    r"""\s*(?:(?P<paren>[()])|(?P<bool>AND|OR|NOT)\b|(?P<sign>[-+])?(?:(?P<field>\w+):)?(?:\[(?P<low>\S+)\ TO\ (?P<high>\S+)\]|"(?P<phrase>[^"]*)"|'(?P<single>[^']*)'|(?P<word>[^\s()"']+)))""",
    re.X,
)


def parse(text: str) -> Node:
    """Terms are alternatives unless joined by AND; + and - mark required and forbidden ones."""
    pieces, at = [], 0
    while at < len(text.rstrip()):
        m = PIECE.match(text, at)
        if not m:
            raise ValueError(f"bad search text at {at}")
        pieces.append(m)
        at = m.end()

    def leaf(m: re.Match) -> Node:
        if m["low"] is not None:
            return Node("range", column=m["field"], low=m["low"], high=m["high"])
        if m["phrase"] is not None:
            return Node("phrase", m["phrase"], m["field"])
        word = m["single"] if m["single"] is not None else m["word"]
        if " " in word.strip():
            return Node("phrase", word, m["field"])
        fuzzy = re.fullmatch(r"(.+)~(\d*)", word)
        if fuzzy:
            return Node("fuzzy", fuzzy[1].lower(), m["field"], int(fuzzy[2] or 1))
        if re.fullmatch(r"[^*?]+\*", word):
            return Node("prefix", word[:-1].lower(), m["field"])
        if "*" in word or "?" in word:
            return Node("wildcard", word.lower(), m["field"])
        return Node("term", word.lower(), m["field"])

    def group(i: int) -> tuple[Node, int]:
        out, joined, negate = Node("bool"), "OR", False
        while i < len(pieces) and pieces[i]["paren"] != ")":
            m = pieces[i]
            if m["bool"]:
                if m["bool"] == "NOT":
                    negate = True
                else:
                    joined = m["bool"]
                    if joined == "AND" and out.should:
                        out.must.append(out.should.pop())
                i += 1
                continue
            if m["paren"] == "(":
                node, i = group(i + 1)
            else:
                node = leaf(m)
            i += 1
            if negate or m["sign"] == "-":
                out.must_not.append(node)
            elif joined == "AND" or m["sign"] == "+":
                out.must.append(node)
            else:
                out.should.append(node)
            joined, negate = "OR", False
        return out, i

    return group(0)[0]


def leaves(n: Node) -> list[Node]:
    return [x for c in (*n.must, *n.should) for x in leaves(c)] if n.kind == "bool" else [n]


def words_of(phrase: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+", phrase.lower()) if w]


def like(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)


class Searcher:
    """Plans one query over the text columns of a table."""

    def __init__(self, df: DataFrame, columns: list[str], query: Node | str, k1: float = 1.2, b: float = 0.75):
        self.df, self.columns, self.k1, self.b = df, columns, k1, b
        self.query = parse(query) if isinstance(query, str) else query

    def targets(self, n: Node) -> list[str]:
        return [n.column] if n.column else self.columns

    def count(self, n: Node, column: str) -> Column:
        """How often a leaf occurs in the tokens of a column."""
        t = F.col(f"__t_{column}")
        if n.kind == "phrase":
            words = words_of(n.text)
            # Shifted copies side by side: a lambda that reached for the token array itself would compute it anew at each position.
            shifted = F.arrays_zip(*[F.slice(t, F.lit(i + 1), F.size(t)).alias(f"w{i}") for i in range(len(words))])

            def here(s: Column) -> Column:
                out = F.lit(True)
                for i, w in enumerate(words):
                    out = out & s[f"w{i}"].eqNullSafe(F.lit(w))
                return out

            return F.size(F.filter(shifted, here))
        tests = {
            "term": lambda x: x == n.text,
            "prefix": lambda x: F.startswith(x, F.lit(n.text)),
            "wildcard": lambda x: F.regexp_like(x, F.lit(f"^{like(n.text)}$")),
            "fuzzy": lambda x: F.levenshtein(x, F.lit(n.text)) <= n.distance,
        }
        return F.size(F.filter(t, tests[n.kind]))

    def matches(self, n: Node, names: dict[int, str]) -> Column:
        if n.kind == "range":
            c = F.col(n.column)
            return (F.lit(True) if n.low == "*" else c >= n.low) & (F.lit(True) if n.high == "*" else c <= n.high)
        if n.kind != "bool":
            out = F.lit(False)
            for c in self.targets(n):
                out = out | (F.col(f"{names[id(n)]}_{c}") > 0)
            return out
        out = F.lit(True)
        for c in n.must:
            out = out & self.matches(c, names)
        if n.should and not n.must:
            some = F.lit(False)
            for c in n.should:
                some = some | self.matches(c, names)
            out = out & some
        for c in n.must_not:
            out = out & ~self.matches(c, names)
        return out

    def every(self, n: Node) -> list[Node]:
        return [x for c in (*n.must, *n.should, *n.must_not) for x in self.every(c)] if n.kind == "bool" else [n]

    def plan(self) -> tuple[list[Node], list[Node], dict[int, str], list[str]]:
        """All leaves with terms, those that count for the score, the names of their counts, and the columns they look at."""
        every = [n for n in self.every(self.query) if n.kind != "range"]
        scored = [n for n in leaves(self.query) if n.kind != "range"]
        used = sorted({c for n in every for c in self.targets(n)}) or self.columns
        return every, scored, {id(n): f"__n{i}" for i, n in enumerate(every)}, used

    def run(self) -> DataFrame:
        """Matching rows with ``__score`` (BM25 over all leaves that may match), ``__fields`` (columns with a hit) and the score of each column."""
        all_leaves, scored, names, used = self.plan()
        df = self.df.withColumns({f"__t_{c}": tokens(F.col(c)) for c in used})
        # One projection computes the tokens, the next folds over them.
        df = df.withColumns({f"{names[id(n)]}_{c}": self.count(n, c) for n in all_leaves for c in self.targets(n)} | {f"__len_{c}": F.size(f"__t_{c}") for c in used})
        stats = [F.count(F.lit(1)).alias("n"), *[F.avg(f"__len_{c}").alias(f"a_{c}") for c in used]]
        stats += [F.count(F.when(F.col(f"{names[id(n)]}_{c}") > 0, 1)).alias(f"d{names[id(n)]}_{c}") for n in scored for c in self.targets(n)]
        total = df.agg(*stats).first().asDict()
        return self.scored(df, scored, names, used, {k: F.lit(v if not k.startswith("a_") else v or 1.0) for k, v in total.items()})

    def scored(self, df: DataFrame, scored: list[Node], names: dict[int, str], used: list[str], total: dict[str, Column]) -> DataFrame:
        """Matching rows and their scores, from counts and lengths by column and the totals over all rows."""
        parts = {c: F.lit(0.0) for c in used}
        for n in scored:
            for c in self.targets(n):
                tf, have = F.col(f"{names[id(n)]}_{c}").cast("double"), total[f"d{names[id(n)]}_{c}"]
                idf = F.log1p((total["n"] - have + 0.5) / (have + 0.5))
                norm = self.k1 * (1 - self.b + self.b * F.col(f"__len_{c}") / total[f"a_{c}"])
                parts[c] = parts[c] + idf * tf * (self.k1 + 1) / (tf + norm)
        score = sum(parts.values(), F.lit(0.0))
        hits = [F.when(F.greatest(F.lit(0), *[F.col(f"{names[id(n)]}_{c}") for n in scored if c in self.targets(n)]) > 0, F.lit(c)) for c in used if any(c in self.targets(n) for n in scored)]
        fields = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
        by = F.create_map(*[x for c, v in parts.items() for x in (F.lit(c), v)])
        return df.where(self.matches(self.query, names)).select(*self.df.columns, score.alias("__score"), fields.alias("__fields"), by.alias("__scores"))

    def terms(self) -> list[str]:
        out: list[str] = []
        for n in leaves(self.query):
            if n.kind == "phrase":
                out += [re.escape(w) for w in re.split(r"[^\w]+", n.text) if w]
            elif n.kind == "term":
                out.append(re.escape(n.text))
            elif n.kind == "prefix":
                out.append(re.escape(n.text) + r"[\p{L}\p{N}]*")
            elif n.kind == "wildcard":
                out.append(like(n.text).replace(".*", r"[\p{L}\p{N}]*"))
        return out

    def highlight(self, text: Column, before: str = "<em>", after: str = "</em>", size: int = 100) -> Column:
        """A fragment of ``size`` characters from just before the first hit on, its hits marked."""
        terms = self.terms()
        if not terms:
            return F.substring(text, 1, size)
        pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(terms) + r")(?![\p{L}\p{N}])"
        at = F.regexp_instr(text, F.lit(pattern))
        fragment = F.substring(text, F.greatest(at - size // 4, F.lit(1)), F.lit(size))
        return F.regexp_replace(fragment, pattern, before + "$1" + after)

    def snippet(self, text: Column, size: int = 200) -> Column:
        """The first ``size`` characters, cut at the last blank."""
        cut = F.substring(text, 1, size)
        return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(cut, r"\s+\S*$", ""))


def vector_search(df: DataFrame, column: str, query: Column, metric: str = "COSINE", threshold: float | None = None) -> DataFrame:
    """All rows with ``score``, nearest first when ordered by :func:`nearest_first`; a threshold drops those farther away."""
    fn, larger = METRICS[metric.upper()]
    out = df.withColumn("score", fn(doubles(F.col(column)), query))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold if larger else F.col("score") <= threshold)
    return out


def nearest_first(metric: str) -> Column:
    return F.col("score").desc() if METRICS[metric.upper()][1] else F.col("score").asc()
