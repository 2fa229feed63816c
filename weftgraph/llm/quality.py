"""Operator 1, quality rules: line-first cleaning.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing lines are removed, and a document
that loses too large a share of its word characters is rejected.

Cases: a null text has no words and fails the base rule; blank lines are neither judged nor counted; repeated rows are
judged alike; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftgraph.llm.common import map_rows, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
SENTENCE_END = re.compile(r"[.!?] ")
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    """What the line rules and the final verdict compare with; every value is a production parameter."""

    terminal: str = ".!?:;\"')]}…”’»。！？"
    paragraph_words: int = 20
    max_punctuation: float = 0.25
    separators: str = "|»›•·>"
    max_separators: int = 2
    nav_words: tuple[str, ...] = ("home", "menu", "login", "logout", "register", "search", "contact", "about", "sitemap", "next", "previous", "share", "tweet", "subscribe", "faq", "help")
    nav_line_words: int = 12
    boilerplate: tuple[str, ...] = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "copyright ©", "lorem ipsum", "enable javascript", "click here", "powered by")
    max_lost: float = 0.3
    min_words: int = 50


@dataclass
class Verdict:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = True
    kept: bool = False
    lost_chars: int = 0
    failed: Counter = field(default_factory=Counter)
    text: str = ""


def line_failure(line: str, rules: LineRules) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation or boilerplate; None if it passes.

    A line has to end a sentence, or be a paragraph that has ended one before it breaks off.
    """
    bare = line.strip(SPACE)
    tokens = bare.encode().split()
    chars = len(bare) - sum(map(bare.count, SPACE))
    ended = bare[-1] in rules.terminal or (len(tokens) >= rules.paragraph_words and SENTENCE_END.search(bare))
    if not ended or len(PUNCTUATION.findall(bare)) > rules.max_punctuation * chars:
        return "punctuation"
    if sum(map(bare.count, rules.separators)) >= rules.max_separators:
        return "navigation"
    low = bare.lower()
    if len(tokens) <= rules.nav_line_words:
        names = sum(w.strip(b".,:;!?()[]").decode() in rules.nav_words for w in low.encode().split())
        if 2 * names >= len(tokens) and names:
            return "navigation"
    if any(phrase in low for phrase in rules.boilerplate):
        return "boilerplate"
    return None


def judge(text: str | None, rules: LineRules = LineRules()) -> Verdict:
    """All counts, the verdict and the cleaned text of one whole text."""
    out = Verdict()
    if not text:
        return out
    tokens = words(text)
    n = out.n_words = len(tokens)
    out.word_chars = len(text) - sum(map(text.count, SPACE))
    out.n_symbols = len(SYMBOLS.findall(text))
    seen: set[str] = set()
    kept: list[str] = []
    for line in text.split("\n"):
        if not line.strip(SPACE):
            kept.append(line)
            continue
        if line in seen:
            out.n_dup_lines += 1
        seen.add(line)
        why = line_failure(line, rules)
        if why:
            out.failed[why] += 1
            out.lost_chars += len(line) - sum(map(line.count, SPACE))
        else:
            kept.append(line)
    windows = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
    counts = Counter(windows)
    if len(counts) < len(windows):
        end = 0
        for at, window in enumerate(windows):
            if counts[window] > 1:
                out.n_repeat_words += at + 3 - max(at, end)
                end = at + 3
    out.base_failed = n < rules.min_words or 100 * out.n_repeat_words > 50 * n
    out.kept = not out.base_failed and out.lost_chars <= rules.max_lost * out.word_chars
    out.text = "\n".join(kept)
    return out


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """doc_id, counts, removed lines by rule, base_failed, kept and (if asked) the cleaned text of every document."""

    def make():
        def one(doc_id, text):
            v = judge(text, rules)
            row = (doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, v.kept, v.lost_chars, v.failed["punctuation"], v.failed["navigation"], v.failed["boilerplate"])
            return (*row, v.text) if with_text else row

        return one

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, n_punctuation long, n_navigation long, n_boilerplate long"
    return map_rows(docs.select("doc_id", "text"), make, schema + ", clean_text string" * with_text)
