"""License scans: an Aho-Corasick automaton over words, and a shunting-yard parser of license expressions.

A text is brought to lower-case words separated by single spaces; the automaton finds
notice phrases and identifier tags in it in one walk. Behind a tag, the expression is
read from the raw text, turned to postfix order by operator precedence (with, and, or)
and evaluated to the sets of licenses that would satisfy it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._util import read, sliced

#: The phrases of the contract with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Words of an identifier tag.
TAGS = ("spdx license identifier", "license identifier", "license expression")
#: Confidence of one place: a tag's expression, a contract phrase, another notice.
STRENGTH = {"tag": 0.95, "base": 0.9, "notice": 0.6}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG = re.compile(r"(?i)(?:spdx[-\s]*)?licen[sc]e[-\s]*(?:identifier|expression)\s*[:=]\s*")
_LINE_END = re.compile(r"[\r\n]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Alternatives up to which an expression's choices are listed one by one; its formula is whole, whatever their number.
MAX_CHOICES = 256
#: Pairs of a license and an exception up to which each is a label; more, from groups on both sides, are one label with the groups.
PAIRS = 65_536
#: How a formula writes the operators.
_SIGNS = {"or": " | ", "and": " + ", "with": " with "}


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; raises ValueError where the tokens are no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for t in tokens:
        op = t.lower()
        if t == "(":
            if not operand:
                raise ValueError("an operator is missing before (")
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or operand:
                raise ValueError("unbalanced )")
            stack.pop()
        elif op in _PRECEDENCE:
            if operand:
                raise ValueError(f"an operand is missing before {op}")
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        else:
            if not operand:
                raise ValueError(f"an operator is missing before {t}")
            out.append(t)
            operand = False
    if operand:
        raise ValueError("an operand is missing at the end")
    while stack:
        if stack[-1] == "(":
            raise ValueError("unbalanced (")
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str]) -> set[frozenset[str]]:
    """The sets of licenses that satisfy the expression: or joins choices, and combines them, with ties an exception to a license."""
    # An operand of the stack is a list of factors, multiplied only where an or, a with or the end needs it.
    stack: list[list[set[frozenset[str]]]] = []
    for t in postfix:
        if t not in _PRECEDENCE:
            stack.append([{frozenset([t.lower()])}])
            continue
        b, a = stack.pop(), stack.pop()
        if t == "and":
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a.extend(b)
            stack.append(a)
        elif t == "or":
            stack.append([_bounded(_product(a) | _product(b))])
        else:
            stack.append([_bounded({frozenset(f"{p} with {q}" for p in x for q in y) for x in _product(a) for y in _product(b)})])
    return _product(stack[0])


def _bounded(made: set[frozenset[str]]) -> set[frozenset[str]]:
    if len(made) > MAX_CHOICES:
        raise ValueError("too many choices")
    return made


def _product(factors: list[set[frozenset[str]]]) -> set[frozenset[str]]:
    """Every combination of the factors' choices; those of one choice are joined first, so that a long chain takes no quadratic time."""
    made = {frozenset()}
    for f in factors:
        if len(f) > 1:
            made = _bounded({x | y for x in made for y in f})
    always = frozenset(x for f in factors if len(f) == 1 for c in f for x in c)
    return {x | always for x in made}


def identifiers(postfix: list[str]) -> set[str]:
    """The labels of an expression, whatever its number of choices: its operands, those of a with as one."""
    stack: list[list[str]] = []
    for t in postfix:
        if t not in _PRECEDENCE:
            stack.append([t.lower()])
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if len(a) * len(b) <= PAIRS:
                a = [f"{p} with {q}" for p in a for q in b]
            else:
                a = [f"({' | '.join(sorted(set(a)))}) with ({' | '.join(sorted(set(b)))})"]
        else:
            # The shorter list goes into the longer one, so that a long chain takes no quadratic time.
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a.extend(b)
        stack.append(a)
    return set(stack[0])


def formula(postfix: list[str]) -> str:
    """The whole expression, never multiplied out: ``|`` between alternatives, ``+`` between what holds together, groups in parentheses."""
    stack: list = []
    for t in postfix:
        if t not in _PRECEDENCE:
            stack.append(t.lower())
            continue
        b, a = stack.pop(), stack.pop()
        chained = [isinstance(x, tuple) and x[0] == t != "with" for x in (a, b)]
        if chained[0]:
            a[1].extend(b[1] if chained[1] else [b])
        elif chained[1]:
            b[1].insert(0, a)
            a = b
        else:
            a = (t, [a, b])
        stack.append(a)
    out: list[str] = []
    left = [stack[0]]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        for i, part in enumerate(reversed(x[1])):
            left += [_SIGNS[x[0]]] if i else []
            left += [part] if isinstance(part, str) else [")", part, "("]
    return "".join(out)


def parse_expression(raw: str) -> tuple[set[frozenset[str]], int]:
    """Choices of the longest expression at the start of a line, and its number of tokens; none: (set(), 0).

    One with too many choices has tokens but no choices.
    """
    choices, _, n, _ = read_expression(raw)
    return choices, n


def read_expression(raw: str, at: int = 0, stop: int | None = None) -> tuple[set[frozenset[str]], set[str], int, str]:
    """Choices, labels, number of tokens and formula of the longest expression at a place in a line that ends at ``stop``."""
    tokens: list[str] = []
    depth, operand = 0, True
    end = 0
    for m in _TOKEN.finditer(raw, at, len(raw) if stop is None else stop):
        if raw[at : m.start()].strip():
            break
        t = m.group()
        trimmed = t.rstrip(".:-")
        word = t == "(" or t == ")" or trimmed.lower() in _PRECEDENCE
        if (t == "(") != operand and t == "(" or (t == ")" and (operand or not depth)) or (trimmed.lower() in _PRECEDENCE and operand) or (not word and not operand):
            break
        depth += (t == "(") - (t == ")")
        operand = t == "(" or trimmed.lower() in _PRECEDENCE
        tokens.append(t if t in "()" else trimmed)
        if not operand and not depth:
            end = len(tokens)
        at = m.end()
        if not word and t != trimmed:
            break
    if not end:
        return set(), set(), 0, ""
    postfix = to_postfix(tokens[:end])
    try:
        choices = evaluate(postfix)
    except ValueError:
        choices = set()
    return choices, identifiers(postfix), end, formula(postfix)


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in {**BASE_PHRASES, **NOTICES, **dict.fromkeys(TAGS)}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(words, base places, first, last, base labels, labels, score, choices, formulas) of a whole text."""
        words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
        flat = " " + b" ".join(words).decode("utf-8", "replace") + " "
        base: set[str] = set()
        labels: set[str] = set()
        starts: list[int] = []
        doubt, tagged = 1.0, False
        at = word = 0
        hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in self.automaton.iter(flat))
        for start, phrase in hits:
            word += flat.count(" ", at, start)
            at = start
            if phrase in BASE_PHRASES:
                starts.append(word)
                base.add(BASE_PHRASES[phrase])
                doubt *= 1 - STRENGTH["base"]
            elif phrase in NOTICES:
                labels.add(NOTICES[phrase])
                doubt *= 1 - STRENGTH["notice"]
            else:
                tagged = True
        choices: set[frozenset[str]] = set()
        formulas: set[str] = set()
        if tagged:
            stop = -1
            for m in _TAG.finditer(text or ""):
                if m.end() > stop:
                    end = _LINE_END.search(text, m.end())
                    stop = end.start() if end else len(text)
                found, names, n, whole = read_expression(text, m.end(), stop)
                if n:
                    choices |= found
                    formulas.add(whole)
                    doubt *= 1 - STRENGTH["tag"]
                    labels |= names
        shown = " | ".join(sorted(" + ".join(sorted(c)) for c in choices))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - doubt, shown, "; ".join(sorted(formulas))


COLUMNS = (("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("choices", pa.string(), "string"), ("formula", pa.string(), "string"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and what the scan of its whole text found; no shuffle.

    Null text counts as empty and has no words, places or labels, and score 0. Texts of any
    length are scanned whole. Ids may be null or repeat; repeated rows stay repeated. A
    broken expression adds nothing. ``formula`` has the different expressions of the text;
    ``choices`` lists the ways to satisfy those of few. Places that tie count each. An empty
    table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in sliced(batches):
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, (_, t, _) in zip(columns, COLUMNS, strict=True))], names=[id_col, *(n for n, _, _ in COLUMNS)])

    src = docs.select(docs[id_col].cast("long").alias(id_col), text_col)
    return src.mapInArrow(run, f"{id_col} long, " + ", ".join(f"{n} {s}" for n, _, s in COLUMNS))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_license_scan": op4_license_scan}
