"""Personal data, plain and disguised, with spans in the source text.

Three transducers rewrite a text step by step: look-alike characters to ASCII,
spelled digits to digits, and at/dot disguises to signs. Each carries along where
its output characters came from, so identifiers found in the normal form are
mapped back to source characters. Plain identifiers are found in the source
itself; the normal form only adds to them. Card and phone numbers may have blanks
between their digits, emails and IPs may not: those are also looked for in a
second form, where neighbouring digit words are one number.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, empty_if_null, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, end, kind

# Fixed by the base rules.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their signs: no run of text is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Identifiers that stand in ``text`` as they are, by start and kind."""
    found = list(_emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [part.lstrip("0") for part in m[0].split(".")]
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _passes_luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return _ordered(found)


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Tape:
    """A rewritten text and the source range of each of its characters."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        places = np.arange(len(text) + 1, dtype=np.int64)
        return cls(text, places[:-1], places[1:])

    def rewritten(self, pattern: re.Pattern, replace: Callable[[re.Match], str]) -> Tape:
        """Every match replaced; the new characters stand for the whole match."""
        texts, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new == m[0]:
                continue
            texts += [self.text[done : m.start()], new]
            starts += [self.start[done : m.start()], np.full(len(new), self.start[m.start()])]
            ends += [self.end[done : m.start()], np.full(len(new), self.end[m.end() - 1])]
            done = m.end()
        if not texts:
            return self
        return Tape(
            "".join([*texts, self.text[done:]]),
            np.concatenate([*starts, self.start[done:]]),
            np.concatenate([*ends, self.end[done:]]),
        )

    def source(self, span: Span) -> Span:
        start, end, kind = span
        return int(self.start[start]), int(self.end[end - 1]), kind


# Letters that look like ASCII ones, by script, and characters without a width.
LOOK_ALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсху", "ABESIJKMHOPCTXYaesijopcxy")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv")),
    **dict(zip("‐‑‒–—−﹣⁃", "--------")),
    **dict(zip("․。．｡﹒", ".....")),
    "\ufe6b": "@",
    "\u00a0": " ",
    "\u2007": " ",
    "\u2009": " ",
    "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Full-width forms are ASCII moved up by a fixed distance.
FULL_WIDTH = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
SPELLED = {
    word: str(digit)
    for digit, word in enumerate(
        "zero one two three four five six seven eight nine".split()
    )
}
DIGIT_WORD = "(" + "|".join(SPELLED) + r")\b"
NUMBER_WORD = re.compile(rf"\b{DIGIT_WORD}", re.I | re.A)
#: A digit word with the blanks or hyphens before the next one, for addresses.
JOINED_WORD = re.compile(rf"\b{DIGIT_WORD}(?:[\s-]++(?={DIGIT_WORD}))?", re.I | re.A)
PLUS_WORD = re.compile(r"\bplus\s+(?=[0-9])", re.I | re.A)
DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
DOT_SIGN = re.compile(rf"(?<=[A-Za-z0-9]){DOT}(?=[A-Za-z0-9])", re.I | re.A)
AT_SIGN = re.compile(
    r"(?<=[A-Za-z0-9])(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*"
    # A bare "at" is a word; only a spelled dot after its domain makes it a sign.
    rf"|\s+at\s+(?=[A-Za-z0-9-]+{DOT}[A-Za-z]))(?=[A-Za-z0-9])",
    re.I | re.A,
)
DISGUISED = re.compile(r"dot\b|[\[({<]\s*(?:at|@|\.)", re.A)
STANDING_ONE = re.compile(r"one\b", re.A)
OTHER_DIGIT_WORDS = [w for w in SPELLED if w != "one"]
#: Anything a look-alike could be; Latin letters with accents are none.
ODD = re.compile("[\u00a0\u00ad\u0370-\u03ff\u0400-\u04ff\u0600-\U0010ffff]")


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES or c in FULL_WIDTH:
        return LOOK_ALIKES.get(c) or FULL_WIDTH[c]
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


def normal_form(text: str, number: re.Pattern = NUMBER_WORD) -> Tape | None:
    """``text`` through the transducers; None if they leave it as it is."""
    odd = None if text.isascii() else ODD.search(text)
    low = text.lower()
    spelled = any(w in low for w in OTHER_DIGIT_WORDS) or STANDING_ONE.search(low)
    if not (odd or spelled or DISGUISED.search(low)):
        return None
    tape = Tape.of(text)
    if odd:
        tape = tape.rewritten(ODD, _plain)
    tape = tape.rewritten(number, lambda m: SPELLED[m[1].lower()])
    tape = tape.rewritten(PLUS_WORD, lambda m: "+")
    tape = tape.rewritten(AT_SIGN, lambda m: "@").rewritten(DOT_SIGN, lambda m: ".")
    return None if tape.text == text else tape


def private_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans that stand as they are, and those that only the normal form shows."""
    plain = identifiers(text)
    tape = normal_form(text)
    if tape is None:
        return plain, []
    hidden = {tape.source(s) for s in identifiers(tape.text)}
    joined = normal_form(text, JOINED_WORD)
    if joined is not None and joined.text != tape.text:
        addresses = {joined.source(s) for s in identifiers(joined.text) if s[2] in ("email", "ip")}
        # The last digit word of an address may have passed for all of it.
        hidden = _outside(hidden, addresses) | addresses
    return plain, _ordered(hidden - set(plain))


def _outside(spans: set[Span], covers: set[Span]) -> set[Span]:
    """The spans that lie within none of ``covers`` of their kind, in one sweep over both."""
    reach: dict[str, int] = {}
    out = set()
    steps = [(s[0], 0, s) for s in covers] + [(s[0], 1, s) for s in spans]
    for _, is_span, (start, end, kind) in sorted(steps):
        if not is_span:
            reach[kind] = max(reach.get(kind, end), end)
        elif reach.get(kind, -1) < end:
            out.add((start, end, kind))
    return out


def masked(text: str) -> str:
    """``text`` with every span replaced by its kind; overlapping spans merge."""
    plain, hidden = private_spans(text)
    parts, done, upto = [], 0, 0
    for start, end, kind in _ordered(plain + hidden):
        if start >= upto:
            parts += [text[done:start], f"<{kind.upper()}>"]
        upto = done = max(upto, end)
    return "".join([*parts, text[done:]])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and spans of plain identifiers, and ``spans`` with the disguised ones.

    Spans are written ``kind:start:end`` in code points, end exclusive, by start
    and kind. A null text counts as empty and has none. Repeated rows are read
    alike, an empty table gives an empty result, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(f"{counts}, base string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for plain, hidden in map(private_spans, texts):
                kinds = [kind for _, _, kind in plain]
                rows.append(
                    (
                        *[kinds.count(k) for k in KINDS],
                        _written(plain),
                        _written(_ordered(plain + hidden)),
                    )
                )
            yield pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base", "spans"])

    return docs.select("doc_id", found(empty_if_null("text")).alias("f")).select("doc_id", "f.*")


def mask_private(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<EMAIL>`` and the like.

    All rows and columns stay; a null text stays null.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked(t) for t in texts], dtype=object)

    return docs.withColumn("text", mask("text"))


def op2_disguised_pii(spark, sf_dir):
    found = find_private(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans"
    )
