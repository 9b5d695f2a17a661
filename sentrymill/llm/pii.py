"""Personal data by offset-preserving deobfuscation.

Identifiers are found in the text as it is (the base spans) and again in a normalised copy,
made by transducers that undo disguises: invisible characters, homoglyphs, spelled digits and
at/dot words. Each transducer rewrites stretches of the text and carries, for every character
it writes, the source characters that it stands for; spans found in the copy map back to
source characters and are added where no base span of their kind lies.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import per_row

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts drawn like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαντι‐‑–—−․。∙",
        "ABESIJKMHOPCTYXaesijopcyxdlABEZHIKMNOPTYXoavti-----...",
    )
)
INVISIBLE = "­​‌‍⁠﻿"
#: Digits in words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Runs of four spelled digits or more, with dots (addresses) and a leading plus (numbers abroad).
_NEXT = rf"(?:[\s,-]+(?:(?:dot|point)[\s,-]+)?{_NUMBER})"
RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+)?{_NUMBER}{_NEXT}{{3,}}(?!\w)")
RUN_PART = re.compile(rf"(?i){_NUMBER}|dot|point|plus")
#: Letters for digits inside a number: O, o, l, I.
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]{2,}(?![A-Za-z])")
LIKE_DIGIT = str.maketrans("OolI", "0011")
#: A run of blanks is looked at from its start alone, so that time is linear in it.
BRACKET_AT = re.compile(r"(?i)(?<!\s)\s*+[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+")
BRACKET_DOT = re.compile(r"(?i)(?<!\s)\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+")
#: An at joined to name and host by _ or -; a host's first label has 63 characters at most.
_JOINED_AT = r"[_-]at[_-][A-Za-z0-9-]{1,63}(?:\s+dot\s+|\.)[A-Za-z0-9-]"
#: name at host dot tld; with written dots the name must look like one: a digit or one of . _ + % in it.
WORD_AT = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])(?P<local>(?:(?!{_JOINED_AT})[A-Za-z0-9._%+-])++(?:\s+dot\s+[A-Za-z0-9_%+-]+){{0,3}}?)(?P<at>\s*[_\s-]at[_\s-]\s*)(?P<host>[A-Za-z0-9-]{{1,63}}(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]{{1,63}}){{1,6}})"
)
WORD_DOT = re.compile(r"(?i)\s+dot\s+")
LEFT_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9%+_-])@[A-Za-z0-9.-]+(?:\s+dot\s+[A-Za-z0-9][A-Za-z0-9.-]*)+")
#: Four figures with a written dot or more between them.
FIGURE_DOTS = re.compile(r"(?i)(?<![0-9])[0-9]++(?:(?:\s+(?:dot|point)\s+|\.)[0-9]++){3}")
FIGURE_DOT = re.compile(r"(?i)\s+(?:dot|point)\s+")
NAME_LIKE = re.compile(r"[0-9_+%]|[A-Za-z0-9]\.[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, in time linear in the text.

    A match holds one @ with the longest run of name characters before it; so each @ is looked
    at in turn, back to the last match's end.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points; matches that fail their kind's test are dropped, not retried."""
    out = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


class Tape:
    """Text under rewriting: for each character, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, stretches: list[tuple[int, int, str]]) -> None:
        """Each (start, end, new), in order and apart, becomes new; its characters share its source span,
        but stretches as long as what replaces them keep theirs one to one."""
        if not stretches:
            return
        text, starts, ends, at = [], array("q"), array("q"), 0
        for s, e, new in stretches:
            text += [self.text[at:s], new]
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if len(new) == e - s:
                starts += self.starts[s:e]
                ends += self.ends[s:e]
            else:
                starts.extend([self.starts[s]] * len(new))
                ends.extend([self.ends[e - 1]] * len(new))
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


ODD = re.compile(f"[{INVISIBLE}]|[^\\x00-\\u024f]")


def fold_characters(tape: Tape) -> None:
    if not tape.text.isascii():
        tape.rewrite([(m.start(), m.end(), new) for m in ODD.finditer(tape.text) if (new := _character(m[0])) != m[0]])


def fold_digits(tape: Tape) -> None:
    """Digits in words become figures, letters drawn like digits too; each figure keeps its own word's span."""
    tape.rewrite([(m.start(), m.end(), m[0].translate(LIKE_DIGIT)) for m in MIXED.finditer(tape.text)])
    stretches = []
    for m in RUN.finditer(tape.text):
        at, parts = m.start(), list(RUN_PART.finditer(tape.text, *m.span()))
        for p in parts:
            if p.start() > at:
                stretches.append((at, p.start(), ""))
            word = p[0].lower()
            stretches.append((*p.span(), "+" if word == "plus" else "." if word in ("dot", "point") else SPELLED[word]))
            at = p.end()
    tape.rewrite(stretches)


def fold_addresses(tape: Tape) -> None:
    tape.rewrite([(*m.span(), "@") for m in BRACKET_AT.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in BRACKET_DOT.finditer(tape.text)])
    stretches = []
    for m in WORD_AT.finditer(tape.text):
        spelled = WORD_DOT.search(m["host"]) is not None
        if spelled or NAME_LIKE.search(m["local"]):
            inner = [(m.start("local") + d.start(), m.start("local") + d.end(), ".") for d in WORD_DOT.finditer(m["local"])]
            host = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in WORD_DOT.finditer(m["host"])]
            stretches += [*inner, (*m.span("at"), "@"), *host]
    tape.rewrite(stretches)
    # dots left in words after an address's @, and between figures
    for whole, dot in ((LEFT_DOT, WORD_DOT), (FIGURE_DOTS, FIGURE_DOT)):
        tape.rewrite([(*d.span(), ".") for m in whole.finditer(tape.text) for d in dot.finditer(tape.text, *m.span())])


#: Any of these hints at a disguise; texts without are not rewritten.
HINTS = re.compile(rf"(?i)[\[({{<]\s*(?:at|dot|@|\.)\s*[\])}}>]|[_\s-]at[_\s-]\s*+[a-z0-9-]{{1,63}}+(?:\s+dot\s|\.[a-z0-9-])|@[^\s@]*+\s+dot\s|[0-9]\s+(?:dot|point)\s+[0-9]|[0-9][OolI]|[OolI][0-9]|(?<!\w){_NUMBER}{_NEXT}{{3}}")


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and those that only the normalised copy shows."""
    base = identifiers(text)
    if HINTS.search(text) or (not text.isascii() and ODD.search(text)):
        tape = Tape(text)
        fold_characters(tape)
        fold_digits(tape)
        fold_addresses(tape)
        if tape.text != text:
            more = [(kind, *tape.source(s, e)) for kind, s, e in identifiers(tape.text)]
            # spans of one kind lie apart, so that both their starts and their ends rise
            taken = {k: sorted((s, e) for b, s, e in base if b == k) for k in KINDS}
            starts, ends = ({k: [x[at] for x in taken[k]] + [len(text) + 1] for k in KINDS} for at in (0, 1))
            more = [(k, s, e) for k, s, e in dict.fromkeys(more) if starts[k][bisect.bisect_right(ends[k], s)] >= e]
            return base, base + more
    return base, base


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and spans, arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none. Texts are read whole; rows map one to one, so repeated rows
    and ids need no rule; extra columns are ignored; an empty table gives no rows.
    """

    def rows(x):
        found = [find(t.decode()) for t in x[text_col]]
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]
        return {"id": x[id_col], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(a) for _, a in found]}

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return per_row(docs.select(id_col, text_col), rows, f"id bigint, base {kind}, spans {kind}").withColumnRenamed("id", id_col)
