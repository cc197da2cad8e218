"""Personal data in texts, disguised or plain, as spans of the source text.

Plain identifiers are found in the text as it stands. Then transducers rewrite the
text, each one keeping for every character it writes the source characters that it
stands for:

* look-alikes: full-width forms, digits of other scripts, and Greek and Cyrillic
  letters shaped like Latin ones become ASCII; invisible characters go;
* spelled digits: a run of five or more digit words of one language, with "plus"
  before it, becomes digits;
* disguises: "(at)", "[dot]" and the like, and the bare words between parts of an
  address or number, become "@" and ".".

The detectors run again on what was rewritten, and the spans they find are mapped
back. A text that no transducer changes needs no second run, which is decided over
the whole text by one search for each transducer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from . import spans as S

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# A character outside its class ends each of these runs, so that giving characters
# back could never help: possessive runs find the same and stay linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[S.Span]:
    """Leftmost addresses: from each "@" with a domain back over the local part."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield EMAIL, start, end


def detect(text: str) -> list[S.Span]:
    """All plain identifiers; matches that fail a kind's test are dropped."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((PHONE, m.start(), m.end()))
    return found


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁһӏԛԝɡ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινυρ",
    "ABESIJKMHOPCTXYaesijopcyxdhlqwg" "ABEZHIKMNOPTYXoaivup",
    strict=True,
))
INVISIBLE = "­​‌‍⁠﻿"
# The words for the digits 0 to 9.
SPELLED = {
    "en": ("zero oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei zwo", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
#: Least run of digit words that is read as a number.
RUN = 5
_GAP = r"[ ,.-]{1,3}"
_DIGIT_OF = {lang: {w: str(i) for i, names in enumerate(table) for w in names.split()} for lang, table in SPELLED.items()}
_WORDS = {lang: "|".join(sorted(table, key=len, reverse=True)) for lang, table in _DIGIT_OF.items()}
_RUNS = {lang: re.compile(rf"(?<!\w)(?:(?:plus|más|mas)\s)?(?:{w})(?:{_GAP}(?:{w}|[0-9])){{{RUN - 1},}}(?!\w)", re.I) for lang, w in _WORDS.items()}
_ONE = {lang: re.compile(rf"(plus|más|mas)|({w})|([0-9])", re.I) for lang, w in _WORDS.items()}
# Whatever a run of one language matches, this matches too.
_ANY_WORD = "|".join(_WORDS.values())
_ANY_RUN = re.compile(rf"(?<!\w)(?:{_ANY_WORD})(?:{_GAP}(?:{_ANY_WORD}|[0-9])){{{RUN - 1}}}", re.I)
_ODD = re.compile(f"[{INVISIBLE}{''.join(LOOK_ALIKES)}！-～٠-٩۰-۹०-९]")
_AT = r"(?:at|ät|arroba|arobase)"
_DOT = r"(?:dot|punkt|punto|point)"
_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
_BRACED = re.compile(rf"\s?{_OPEN}(?:({_AT}|@)|{_DOT}|\.){_SHUT}\s?", re.I)
# The ends of addresses that prose with bare words for the signs must have.
_ENDS = "com|org|net|edu|gov|info|io|dev|app|biz|eu|de|fr|es|uk|us|it|nl|ch|at|be|pl|se|ru|cn|jp|in|br|ca|au"
_BARE_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\s{_DOT}\s|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_HOST = rf"[A-Za-z0-9-]+(?:(?:\s{_DOT}\s|\.)[A-Za-z0-9-]+)*(?:\s{_DOT}\s|\.)(?:{_ENDS})(?![A-Za-z0-9-])"
_BARE_MAIL = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\s{_DOT}\s|\.)[A-Za-z0-9_%+-]+)*(?:\s{_AT}\s|@){_HOST}", re.I)
# Whatever _BRACED, _BARE_MAIL, _SIGNED_MAIL and _BARE_IP rewrite, this matches a part of.
_HINT = re.compile(rf"{_OPEN}(?:{_AT}|{_DOT}|@|\.){_SHUT}|\s{_DOT}\s|\s{_AT}\s{_HOST}", re.I)
# After a plain "@" bare dots need no known ending behind them.
_SIGNED_MAIL = re.compile(rf"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:(?:\s{_DOT}\s|\.)[A-Za-z0-9-]+)*\s{_DOT}\s[A-Za-z0-9-]+", re.I)
_BARE = re.compile(rf"\s(?:({_AT})|{_DOT})\s", re.I)


class Tape:
    """A text, and for each of its characters the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replaces matches by characters, each with the part of the tape (start, end) it stands for."""
        text, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            for c, a, b in write(m):
                text.append(c)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            at = m.end()
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, span: S.Span) -> S.Span:
        kind, a, b = span
        return kind, self.starts[a], self.ends[b - 1]


def plain(m: re.Match) -> list[tuple[str, int, int]]:
    """The ASCII character that an odd one stands for, or nothing."""
    c = m[0]
    if c in INVISIBLE:
        return []
    c = LOOK_ALIKES.get(c) or (chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else str(unicodedata.digit(c)))
    return [(c, m.start(), m.end())]


def folded(word: str) -> str:
    """A word in lower case, with the forms of letters that a pattern without case takes for them (\u017f, \u0131, \u0130)."""
    return word.upper().lower().replace("i\u0307", "i")


def digits(lang: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    def write(m: re.Match) -> list[tuple[str, int, int]]:
        parts = _ONE[lang].finditer(m.string, m.start(), m.end())
        return [("+" if p[1] else _DIGIT_OF[lang][folded(p[2])] if p[2] else p[3], p.start(), p.end()) for p in parts]

    return write


def undisguised(m: re.Match) -> list[tuple[str, int, int]]:
    return [("@" if m[1] else ".", m.start(), m.end())]


def bare(m: re.Match) -> list[tuple[str, int, int]]:
    """An address with bare words for its signs, if it has any."""
    out, at = [], m.start()
    for p in _BARE.finditer(m.string, m.start(), m.end()):
        out += [(m.string[i], i, i + 1) for i in range(at, p.start())] + undisguised(p)
        at = p.end()
    return out + [(m.string[i], i, i + 1) for i in range(at, m.end())]


def counting(said: list[str]) -> bool:
    """Whether spelled digits are someone's counting up or down: nine in ten of their steps lead to the next digit."""
    steps = [(int(y) - int(x)) % 10 for x, y in zip(said, said[1:], strict=False)]
    return max(steps.count(1), steps.count(9)) * 10 >= 9 * len(steps)


def spelled(text: str) -> bool:
    """Whether a text may hold spelled digits."""
    return bool(_ANY_RUN.search(text))


def hinted(text: str) -> bool:
    """Whether a text may hold disguised signs."""
    return bool(_HINT.search(text))


def disguised(text: str) -> list[S.Span]:
    """Identifiers in the rewritten text, as spans of the source."""
    odd = not text.isascii() and bool(_ODD.search(text))
    if not (odd or spelled(text) or hinted(text)):
        return []
    tape, runs = Tape(text), []
    if odd:
        tape.rewrite(_ODD, plain)
    if hinted(tape.text):
        tape.rewrite(_BRACED, undisguised)
        tape.rewrite(_BARE_MAIL, bare)
        tape.rewrite(_SIGNED_MAIL, bare)
        tape.rewrite(_BARE_IP, bare)
    if spelled(tape.text):
        for lang in SPELLED:
            if _RUNS[lang].search(tape.text):
                for m in _RUNS[lang].finditer(tape.text):
                    said = [c for c, _, _ in digits(lang)(m) if c != "+"]
                    if 10 <= len(said) <= 15 and len(set(said)) >= 3 and not counting(said):
                        runs.append(tape.source((PHONE, m.start(), m.end())))
                tape.rewrite(_RUNS[lang], digits(lang))
    found = [tape.source(s) for s in detect(tape.text)]
    # a spelled number without a plus is a phone number by its length, unless it is something else
    return found + S.apart(runs, found)


def scanner(text: str) -> tuple[list[S.Span], list[S.Span]]:
    """(plain, added): the spans of the text as it stands, and those that only its rewriting shows."""
    base = detect(text)
    return base, S.apart(disguised(text), base)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added) for docs(doc_id, text): spans in code points, end exclusive.

    A null or empty text has none; repeated rows and null ids are kept, one result row
    each; further columns are not read. Work is linear in the length of a text.
    """
    return S.scan(docs, scanner, KINDS)


def mask(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with personal data replaced by its kind; nulls, repeated rows and further columns as in find()."""
    return S.masked(docs, scanner, KINDS)


def summary(docs: DataFrame) -> DataFrame:
    """One row per document with counts and digest of the plain spans and all spans as text."""
    return S.summary(docs, scanner, KINDS, KINDS)
