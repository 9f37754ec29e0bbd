"""Personal data in texts, plain and disguised, with spans in the source text.

Plain identifiers are found on the text as it is.  For disguised ones a
text goes through a chain of transducers, each a list of edits from one
string to the next: look-alike characters and foreign digits are folded,
invisible characters dropped, disguised separators ("[at]", "dot") and
spelled digits replaced.  The same detectors run on what comes out, and a
match that touches an edit is mapped back to the source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import arrow_rows

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DECIMAL = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str):
    if not _DECIMAL.search(text):
        return
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


DETECTORS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, leftmost and non-overlapping per kind, by kind then start."""
    return [(kind, *span) for kind in KINDS for span in DETECTORS[kind](text)]


# Characters that look like Latin letters, by what they look like.
LOOK_ALIKE = {
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κк", "l": "ӏ",
    "m": "м", "n": "п", "o": "оο", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "νѵ", "w": "ԝω",
    "x": "хχ", "y": "уγ", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "-": "‐‑‒–—−", ".": "․。・•·", "@": "﹫",
}
INVISIBLE = "­͏؜ᅟ᠎​‌‍‎‏⁠⁡⁢⁣⁤️﻿"
# Digits spelled in English, German, French and Spanish; the at and dot of addresses.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto", "period")
PLUS_WORDS = ("plus", "más", "mas")
# Endings that a spoken address must have, since "at" and "dot" are words too.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro dev app io ai co xyz online site shop tech cloud blog test example invalid "
    "uk de fr es eu us ca au jp cn ru br nl se ch pl kr mx ar cl pt dk fi cz gr ie nz za tr ua".split()
)


def _fold_table() -> dict[int, str]:
    """One character to one: compatibility forms of ASCII, digits of all scripts, look-alikes."""
    table = {}
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Nd":
            table[cp] = str(unicodedata.decimal(c))
        elif len(plain) == 1 and "\x20" <= plain <= "\x7e":
            table[cp] = plain
        elif unicodedata.category(c) == "Zs":
            table[cp] = " "
    table |= {ord(c): to for to, many in LOOK_ALIKE.items() for c in many}
    return table


FOLD = _fold_table()
_DIGIT_OF = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_either = "|".join
# All repeats below are bounded, so that a text is read in linear time.
_OPEN, _CLOSE = r"[\[({<|*_~-]{1,3}", r"[\])}>|*_~-]{1,3}"
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_MULTIPLE = {"double": 2, "triple": 3}
_TOKEN = rf"(?:(?:double|triple)[\s-]{{1,3}})?(?:{_WORD}|[0-9])"
#: Two or more spelled digits in a row, single figures among them.
_SPELLED = re.compile(
    rf"(?<![^\W\d_])(?=(?:[0-9][\s,-]{{1,3}}){{0,18}}(?:(?:double|triple)[\s-]{{1,3}})?(?:{_WORD})\b){_TOKEN}(?:[\s,-]{{1,3}}{_TOKEN})+(?![^\W_])", re.IGNORECASE
)
_ONE = re.compile(rf"(?:(double|triple)[\s-]{{1,3}})?({_WORD}|[0-9])", re.IGNORECASE)
_BRACKET_AT = re.compile(rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:{_either(AT_WORDS)}|@)\s{{0,3}}{_CLOSE}\s{{0,3}}", re.IGNORECASE)
_BRACKET_DOT = re.compile(rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:{_either(DOT_WORDS)}|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}", re.IGNORECASE)
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_HOST = r"[A-Za-z0-9-]{1,63}"
_SPACED_DOT = rf"\s{{1,3}}(?:{_either(DOT_WORDS)})\s{{1,3}}"
_DOTTED = rf"(?:{_SPACED_DOT}|\s{{0,3}}\.\s{{0,3}})"
#: "name at host dot tld", at least one of the two separators being a word.
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?P<name>{_NAME}(?:(?:{_SPACED_DOT}|\.){_NAME}){{0,4}})"
    rf"(?:(?P<at>\s{{1,3}}(?:{_either(AT_WORDS)})\s{{1,3}})(?P<host>{_HOST}(?:{_SPACED_DOT}|\.){_HOST}(?:(?:{_SPACED_DOT}|\.){_HOST}){{0,4}})"
    rf"|(?P<at2>\s{{0,3}}@\s{{0,3}})(?P<host2>{_HOST}{_DOTTED}{_HOST}(?:(?:{_SPACED_DOT}|\.){_HOST}){{0,4}}))",
    re.IGNORECASE,
)
_ANY_DOT = re.compile(rf"{_SPACED_DOT}|\s{{0,3}}\.\s{{0,3}}", re.IGNORECASE)
_NUMERIC_DOT = re.compile(rf"(?<=[0-9])\s{{1,3}}(?:{_either(DOT_WORDS)})\s{{1,3}}(?=[0-9])", re.IGNORECASE)
_SPOKEN_PLUS = re.compile(rf"(?<![^\W_])(?:{_either(PLUS_WORDS)})\s{{1,3}}(?=[0-9])", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl]+(?=[\x20.-]?[0-9])|(?<=[0-9][\x20.-])[OoIl]+(?=[0-9])")
_LETTER_TO_DIGIT = str.maketrans("OoIl", "0011")
# What a match can't be without, found faster than the match: most texts have none of it.
_OPENED = re.compile(rf"[\[({{<|*_~-]\s{{0,3}}(?:{_either((*AT_WORDS, *DOT_WORDS))}|[@.])", re.IGNORECASE)
_SAID_AT = re.compile(rf"\s(?:{_either(AT_WORDS)})\s{{1,3}}{_HOST}(?:{_SPACED_DOT}|\.)[A-Za-z0-9-]", re.IGNORECASE)
_DIGIT_THEN_LETTER = re.compile(r"[0-9][\x20.-]?[OoIl]")
_SPELLED_BYTES = frozenset(w.encode() for w in _DIGIT_OF)
_LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Letters that a pattern takes for i or s whatever ``lower`` makes of them.
_UNLIKE_LOWER = re.compile("[ſıİ]")


def _says(text: str, words: tuple[str, ...]) -> bool:
    """Whether one of ``words`` may be in the text, in either case."""
    low = text.lower()
    return any(w in low for w in words) or not text.isascii() and bool(_UNLIKE_LOWER.search(text))


def _says_digit(text: str) -> bool:
    """Whether a spelled digit may stand in the text as a word."""
    low = text.lower()
    if not text.isascii():
        if _UNLIKE_LOWER.search(text):
            return True
        for c in set(low):
            if c > "\x7f" and not c.isalnum():
                low = low.replace(c, " ")
    return not _SPELLED_BYTES.isdisjoint(low.encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY).split())


class Tape:
    """A text after edits, able to map its spans to the source.

    Runs of unedited characters are kept as (position, source position);
    an edit's characters all map to its whole source stretch.
    """

    def __init__(self, text: str):
        self.text = text
        #: starts of stretches here, their source start and end, and whether they were edited
        self.at, self.start, self.end, self.edited = [0], [0], [len(text)], [False]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end) and whether an edit touches it."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low = self.start[first] if self.edited[first] else self.start[first] + start - self.at[first]
        high = self.end[last] if self.edited[last] else self.start[last] + end - self.at[last]
        return low, high, any(self.edited[first : last + 1])

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches [start, end) in order; a deletion is an edit to nothing."""
        out, at, start, end, edited = [], [], [], [], []
        length = 0

        def copy(low: int, high: int) -> None:
            nonlocal length
            k = bisect_right(self.at, low) - 1
            while low < high:
                stop = min(high, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                at.append(length)
                edited.append(self.edited[k])
                start.append(self.start[k] if self.edited[k] else self.start[k] + low - self.at[k])
                end.append(self.end[k] if self.edited[k] else self.start[k] + stop - self.at[k])
                out.append(self.text[low:stop])
                length += stop - low
                low, k = stop, k + 1

        done = 0
        for low, high, new in edits:
            copy(done, low)
            if new:
                s, e, _ = self.source(low, high)
                at.append(length)
                start.append(s)
                end.append(e)
                edited.append(True)
                out.append(new)
                length += len(new)
            done = high
        copy(done, len(self.text))
        self.text, self.at, self.start, self.end, self.edited = "".join(out), at or [0], start or [0], end or [0], edited or [False]


def _fold(text: str) -> list[tuple[int, int, str]]:
    some = "".join(c for c in set(text) if ord(c) in FOLD)
    return [(m.start(), m.end(), FOLD[ord(m[0])]) for m in re.finditer(f"[{re.escape(some)}]", text)] if some else []


def _drop_invisible(text: str) -> list[tuple[int, int, str]]:
    """An invisible run goes along with the character before it, which keeps its place in the source."""
    return [(m.start() - 1, m.end(), text[m.start() - 1]) if m.start() else (0, m.end(), "") for m in _INVISIBLE.finditer(text)]


def _spell(text: str) -> list[tuple[int, int, str]]:
    def digits(run: str) -> str:
        return "".join(_DIGIT_OF.get(d.lower(), d) * _MULTIPLE.get((m or "").lower(), 1) for m, d in _ONE.findall(run))

    return [(m.start(), m.end(), digits(m[0])) for m in _SPELLED.finditer(text)] if _says_digit(text) else []


def _separators(text: str) -> list[tuple[int, int, str]]:
    if not _OPENED.search(text):
        return []
    found = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
    return sorted(found + [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in found)])


def _spoken(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if "@" not in text and not _SAID_AT.search(text):
        return edits
    for m in _SPOKEN.finditer(text):
        at, host = ("at", "host") if m["at"] else ("at2", "host2")
        dots = [(d.start(), d.end(), ".") for part in ("name", host) for d in _ANY_DOT.finditer(text, *m.span(part)) if d[0] != "."]
        if _ANY_DOT.split(m[host])[-1].lower() not in ENDINGS:
            continue
        if m["at"] and not m["at"].strip().isupper() and not any(a >= m.start(host) for a, _, _ in dots):
            continue  # "meet us at example.com" is no disguise
        edits += sorted([*dots, *([(*m.span(at), "@")] if m[at] != "@" else [])])
    return edits


def _numeric(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in _NUMERIC_DOT.finditer(text)] if _says(text, DOT_WORDS) else []


def _plus(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+") for m in _SPOKEN_PLUS.finditer(text)] if _says(text, PLUS_WORDS) else []


def _letters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].translate(_LETTER_TO_DIGIT)) for m in _LETTER_DIGIT.finditer(text)] if _DIGIT_THEN_LETTER.search(text) else []


TRANSDUCERS = (_drop_invisible, _fold, _spell, _separators, _numeric, _plus, _spoken, _letters)


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches that only show after the transducers, as source spans not inside a plain one."""
    tape = None
    for step in TRANSDUCERS[2 * text.isascii() :]:  # the first two edit no ASCII character
        if edits := step(tape.text if tape else text):
            tape = tape or Tape(text)
            tape.edit(edits)
    if not tape:
        return []
    found = set()
    for kind, start, end in plain_spans(tape.text):
        low, high, edited = tape.source(start, end)
        if edited and not any(k == kind and a <= low and high <= b for k, a, b in plain):
            found.add((kind, low, high))
    return list(found)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans, each by kind then start; null is empty."""
    plain = plain_spans(text or "")
    return plain, sorted(plain + disguised_spans(text or "", plain), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, plain, spans)``, arrays of ``(kind, start, end)``.

    Spans are code points, end exclusive.  Null and empty texts have none;
    repeated rows are answered each; other columns are not read.
    """

    def rows(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            plain, every = find(t)
            yield i, *([{"kind": k, "start": a, "end": b} for k, a, b in s] for s in (plain, every))

    span = "array<struct<kind:string,start:long,end:long>>"
    return arrow_rows(docs, [id_col, "text"], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, plain {span}, spans {span}", rows)


def redact(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def base_digest(plain: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain).encode()).hexdigest()
