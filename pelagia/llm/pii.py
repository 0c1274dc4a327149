"""Personal data in texts, also where it is disguised, with offsets into the source.

Plain identifiers are found first, each kind by its pattern from left to right without overlap; matches
that fail their check are dropped. Disguised ones are found in a second view of the text, which a chain of
transducers makes: look-alike letters and wide or foreign digits become ASCII and invisible characters go; ``(dot)``, ``[.]`` and
``dot`` between words become a point; ``(at)``, ``[at]`` and, before a host with a disguised point, ``at`` become @; digits
spelled as words become digits. Each character of the view knows the source characters it stands for, so that
what the same patterns find there maps back. Only spans that hold a changed character and touch no plain span of their kind are added.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are rows of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.llm.words import Texts, byte_class, find_words, texts_of

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# --- fixed values: letters that look like ASCII ones, and words for digits --------------------
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυι",
    "ABESIJKMHOPCTYXaesijopcyxhdqwABEZHIKMNOPTYXavopui"))
UNSEEN = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "uk", "de", "fr", "es")
#: Words before a spoken "at" that speak of a place on the web, not of a mailbox.
NOT_MAILBOXES = frozenset("look looks looking visit visits us me it is are was be been available found hosted see seen more online site page pages "
                          "website here read live shop order orders sold published posted listed him her them you one all at".split())
# --- end of fixed values ----------------------------------------------------------------------
_DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|\.)\s*[\)\]\}>]\s*|[ \t]+dot[ \t]+)"
_DOTS = re.compile(rf"(?<=\w){_DOT}(?=\w)", re.I)
_ATS = re.compile(rf"(?<=[A-Za-z0-9])(?:\s*[\(\[\{{<]\s*(?:at|@)\s*[\)\]\}}>]\s*|[ \t]+at[ \t]+(?=[A-Za-z0-9-]+{_DOT}[A-Za-z0-9-])|[ \t]+@[ \t]*(?=[A-Za-z0-9])|@[ \t]+(?=[A-Za-z0-9]))", re.I)
_SPOKEN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)([ \t]+at[ \t]+)(?=(?:[A-Za-z0-9-]+\.)+(?:{'|'.join(TOP_LEVEL)})\b(?!\.[A-Za-z0-9]))", re.I)
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?:\bplus[ \t]+|\+[ \t]?)?\b(?:{_WORD}|[0-9]+)(?:[ \t,-]+(?:{_WORD}|[0-9]+|dot|point)){{3,}}\b", re.I)
_HINT_SIGNS = re.compile(r"[\(\[\{<]\s*(?:dot|at|\.|@)\s*[\)\]\}>]|[ \t]dot[ \t]|[ \t]@|@[ \t]", re.I)
_SPOKEN_HINT = re.compile(r"[ \t]at[ \t]+[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)
_FOREIGN = re.compile("[" + re.escape("".join(LOOKALIKES)) + UNSEEN + "！-～٠-٩۰-۹०-९]")
SPELLED_LEAST, SPELLED_KINDS = 3, 2
_FOREIGN_LEADS = byte_class(*range(0xCE, 0xD6), 0xC2, 0xD9, 0xDB, 0xE0, 0xE2, 0xEF)
_LETTERS = byte_class(ranges=((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > past and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            found.append((begin, host.end()))
            past = host.end()
        at = text.find("@", max(at + 1, past))
    return found


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """All plain identifiers, kind by kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


@dataclass
class View:
    """A text, the source span each character stands for, and whether it was changed."""

    text: str
    begin: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> View:
        place = np.arange(len(text))
        return cls(text, place, place + 1, np.zeros(len(text), dtype=bool))

    def rewritten(self, changes: list[tuple[int, int, str]]) -> View:
        """The view with some spans, in order, replaced."""
        if not changes:
            return self
        text, begin, end, changed, past = [], [], [], [], 0
        for a, b, new in changes:
            text += [self.text[past:a], new]
            begin += [self.begin[past:a], np.full(len(new), self.begin[a])]
            end += [self.end[past:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[past:a], np.ones(len(new), dtype=bool)]
            past = b
        return View("".join([*text, self.text[past:]]), np.concatenate([*begin, self.begin[past:]]),
                    np.concatenate([*end, self.end[past:]]), np.concatenate([*changed, self.changed[past:]]))


def ascii_form(sign: str) -> str:
    if sign in LOOKALIKES:
        return LOOKALIKES[sign]
    if sign in UNSEEN:
        return ""
    if "！" <= sign <= "～":
        return chr(ord(sign) - 0xFEE0)
    return str(unicodedata.decimal(sign))


def spelled(match: re.Match) -> str | None:
    """The digits of a run of spelled ones; None where the run has few words or few different ones."""
    units = [u.lower() for u in re.findall(rf"{_WORD}|[0-9]+|dot|point|plus|\+", match[0], re.I)]
    words = [u for u in units if u in DIGIT_WORDS]
    if len(words) < SPELLED_LEAST or len({DIGIT_WORDS[w] for w in words}) < SPELLED_KINDS:
        return None
    return "".join(DIGIT_WORDS.get(u, {"dot": ".", "point": ".", "plus": "+"}.get(u, u)) for u in units)


def hints(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may hold foreign signs, and which have two digit words with none but digits, dots and points between them."""
    n = len(texts)
    foreign = np.zeros(n, dtype=bool)
    foreign[np.searchsorted(texts.offsets, np.flatnonzero(_FOREIGN_LEADS[texts.data]), side="right") - 1] = True
    words = find_words(texts, _LETTERS)
    told = np.isin(words.hashes(), _digit_word_hashes())
    near = np.flatnonzero(told[1:] & told[:-1])  # whatever lies between letters; the pattern looks closer
    row = np.zeros(n, dtype=bool)
    row[np.searchsorted(words.pointer, near, side="right") - 1] = True
    return foreign, row


def _digit_word_hashes() -> np.ndarray:
    column = pa.array([w for word in (*DIGIT_WORDS, "dot", "point") for w in (word, word.replace("ü", "Ü").replace("é", "É"))])
    return np.concatenate([find_words(t, _LETTERS).hashes() for t in texts_of(column)])


def signs_hint(text: str) -> bool:
    return any(x in text for x in ("(", "[", "{", "<", " @", "@ ", "dot", "Dot", "DOT", "\t@", "@\t")) and bool(_HINT_SIGNS.search(text)) \
        or "." in text and bool(_SPOKEN_HINT.search(text))


def deobfuscated(text: str, foreign: bool = True, row: bool = True) -> View | None:
    """The view without disguises; None if there are none. The flags are those of ``hints``."""
    foreign = foreign and not text.isascii() and bool(_FOREIGN.search(text))
    if not (foreign or row or signs_hint(text)):
        return None
    view = View.of(text)
    if foreign:
        view = view.rewritten([(m.start(), m.end(), ascii_form(m[0])) for m in _FOREIGN.finditer(text)])
    view = view.rewritten([(*m.span(), digits) for m in _SPELLED.finditer(view.text) if (digits := spelled(m)) is not None])
    view = view.rewritten([(*m.span(), "@") for m in _ATS.finditer(view.text)])
    view = view.rewritten([(*m.span(2), "@") for m in _SPOKEN_AT.finditer(view.text) if m[1].lower().strip(".-") not in NOT_MAILBOXES])
    view = view.rewritten([(*m.span(), ".") for m in _DOTS.finditer(view.text)])
    return view if view.changed.any() or len(view.text) != len(text) else None


def all_spans(text: str, foreign: bool = True, row: bool = True) -> list[tuple[str, int, int, bool]]:
    """Plain and disguised identifiers in the order of KINDS and their places."""
    found = [(*s, True) for s in plain_spans(text)]
    view = deobfuscated(text, foreign, row)
    if view is not None:
        taken = {k: np.array([(a, b) for kind, a, b, _ in found if kind == k]).reshape(-1, 2) for k in KINDS}
        shift = len(view.text) != len(text)
        for kind, a, b in plain_spans(view.text):
            begin, end = int(view.begin[a]), int(view.end[b - 1])
            altered = view.changed[a:b].any() or shift and end - begin != b - a
            own = taken[kind]
            if altered and not ((own[:, 0] < end) & (begin < own[:, 1])).any() and (kind != "email" or sensible_host(view.text[a:b])):
                found.append((kind, begin, end, False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def sensible_host(address: str) -> bool:
    """Whether the last label of a disguised address is of letters, as top-level names are."""
    last = address.rsplit(".", 1)[1]
    return len(last) >= 2 and last.isalpha()


@F.arrow_udf(SPANS)
def spans(column: pa.Array) -> pa.Array:
    rows = []
    for texts in texts_of(column):
        foreign, row = hints(texts)
        for i in range(len(texts)):
            found = all_spans(texts.text(i).decode("utf-8", "replace"), foreign[i], row[i])
            rows.append([dict(zip(("kind", "begin", "end", "plain"), s)) for s in found])
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
