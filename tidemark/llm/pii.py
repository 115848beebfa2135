"""Personal data in text, also where it is disguised, with offsets of the text as it stands.

Plain identifiers are found first. Then transducers rewrite the text: look-alike characters,
spelled digits, and "at" and "dot" in words or brackets. Each keeps, for every character that it
writes, the source characters it came from; identifiers found in the rewritten text are mapped
back through that.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, place_of, text_udf, unnamed

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The leftmost match begins where a run of digits does, so no start within one is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their @: what stands before it and behind it, each character looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def identifiers(text: str) -> list[Span]:
    """Identifiers as they stand, by kind and place; a match that fails its test is dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυ",
        "ABEKMHOPCTYXaeopcyxijsdqwhlABEZHIKMNOPTYXaovpu",
        strict=True,
    )
)
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Digits in words.
_NUMERALS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4",
    "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_NUMERAL = f"(?:{'|'.join(sorted(_NUMERALS, key=len, reverse=True))})"
_POINT = r"(?: {1,2}(?:dot|punkt|point|punto) {1,2})"
_SPELLED = re.compile(rf"(?<!\w){_NUMERAL}(?:(?:[ ,.-]{{1,2}}|{_POINT}){_NUMERAL}){{2,}}(?!\w)", re.I)
_SINGLE = re.compile(rf"(?<!\w)(?:{_NUMERAL}|dot|punkt|point|punto)(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus +(?=[0-9])", re.I)
_BETWEEN = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ -]))[oOlI](?=[0-9])")
_AT_BRACKETS = re.compile(r" {0,2}[\[({<] {0,2}(?:at|arroba|arobase) {0,2}[\])}>] {0,2}", re.I)
_DOT_BRACKETS = re.compile(r" {0,2}[\[({<] {0,2}(?:dot|punkt|point|punto) {0,2}[\])}>] {0,2}", re.I)
_DOT_WORD = re.compile(r"(?<=[A-Za-z0-9]) {1,2}(?:dot|punkt|point|punto) {1,2}(?=[A-Za-z0-9])", re.I)
# Top-level domains behind which spelled-out "at" and "dot" are taken for an address.
_TOP = "com|net|org|edu|gov|info|biz|io|co|eu|uk|us|de|at|ch|fr|es|it|nl|pt|mx|ca|au|dev|app"
# Those that count behind "dot", where any two letters do (behind "point" they are prose).
_GENERIC = "mil|int|arpa|name|pro|mobi|asia|tel|jobs|travel|museum|aero|coop|cat|xyz|online|site|shop|store|tech|cloud|club|blog|email|live|news|world|space|website|agency|digital|studio|berlin|wien|koeln|london|paris|click|link|icu|vip|top|art|page"
_THE = "the|a|an|this|that|each|every|one|some|any|no|which|what|his|her|its|my|your|our|their"
_LABEL = "[A-Za-z0-9-]{1,63}"
_BRACKETED = r" {0,2}[\[({<] {0,2}(?:dot|punkt|point|punto) {0,2}[\])}>] {0,2}"
_WORD = " {1,2}(?:dot|punkt|punto) {1,2}"
_NEXT = rf"(?:\.|{_BRACKETED}|{_WORD}| {{1,2}}point {{1,2}})"
_CHAIN = rf"(?:{_LABEL}{_NEXT}){{0,126}}"
_END = "(?![A-Za-z0-9])"
# Behind "at": any label once a separator is bracketed or two are spelled, else two letters or a listed name.
_ADDRESS = "|".join(
    (
        rf"(?:{_LABEL}{_NEXT}){{0,4}}{_LABEL}(?!\.){_NEXT}(?:{_TOP}){_END}",
        rf"{_CHAIN}{_LABEL}{_BRACKETED}{_CHAIN}[A-Za-z]{{2,}}{_END}",
        rf"{_CHAIN}{_LABEL}{_WORD}(?:{_LABEL}{_NEXT}){{0,126}}{_LABEL}{_WORD}[A-Za-z]{{2,}}{_END}",
        rf"(?!(?:{_THE}){_WORD}){_CHAIN}{_LABEL}(?:{_WORD}(?:{_LABEL}\.){{0,126}})(?:[A-Za-z]{{2}}|{_TOP}|{_GENERIC}){_END}",
    )
)
_AT_WORD = re.compile(rf"(?<=[A-Za-z0-9]) {{1,2}}(?:at|arroba|arobase) {{1,2}}(?={_ADDRESS})", re.I)
# What a text must hold for a transducer to have anything to do, as cheap tests on its bytes.
_HINTS = tuple(x.encode() for x in ("dot", "punkt", "point", "punto", "at]", "at)", "at}", "at>", "at ]", "at )", "at }", "at >", "arroba", "arobase"))
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_LETTERS = bytes(x if 97 <= x <= 122 or x > 127 else 32 for x in _LOWER)
_NUMERAL_BYTES = frozenset(x.encode() for x in _NUMERALS)
_FEWEST = 4
"""Spelled digits that the shortest identifier has."""


@lru_cache(maxsize=1 << 14)
def _folded(c: str) -> str:
    """What a character looks like; itself where that is no single ASCII character."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c) if c > "\xff" else c
    return plain if len(plain) == 1 and plain.isascii() else c


class Rewritten:
    """A text, and for pieces of it the place they have in the source."""

    def __init__(self, text: str):
        self.text = text
        self.at = [0]
        """Where pieces begin in the text, with ``source`` the place of each, begin and end."""
        self.source: list[tuple[int, int]] = [(0, len(text))]
        self.kept = [True]
        """Whether a piece stands as in the source, character by character."""

    def _piece(self, place: int) -> int:
        return bisect_right(self.at, place) - 1

    def begin(self, place: int) -> int:
        i = self._piece(place)
        return self.source[i][0] + (place - self.at[i] if self.kept[i] else 0)

    def end(self, place: int) -> int:
        """Behind the source of the character before the place."""
        i = self._piece(place - 1)
        return self.source[i][0] + place - self.at[i] if self.kept[i] else self.source[i][1]

    def replace(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        matches = [(*m.span(), by(m)) for m in pattern.finditer(self.text)]
        matches = [x for x in matches if self.text[x[0] : x[1]] != x[2]]
        if matches:
            self._apply(matches)

    def _apply(self, matches: list[tuple[int, int, str]]) -> None:
        parts, at, source, kept, size = [], [], [], [], 0

        def put(text: str, place: tuple[int, int], as_is: bool) -> None:
            nonlocal size
            if text:
                at.append(size)
                source.append(place)
                kept.append(as_is)
                parts.append(text)
                size += len(text)

        def copy(a: int, b: int) -> None:
            i = self._piece(a)
            while a < b:
                stop = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                put(self.text[a:stop], (self.begin(a), self.end(stop)), self.kept[i])
                a, i = stop, i + 1

        done = 0
        for a, b, new in matches:
            copy(done, a)
            put(new, (self.begin(a), self.end(b)), False)
            done = b
        copy(done, len(self.text))
        self.text, self.at, self.source, self.kept = "".join(parts), at or [0], source or [(0, 0)], kept or [True]


_LOOK = re.compile("[^\\x00-\\xac\\xae-\\xff]")


def _foldable(text: str) -> bool:
    """Whether there are characters beyond Latin-1, or soft hyphens."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text


def undisguised(text: str) -> Rewritten | None:
    """The text behind its disguises; None if no transducer has anything to do."""
    now = Rewritten(text)
    if _foldable(text):
        now.replace(_LOOK, lambda m: _folded(m[0]))
    data = now.text.encode(errors="surrogatepass")
    if sum(map(_NUMERAL_BYTES.__contains__, data.translate(_LETTERS).split())) >= _FEWEST:
        now.replace(_SPELLED, lambda m: "".join(_NUMERALS.get(x.lower(), ".") for x in _SINGLE.findall(m[0])))
    lowered = data.translate(_LOWER)
    if b"plus" in lowered:
        now.replace(_PLUS, lambda m: "+")
    if any(x in lowered for x in _HINTS):
        now.replace(_AT_BRACKETS, lambda m: "@")
        now.replace(_AT_WORD, lambda m: "@")
        now.replace(_DOT_BRACKETS, lambda m: ".")
        now.replace(_DOT_WORD, lambda m: ".")
    if _DIGIT.search(now.text):
        now.replace(_BETWEEN, lambda m: "0" if m[0] in "oO" else "1")
    return None if now.text == text else now


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain identifiers, and those with the disguised ones that no plain one contains."""
    base = identifiers(text or "")
    now = undisguised(text or "")
    if now is None:
        return base, base
    more = {(kind, now.begin(a), now.end(b)) for kind, a, b in identifiers(now.text)}
    added = [x for x in more if not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in base)]
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _arrow(spans: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], kind)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for each row of ``docs(doc_id, text)``.

    Both are arrays of kind, start and end in characters (code points), by kind and place: ``base``
    the identifiers that stand plainly, ``spans`` those and the disguised ones. Null and empty
    texts have none. Repeated rows get a row each. An empty table gives no rows.
    """

    def run(texts):
        found = [find(x) for x in texts]
        return pa.StructArray.from_arrays([_arrow([x for x, _ in found]), _arrow([x for _, x in found])], ["base", "spans"])

    found = text_udf(run, f"struct<base:{_SPANS},spans:{_SPANS}>")("text").alias("found")
    return pick(docs, "doc_id", "text").select("doc_id", found).select("doc_id", "found.base", "found.spans")


def redacted(text: str | None) -> str | None:
    """The text with the kind of each identifier in its place; overlapping ones become one."""
    if not text:
        return text
    parts, done = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda x: (x[1], -x[2])):
        if a >= done:
            parts += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*parts, text[done:]]) if parts else text


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every identifier of the column replaced; other columns stay as they are."""
    run = text_udf(lambda texts: pa.array(map(redacted, texts), pa.string()), "string")
    own = place_of(docs, column)
    return unnamed(docs).withColumn(own, run(own)).toDF(*docs.columns)
