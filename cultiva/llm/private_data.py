"""Personal data in texts, also where it is disguised."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from cultiva.llm.kernels import arrow_map

KINDS = ("email", "ip", "card", "phone")

# --- fixed values -------------------------------------------------------------
# Signs that look like an ASCII letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ɡ": "g", "ı": "i", "ɑ": "a", "ℓ": "l",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# Signs without width.
INVISIBLE = "​‌‍⁠﻿­"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
# Words before " at " and a domain that are prose, not the local part of an address.
PROSE_BEFORE_AT = (
    "a accessed accessible and apply archived are arrived as at available based be been begin best browse "
    "buy call check click contact data deposited described details directly discussed documentation documented "
    "download downloaded email employed everyone example explained find for found free freely get given go "
    "guidelines had has have help here hosted how in info information instructions is it items join just kept "
    "learn link links listed live located look looked looking looks mail maintained me meet more not now obtained "
    "of on one online only or order ordered out page pages people posted presented product products provided "
    "published read reached register registered released review reviews reported resources search see seen sell "
    "shop shown site sold staff start started stored story submitted team that the them there these this those "
    "to today up us viewed visit was watch we website were which with work worked working works write you"
).split()
# Words that announce an address in the three words before it.
ADDRESS_CUES = (
    "mail e-mail email emails write writing reach send sent address contact "
    "kontakt kontaktieren schreiben schreibe adresse mailen "
    "courriel mél écrire écrivez contacter contactez adressez "
    "correo escribir escriba escríbanos contactar dirección"
).split()
# --- end of fixed values ------------------------------------------------------

# Full-width forms of ASCII, and the ten digits of other scripts.
HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7F6) for d in range(10)}

_SIGN = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + INVISIBLE + "]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:plus[ ]+)?{_WORD}(?:(?:[ ]|[ ]?-[ ]?|,[ ])(?:{_WORD}|[0-9]))+(?!\w)", re.IGNORECASE
)
_ITEM = re.compile(rf"plus|{_WORD}|[0-9]", re.IGNORECASE)
# A run shorter than this is prose, not a number.
LEAST_SPELLED = 4
# What every run has: the end of a digit word, a separator and another word or digit.
_LAST = "".join(sorted({w[-1] for w in DIGIT_WORDS}))
_SPELLED_HINT = re.compile(rf"(?<=[{_LAST}])(?:[ ]|[ ]?-[ ]?|,[ ])(?:{_WORD}|[0-9])", re.IGNORECASE)

_HIDDEN_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?|[ ]+dot[ ]+)"
# Dotted chains of four parts or more, spelled in part: a part is up to three digits.
_PART_ITEM = rf"(?:{_WORD}|[0-9])"
_SPELLED_PART = rf"(?:[0-9]{{1,3}}|{_PART_ITEM}(?:(?:[ ]|[ ]?-[ ]?|,[ ]){_PART_ITEM}){{0,2}})(?!\w)"
_CHAIN_DOT = rf"(?:{_HIDDEN_DOT}|\.)"
_SPELLED_CHAIN = re.compile(rf"(?<![\w.]){_SPELLED_PART}(?:{_CHAIN_DOT}{_SPELLED_PART}){{3,}}", re.IGNORECASE)
_CHAIN_HINT = re.compile(rf"(?<=[{_LAST}0-9]){_CHAIN_DOT}{_PART_ITEM}", re.IGNORECASE)
_CHAIN_ITEM = re.compile(rf"{_CHAIN_DOT}|{_WORD}|[0-9]", re.IGNORECASE)

_AT = re.compile(
    r"[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?"
    rf"|(?<=[A-Za-z0-9])[ ]+at[ ]+(?=[A-Za-z0-9-]+{_HIDDEN_DOT}[A-Za-z0-9])"
    # Before a plain domain, what stands on the left decides: see _at.
    r"|(?<=[A-Za-z0-9])[ ]+at[ ]+"
    r"(?=(?!www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?-i:[a-z]{2,}|[A-Z]{2,})(?![\w/@-]|\.\w))",
    re.IGNORECASE,
)
_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_HIDDEN_DOT}(?=[A-Za-z0-9])", re.IGNORECASE)
_AT_PLAIN = re.compile(r"[A-Za-z0-9-]+\.[A-Za-z0-9]")
_PROSE = frozenset(PROSE_BEFORE_AT)
_CUES = frozenset(ADDRESS_CUES)
_CUE_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LETTER = re.compile(r"[A-Za-z]")
_ADDRESS_SIGN = re.compile(r"[._+0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with the longest local part before it and a dotted domain after it.

    The same matches as the plain pattern gives, in time linear in the text.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of every dotted chain of numbers, then the next four."""
    for chain in _NUMBERS.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = [m.span() for m in _PART.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            # Leading zeros do not count; three significant digits fit in a byte or not.
            values = [text[a:b].lstrip("0") or "0" for a, b in four]
            if all(len(v) <= 3 and int(v) <= 255 for v in values):
                yield four[0][0], four[3][1]


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(d) for d in digits[-1::-2]) % 10 == -sum(int(doubled[int(d)]) for d in digits[-2::-2]) % 10


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() > 40:
            continue
        digits = match.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(match.group())) <= 15:
            yield match.span()


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of identifiers written plainly, in order."""
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(a, b, 1) for a, b in ips(text)]
        found += [(a, b, 2) for a, b in cards(text)]
        if "+" in text:
            found += [(a, b, 3) for a, b in phones(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Mapped:
    """A text and where its parts came from, rewritten by one transducer after another.

    Pieces of the text are ``(place, source start, source end, exact)``: an exact
    piece maps sign by sign, any other stands for its source as a whole.
    """

    def __init__(self, text: str):
        self.text = text
        self.places, self.sources = [0], [(0, len(text), True)]

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace ascending spans of the present text."""
        parts, places, sources = [], [], []
        at = size = 0

        def keep(start: int, end: int) -> None:
            nonlocal size
            while start < end:
                i = bisect_right(self.places, start) - 1
                stop = min(end, self.places[i + 1]) if i + 1 < len(self.places) else end
                first, last, exact = self.sources[i]
                if exact:
                    first, last = first + start - self.places[i], first + stop - self.places[i]
                places.append(size)
                sources.append((first, last, exact))
                parts.append(self.text[start:stop])
                size += stop - start
                start = stop

        for start, end, new in changes:
            keep(at, start)
            if new:
                places.append(size)
                sources.append((self.source(start)[0], self.source(end - 1)[1], False))
                parts.append(new)
                size += len(new)
            at = end
        keep(at, len(self.text))
        self.text, self.places, self.sources = "".join(parts), places or [0], sources or [(0, 0, True)]

    def source(self, place: int) -> tuple[int, int]:
        """Source span of one sign."""
        i = bisect_right(self.places, place) - 1
        start, end, exact = self.sources[i]
        if exact:
            start += place - self.places[i]
            return start, start + 1
        return start, end


def _spelled(match: re.Match) -> str | None:
    items = _ITEM.findall(match.group())
    digits = [DIGIT_WORDS.get(i.lower(), i) for i in items if i.lower() != "plus"]
    if len(digits) < LEAST_SPELLED:
        return None
    return ("+" if items[0].lower() == "plus" else "") + "".join(digits)


def _chain(match: re.Match) -> str | None:
    items = _CHAIN_ITEM.findall(match.group())
    # Digits with plain dots are nothing to undo.
    return fresh if (fresh := "".join(_chain_item(i) for i in items)) != match.group() else None


def _chain_item(item: str) -> str:
    return item if item.isdigit() else DIGIT_WORDS.get(item.lower(), ".")


def _at(match: re.Match) -> str | None:
    """``@``; a bare "at" before a plain domain needs a sign of an address.

    That is a dot, digit, ``_`` or ``+`` within the left part, or a word such as "mail"
    or "write" among the three before it. Everything else is prose ("at example.org").
    """
    text, start = match.string, match.start()
    if match.group().strip(" ").lower() != "at" or not _AT_PLAIN.match(text, match.end()):
        return "@"
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    local = text[start : match.start()].strip("._%+-")
    if local.lower() in _PROSE or not _LETTER.search(local):
        return None
    if _ADDRESS_SIGN.search(local):
        return "@"
    before = _CUE_WORD.findall(text[max(0, start - 60) : start].lower())[-3:]
    return "@" if any(word in _CUES for word in before) else None


def deobfuscated(text: str) -> Mapped | None:
    """The text with look-alikes, spelled digits and at/dot disguises undone.

    ``None`` when there is nothing to undo.
    """
    steps = []
    if not text.isascii() and _SIGN.search(text):
        steps.append((_SIGN, lambda m: HOMOGLYPHS.get(m.group(), "")))
    mapped = Mapped(text)
    steps += [(_SPELLED_CHAIN, _chain), (_SPELLED_RUN, _spelled), (_AT, _at), (_DOT, lambda m: ".")]
    changed = False
    for pattern, new in steps:
        if pattern is _DOT and "@" not in mapped.text and not _DIGIT.search(mapped.text):
            continue
        if pattern is _SPELLED_CHAIN and not _CHAIN_HINT.search(mapped.text):
            continue
        if pattern is _SPELLED_RUN and not _SPELLED_HINT.search(mapped.text):
            continue
        changes = [
            (m.start(), m.end(), fresh) for m in pattern.finditer(mapped.text) if (fresh := new(m)) is not None
        ]
        if changes:
            mapped.rewrite(changes)
            changed = True
    return mapped if changed else None


def find_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, end, kind number, plain)`` of all identifiers, by start, then kind."""
    plain = plain_spans(text)
    found = [(*span, True) for span in plain]
    mapped = deobfuscated(text)
    if mapped is not None:
        taken = {k: sorted((a, b) for a, b, kind in plain if kind == k) for k in range(len(KINDS))}
        for start, end, kind in plain_spans(mapped.text):
            first, last = mapped.source(start)[0], mapped.source(end - 1)[1]
            spans = taken[kind]
            i = bisect_right(spans, (last, -1))
            if not any(a < last and first < b for a, b in spans[max(0, i - 1) : i + 1]):
                found.append((first, last, kind, False))
    return sorted(found, key=lambda s: (s[0], s[2]))


_FOUND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
)


def _find(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text)
        found = [
            [{"kind": KINDS[k], "start": a, "end": b, "plain": p} for a, b, k, p in find_spans(t.as_py() or "")]
            for t in texts
        ]
        yield batch.drop_columns([text]).append_column("found", pa.array(found, _FOUND))


def find_private_data(
    samples: DataFrame, key: str = "bacdive_id", text: str = "iso_sample_text"
) -> DataFrame:
    """``(key, found)``: personal data in every isolation text.

    ``found`` lists ``(kind, start, end, plain)`` by start, then kind (email, ip,
    card, phone), in code points with the end exclusive. ``plain`` spans match the
    patterns in the text itself: leftmost, non-overlapping per kind, dropped when
    their numbers fail (parts over 255, digit counts, Luhn). The others appear
    after transducers have replaced look-alike letters, digits of other scripts,
    signs without width, runs of spelled digits and written-out "at" and "dot";
    their spans are mapped back to the source text, and one that overlaps a plain
    span of its kind is left out.

    A null or empty text has an empty list; repeated rows and null keys stay rows
    of their own; other columns are ignored. Every pattern takes time linear in the
    text. There is no shuffle.
    """
    chosen = samples.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return arrow_map(
        chosen,
        partial(_find, text=text),
        f"`{key}` {kind}, found array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>",
    )


def masked(text: str) -> str:
    """The text with every identifier replaced by its kind in square brackets.

    Of overlapping identifiers the first is named; what reaches past it goes too.
    """
    parts, at = [], 0
    for start, end, kind, _ in find_spans(text):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], text: str, into: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hidden = [None if t is None else masked(t) for t in batch.column(text).to_pylist()]
        yield batch.drop_columns([text]).append_column(into, pa.array(hidden, pa.string()))


def mask_private_data(samples: DataFrame, text: str = "iso_sample_text", into: str = "masked_text") -> DataFrame:
    """``samples`` with ``text`` replaced by the column ``into``, personal data masked.

    Finds what :func:`find_private_data` finds. A null text stays null; all rows and
    other columns are kept.
    """
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name != text)
    return arrow_map(
        samples, partial(_mask, text=text, into=into), f"{others}{', ' if others else ''}`{into}` string"
    )
