"""The splitting pattern of byte-level tokenizers as a finite transducer.

The pattern (contractions, letters, digits, other signs, white space with one sign
of look-ahead) is compiled into 13 states over 12 character classes. Every
transition says whether a piece starts at the sign just read, and whether one
starts at the sign before it, which is how look-ahead of one sign is written with
a delay of one sign.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

LETTER_STMD, LETTER_R, LETTER_V, LETTER_E, LETTER_L, LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER, STOP = range(12)
N_CLASSES = 12
START, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_QR, S_QV, S_QL, S_SHORT, S_B1, S_W1, S_B2, S_W2 = range(13)
N_STATES = 13
HERE, BEFORE = 1, 2
CHUNK = 64

_KNOWN = np.full(0x110000, 255, dtype=np.uint8)
_CLASSES = [
    (regex.compile(r"\p{L}"), LETTER),
    (regex.compile(r"\p{N}"), NUMBER),
    (regex.compile(r"\s"), SPACE),
]


def _class_of(point: int) -> int:
    sign = chr(point)
    special = {"r": LETTER_R, "v": LETTER_V, "e": LETTER_E, "l": LETTER_L, " ": BLANK, "'": QUOTE}
    if sign in special:
        return special[sign]
    if sign in "stmd":
        return LETTER_STMD
    if unicodedata.category(sign) == "Cn":
        # Assigned lately, if at all: character tables of libraries differ here, so
        # ask the tokenizer library whether the sign joins a letter or a digit.
        joins = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        return LETTER if len(joins("a" + sign)) == 1 else NUMBER if len(joins("1" + sign)) == 1 else OTHER
    return next((kind for pattern, kind in _CLASSES if pattern.match(sign)), OTHER)


def classes(points: np.ndarray) -> np.ndarray:
    """Character class of every code point; classes are looked up once per sign."""
    found = _KNOWN[points]
    missing = np.unique(points[found == 255])
    if len(missing):
        _KNOWN[missing] = [_class_of(int(p)) for p in missing]
        found = _KNOWN[points]
    return found


def _compile() -> tuple[np.ndarray, np.ndarray]:
    target = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    says = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    letters = (LETTER_STMD, LETTER_R, LETTER_V, LETTER_E, LETTER_L, LETTER)

    def fresh(kind: int) -> int:
        """State after a sign that opens a piece."""
        if kind in letters:
            return S_LETTER
        return {NUMBER: S_NUMBER, BLANK: S_B1, SPACE: S_W1, QUOTE: S_QUOTE, OTHER: S_OTHER, STOP: START}[kind]

    def joined(kind: int) -> int:
        """State after a sign that the blank before it belongs to."""
        return S_OTHER if kind == QUOTE else fresh(kind)

    for state in range(N_STATES):
        for kind in range(N_CLASSES):
            opens = 0 if kind == STOP else HERE
            go, say = fresh(kind), opens
            if state == S_LETTER and kind in letters:
                go, say = S_LETTER, 0
            elif state == S_NUMBER and kind == NUMBER:
                go, say = S_NUMBER, 0
            elif state == S_OTHER and kind in (OTHER, QUOTE):
                go, say = S_OTHER, 0
            elif state == S_QUOTE:
                if kind in (OTHER, QUOTE):
                    go, say = S_OTHER, 0
                elif kind == LETTER_STMD:
                    go, say = S_SHORT, 0
                elif kind in (LETTER_R, LETTER_V, LETTER_L):
                    # Piece start here or part of a contraction: the next sign tells.
                    go, say = {LETTER_R: S_QR, LETTER_V: S_QV, LETTER_L: S_QL}[kind], 0
            elif state in (S_QR, S_QV, S_QL):
                if kind == (LETTER_L if state == S_QL else LETTER_E):
                    go, say = S_SHORT, 0
                elif kind in letters:
                    go, say = S_LETTER, BEFORE
                else:
                    say = BEFORE | opens
            elif state in (S_B1, S_W1):
                if kind in (BLANK, SPACE):
                    go, say = (S_B2 if kind == BLANK else S_W2), 0
                elif state == S_B1:
                    go, say = joined(kind), 0
            elif state in (S_B2, S_W2):
                if kind in (BLANK, SPACE):
                    go, say = (S_B2 if kind == BLANK else S_W2), 0
                elif kind == STOP:
                    say = 0
                elif state == S_B2:
                    go, say = joined(kind), BEFORE
                else:
                    say = BEFORE | opens
            target[state, kind], says[state, kind] = go, say
    return target, says


TARGET, SAYS = _compile()
# The same transitions on states times N_CLASSES, so that a step is one addition
# and one look-up.
_FLAT = (TARGET * N_CLASSES).reshape(-1)


def state_maps(kinds: np.ndarray) -> np.ndarray:
    """Map of every chunk row of ``kinds``: the end state for each start state."""
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None] * np.uint8(N_CLASSES), len(kinds), axis=1)
    for kind in np.ascontiguousarray(kinds.T):
        maps = _FLAT.take(maps + kind)
    return np.ascontiguousarray(maps.T) // np.uint8(N_CLASSES)


def entry_states(maps: np.ndarray, first: int = START) -> np.ndarray:
    """State before every chunk: parallel prefix scan over composed chunk maps."""
    scanned = maps.copy()
    step = 1
    while step < len(scanned):
        scanned[step:] = np.take_along_axis(scanned[step:], scanned[:-step], axis=1)
        step *= 2
    return np.concatenate([[first], scanned[:-1, first]]).astype(np.uint8)


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Which signs start a piece. ``kinds`` holds texts, each closed by ``STOP``."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, STOP, dtype=np.uint8)
    padded[:n] = kinds
    padded = padded.reshape(rows, CHUNK)
    state = entry_states(state_maps(padded))
    said = np.empty((rows, CHUNK), dtype=np.uint8)
    for step in range(CHUNK):
        kind = padded[:, step]
        said[:, step] = SAYS[state, kind]
        state = TARGET[state, kind]
    said = said.reshape(-1)[:n]
    starts = (said & HERE) > 0
    starts[:-1] |= (said[1:] & BEFORE) > 0
    return starts


def split_texts(
    data: np.ndarray, bounds: np.ndarray, stops: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pieces of UTF-8 texts, and the piece bounds of texts.

    ``stops`` are byte spans ``(start, end)`` that split a text and belong to no piece.
    """
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead).astype(np.int32)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kinds = classes(points)
    if stops is not None and len(stops):
        for first, last in stops:
            kinds[np.searchsorted(at, first) : np.searchsorted(at, last)] = STOP
    # A stop after every text, so that nothing runs on into the next one.
    text_ends = np.searchsorted(at, bounds[1:])
    spaced = np.insert(kinds, text_ends, STOP)
    extra = np.insert(at, text_ends, bounds[1:])
    opens = piece_starts(spaced)
    starts = extra[opens]
    # A piece ends at the next piece or stop.
    edges = np.flatnonzero(opens | (spaced == STOP))
    ends = extra[edges[np.searchsorted(edges, np.flatnonzero(opens), "right")]]
    return starts, ends, np.searchsorted(starts, bounds)
