"""Pre-tokens of byte-level BPE for whole batches of texts, without a Python loop over characters.

A run is a maximal stretch of letters, digits, white space or other characters. One plain space goes
with the run after it, a contraction is a token of its own, and of white space before a token the
last character stands apart. Texts with characters whose class the byte table doesn't know go through
the tokenizer's own pattern instead; both ways give the same tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the vocabulary
)
SPECIAL = b"<|endoftext|>"


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[128:] = LETTER
    return out


CLASSES = _classes()


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with other than ASCII and the Latin letters U+00C0 to U+023F, or with the special string.

    Known are the lead bytes C3 to C8 but for the two signs among them; ASCII separators 1C to 1F
    are left to the pattern too.
    """
    bad = (data > 0xC8) | (data == 0xC2) | ((data >= 0x1C) & (data <= 0x1F))
    bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    at = np.flatnonzero(bad)
    if SPECIAL in data.tobytes():
        bar = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        at = np.concatenate((at, bar))
    rows = np.zeros(len(offsets) - 1, bool)
    rows[np.searchsorted(offsets, at, side="right") - 1] = True
    return rows


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all tokens, for texts that odd_texts doesn't name; a text starts a token."""
    n = len(data)
    kind = CLASSES[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    # White space before a token: its last character starts anew; a plain space takes the token with it.
    before = np.flatnonzero(cut[1:n] & (kind[:-1] == SPACE)) + 1
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    before = before[~text_start[before]]
    cut[before - 1] = True
    cut[before[data[before - 1] == 32]] = False
    # Contractions: an apostrophe that starts a token and is followed by one of the fixed endings.
    quotes = np.flatnonzero((data == 39) & cut[:n])
    if len(quotes):
        limit = offsets[np.searchsorted(offsets, quotes, side="right")]
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quotes + 1 < limit)
        pair = one.astype(np.int32) * 256 + two
        long = np.isin(pair, [x[0] * 256 + x[1] for x in (b"re", b"ve", b"ll")]) & (quotes + 2 < limit)
        for hit, size in ((quotes[short], 2), (quotes[long], 3)):
            ends = hit + size
            cut[hit + 1] = False
            # What follows is a token of its own, also where it goes on with the same letters.
            cut[ends] = True
    return np.flatnonzero(cut[:n])


def split_text(text: bytes) -> list[bytes]:
    """Tokens of one text by the pattern; the special string stands as a token."""
    out: list[bytes] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(SPECIAL)
        out += [x.encode() for x in PATTERN.findall(part.decode(errors="replace"))]
    return out


def token_lists(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Row number and tokens of each text in order."""
    odd = odd_texts(data, offsets)
    raw = data.tobytes()
    starts = boundaries(data, offsets) if len(data) else np.zeros(0, np.int64)
    bounds = starts.tolist()
    first = np.searchsorted(starts, offsets).tolist()
    ends = offsets.tolist()
    for row, strange in enumerate(odd.tolist()):
        if strange:
            yield row, split_text(raw[ends[row] : ends[row + 1]])
        else:
            at = [*bounds[first[row] : first[row + 1]], ends[row + 1]]
            yield row, [raw[a:b] for a, b in zip(at, at[1:])]
