"""Statistics of whole texts that the quality operators share.

Words are maximal runs outside U+0020 and U+0009-U+000D. All counts are of
the whole text; a null text counts as empty.
"""

import numpy as np
import xxhash

from . import common

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Length of the word windows whose repeats are counted.
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_same")


def repeated(words):
    """How many words lie in windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    acc = common.mix64(h[:n])
    for k in range(1, WINDOW):
        acc = common.mix64(acc * np.uint64(31) + h[k : k + n])
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(acc, twice)
    step = np.zeros(len(words) + 1, np.int64)
    step[np.flatnonzero(hit)] += 1
    ends = np.flatnonzero(hit) + WINDOW
    step[ends] -= 1
    return int((np.cumsum(step) > 0).sum())


_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 mark, 5 continuation
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "!?|"]] = 4
_CLASS[128:192] = 5


def counts(data):
    """The COUNTS of one text given as bytes or None."""
    if not data:
        return (0,) * len(COUNTS)
    words = data.split()
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6)
    points = len(data) - int(kinds[5])
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (
        len(words),
        points - sum(map(data.count, SPACES)),
        sum(map(data.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        int(kinds[1]),
        int(kinds[1] + kinds[2]),
        int(kinds[3]),
        int(kinds[4]),
        len(set(words)),
        same,
    )


FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "line_length", "upper", "letters", "digits", "marks", "distinct", "same")


def features(c):
    """FEATURES of a matrix of counts, one row for each text."""
    c = np.asarray(c, np.float64).reshape(-1, len(COUNTS))
    words, chars, symbols, dup, rep, lines, upper, letters, digits, marks, distinct, same = c.T
    w, ch, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    # A longer text repeats words as a matter of course; the exponent takes that out.
    return np.stack([np.log1p(words), chars / w, symbols / ch, dup / ln, rep / w, np.log1p(words / ln), upper / np.maximum(letters, 1), letters / ch, digits / ch, marks / ch, distinct / w**0.8, same / w], axis=1)
