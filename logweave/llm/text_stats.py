"""Measures of a whole text that the quality rules and the quality classifier vote on."""

import itertools
import operator
from collections import Counter
from typing import NamedTuple

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_NOT_SYMBOLS = str.maketrans("", "", SYMBOLS)
_ONE_SYMBOL = str.maketrans(SYMBOLS, "#" * len(SYMBOLS))


class Stats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_shouted: int
    n_upper: int
    n_marks: int
    n_distinct: int
    n_lines: int
    n_same_next: int
    n_symbol_words: int
    n_chars: int


def measure(text: str | None) -> Stats:
    """Words are runs of bytes other than space and \\x09-\\x0D; a null text has none. All counts are over the whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    repeats = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            seen, last = Counter(grams), -1
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeats += i + 2 - max(last, i - 1)
                    last = i + 2
    symbols = len(text) - len(text.translate(_NOT_SYMBOLS))
    marked = sum(map(operator.contains, text.translate(_ONE_SYMBOL).split(), itertools.repeat("#"))) if symbols else 0
    upper = sum(map(str.isupper, text.split()))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return Stats(n, len(text) - white, symbols, len(lines) - len(set(lines)), repeats, text.count("!!"), upper, text.count(".") + text.count("?"), len(set(words)), len(lines), same, marked, len(text))
