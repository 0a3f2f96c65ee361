"""Restoring disguised words: a noisy channel over characters, decoded by Viterbi.

A disguised stretch of text is a lattice: digits and signs may stand for letters or
for nothing, a run of one letter for one or two of it, separators and white space
for nothing or for the end of a word.  The likeliest path under a character trigram
model of the corpus is the restored text; where words end in it is the model's
choice as well.  Stretches of any length are decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import groupby

import numpy as np

# The letters for which digits and signs are written.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'`^"
ENDS = " .,;:?\"')]}%#&<>/\\=[{"

#: Three or more single characters, parted by white space or a separator.
SPELT = re.compile(r"(?<!\S)(?:\S(?:\s++|[.\-_*~])){2,}\S(?!\S)")
PART = re.compile(r"(\S)(\s++|[.\-_*~]|\Z)")
THRICE = re.compile(r"(.)\1\1")
DISGUISED = re.compile(r"[\W\d_]|(.)\1\1")

LOOKALIKE, INSERTED, SILENT, LESS, DOUBLED, KEPT = (math.log(p) for p in (0.05, 0.0005, 0.02, 0.3, 0.1, 0.01))
#: Spacing is silent or the end of a word: the usual one of a spelt-out stretch, another one in it, and that between the parts of a split word.
USUAL, UNUSUAL, SPLIT = ((math.log(p), math.log(1 - p)) for p in (0.7, 0.2, 0.02))
#: What ends a word inside a lattice.
BREAK = " "


def letter(c: str) -> str:
    """A letter of the model's alphabet (lower-case Latin), or the one sign for all others."""
    return c if "a" <= c <= "z" or "ß" <= c <= "ɏ" else "?"


#: The model's alphabet by number: white space, the sign for all other characters, letters.
ALPHABET = " ?" + "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(ord("ß"), ord("ɏ") + 1)]))
#: Characters whose trigrams are counted at a time.
AT_ONCE = 1 << 20


def character_classes() -> np.ndarray:
    """By code point the number in ALPHABET, and -1 for what is stripped from a word's ends."""
    out = np.ones(0x110000, np.int16)
    for number, c in enumerate(ALPHABET):
        if c != "?":
            out[ord(c)] = number
    out[[c for c in range(0x3001) if chr(c).isspace()]] = 0
    out[[ord(c) for c in ENDS if c != " "]] = -1
    return out


def trigrams(texts: Iterable[str]) -> Counter[str]:
    """Trigrams of the texts' words in lower case, without ENDS around them, with two spaces before and one after."""
    out: Counter[str] = Counter()
    classes = character_classes()

    def count(joined: str) -> None:
        codes = classes[np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate(([0], codes, [0]))
        # a run of spaces and ENDS that has a space is white space; else its ENDS stand inside a word
        blank = codes <= 0
        run = np.cumsum(blank & np.concatenate(([True], ~blank[:-1])), dtype=np.int32) - 1
        spaced = np.zeros(run[-1] + 1, bool)
        spaced[run[codes == 0]] = True
        codes = np.where(blank & spaced[run], 0, np.abs(codes))
        # words two spaces apart
        space = codes == 0
        keep = ~space | np.concatenate(([True], ~space[:-1]))
        codes, space = codes[keep], space[keep]
        codes = np.repeat(codes, np.where(space, 2, 1))
        # every letter, and the first space after a word
        end = np.flatnonzero((codes[2:] > 0) | (codes[1:-1] > 0)) + 2
        used, _ = counted(np.bincount(codes))
        n = len(used)
        dense = np.zeros(len(ALPHABET), np.int32)
        dense[used] = np.arange(n)
        codes = dense[codes]
        found = (codes[end - 2] * n + codes[end - 1]) * n + codes[end]
        grams, counts = counted(np.bincount(found)) if n <= 160 else np.unique(found, return_counts=True)
        for gram, m in zip(grams.tolist(), counts.tolist(), strict=True):
            out["".join(ALPHABET[used[k]] for k in (gram // (n * n), gram // n % n, gram % n))] += m

    waiting, size = [], 0
    for text in texts:
        for k in range(0, len(text), AT_ONCE) or (0,):
            part = text[k : k + AT_ONCE]
            waiting.append(part)
            size += len(part)
            if size >= AT_ONCE:
                count("\n".join(waiting))
                waiting, size = [], 0
    if waiting:
        count("\n".join(waiting))
    return out


def counted(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a table counts, and how often they occur."""
    found = np.flatnonzero(table)
    return found, table[found]


class Model:
    """Character trigrams, smoothed with bigrams and letters."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three = counts
        self.two: Counter[str] = Counter()  # by the last two characters
        self.one: Counter[str] = Counter()
        self.pair: Counter[str] = Counter()  # by the first two
        self.start: Counter[str] = Counter()
        for gram, n in counts.items():
            self.pair[gram[:2]] += n
            self.two[gram[1:]] += n
            self.start[gram[1]] += n
            self.one[gram[2]] += n
        self.total = sum(self.one.values())
        self.known: dict[str, float] = {}  # bounded by the alphabet

    def log(self, gram: str) -> float:
        """Of the third character after the first two."""
        found = self.known.get(gram)
        if found is None:
            single = (self.one[gram[2]] + 1) / (self.total + 500)
            double = (self.two[gram[1:]] + 5 * single) / (self.start[gram[1]] + 5)
            found = self.known[gram] = math.log((self.three.get(gram, 0) + 5 * double) / (self.pair[gram[:2]] + 5))
        return found


Alternatives = list[tuple[str, float]]


def choices(word: str) -> list[Alternatives]:
    """What each run of one character may have been, with the channel's log probability."""
    out = []
    for c, run in groupby(word):
        n = len(list(run))
        if c in LOOKALIKES:
            one = [(a, LOOKALIKE) for a in LOOKALIKES[c]] + [("", INSERTED)]
            out.append([*one, *((a * 2, LOOKALIKE + LESS) for a in LOOKALIKES[c] if n > 1), ("?", KEPT)])
        elif c in SEPARATORS or not c.isalnum():
            out.append([("", SILENT), ("?", KEPT)])
        elif n > 2:
            out.append([(c, LESS), (c * 2, LESS)])
        elif n == 2:
            out.append([(c * 2, 0.0), (c, DOUBLED)])
        else:
            out.append([(c * n, 0.0)])
    return out


def spaced_choices(parts: list[str], spacing: list[tuple[float, float]]) -> list[Alternatives]:
    """The lattice of parts with spacing between them, which is silent or ends a word."""
    out = choices(parts[0])
    for part, (silent, ending) in zip(parts[1:], spacing, strict=True):
        out += [[("", silent), (BREAK, ending)], *choices(part)]
    return out


def decoded(lattice: list[Alternatives], model: Model) -> str:
    """The likeliest path through a lattice; of equally likely ones the greatest text of the last step.  Paths are kept as links backwards, so that time grows with the length alone."""
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for alternatives in lattice:
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (value, path) in best.items():
            for text, channel in alternatives:
                v, s = value + channel, state
                if text == BREAK:
                    if s == "  ":
                        continue  # a word has a letter at least
                    v, s = v + model.log(s + " "), "  "
                else:
                    for c in text:
                        c = letter(c)
                        v += model.log(s + c)
                        s = s[1] + c
                known = after.get(s)
                if known is None or v > known[0]:
                    after[s] = (v, (text, path) if text else path)
        best = after
    _, _, path = max((v + model.log(s + " "), s, path) if s != "  " else (v, s, path) for s, (v, path) in best.items())
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def restored(word: str, model: Model) -> str:
    """The likeliest word behind a disguised one (in lower case)."""
    return decoded(choices(word), model)


def plain_word(word: str, model: Model) -> str:
    """A word (in lower case) without what may stand around it, and restored if it is disguised; empty if nothing is left."""
    if word.isalpha() and not THRICE.search(word):
        return word
    plain = word.strip(ENDS)
    bare = plain.rstrip("!*$|-_~")
    if bare and not DISGUISED.search(bare):
        return bare
    return restored(plain, model).strip("?") if any(c.isalpha() for c in plain) else plain


def spelt_out(lower: str, model: Model) -> list[str]:
    """The words that spelt-out stretches of a text make up, by the likeliest choice of where they end."""
    out = []
    for m in SPELT.finditer(lower):
        parts, between = zip(*PART.findall(m[0]), strict=True)
        if any(p.isalpha() for p in parts) and len(set(parts)) > 1:
            (usual, _), *_ = Counter(between[:-1]).most_common(1)
            spacing = [USUAL if x == usual else UNUSUAL for x in between[:-1]]
            out += [w for w in (x.strip("?") for x in decoded(spaced_choices(list(parts), spacing), model).split(BREAK)) if len(w) > 1]
    return out


def joins(first: str, second: str, model: Model) -> bool:
    """Whether two parts are likelier one split word than two words."""
    return BREAK not in decoded(spaced_choices([first, second], [SPLIT]), model)
