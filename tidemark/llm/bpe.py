"""Byte-pair encoding by dynamic programming over prefixes.

A sequence of tokens is what byte-pair encoding makes of its bytes exactly when
every two neighbours are what it makes of theirs.  So each prefix of a piece has
one last token: the vocabulary entry that ends there and may follow the last
token of the prefix before it.  One pass over a piece finds that token, and with
it the exact number of tokens, for every prefix; the encoding of any prefix is
read backwards from its last token, without encoding again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

# How this vocabulary's tokenizer cuts a text into pieces, and its added token.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")

#: White space other than a space and a line feed, as any of the libraries sees it.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pairs of neighbours that an encoder knows of at most; beginnings of pieces are a tenth.
KEPT = 400_000
#: Bytes of what is known of whole words.
WORDS_BYTES = 96 << 20
#: Bytes at the start of a piece whose prefixes are kept.
SHARED = 6
#: Last bytes of a prefix that bound how long its last token may be.
ENDING = 4


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary spells each byte: itself if printable, else the next letter from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """A byte-level BPE vocabulary (the text of a `tokenizers` file) and what it has seen."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        spec, letters = json.loads(vocabulary), byte_letters()
        spelt = lambda word: bytes(letters[c] for c in word)
        self.ids = {spelt(word): number for word, number in spec["model"]["vocab"].items() if all(c in letters for c in word)}
        pairs = (merge.split(" ") if isinstance(merge, str) else merge for merge in spec["model"]["merges"])
        self.ranks = {(spelt(a), spelt(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # by token the merge that makes it: its rank and its two parts
        self.made = {a + b: (rank, a, b) for (a, b), rank in reversed(self.ranks.items())}
        # entries that merging never leaves as they are can't be tokens of any text
        self.ids = {word: number for word, number in self.ids.items() if len(word) == 1 or (word in self.made and self.apart(*self.made[word][1:], self.made[word][0]))}
        self.longest: dict[bytes, int] = {}  # by the last ENDING bytes, where a token has as many
        for word in self.ids:
            if len(word) >= ENDING:
                self.longest[word[-ENDING:]] = max(self.longest.get(word[-ENDING:], 0), len(word))
        self.follows: dict[bytes, dict[bytes, bool]] = {b"": dict.fromkeys(self.ids, True)}
        self.pairs = 0
        self.started: dict[bytes, tuple] = {}
        self.cut = regex.compile(PIECES).findall
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None

    def apart(self, left: bytes, right: bytes, limit: int = 1 << 60) -> bool:
        """Whether no merge of rank below `limit` joins these neighbours.

        Going back in time, the later of the two last merges is undone: the parts that
        then meet would have been joined had their own merge come before it.  Of equal
        merges the one on the left is done first.
        """
        made, ranks = self.made, self.ranks
        while ranks.get((left, right), limit) >= limit:
            a, b = made.get(left, (-1,)), made.get(right, (-1,))
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True
        return False

    def may_follow(self, last: bytes, word: bytes) -> bool:
        if self.pairs > KEPT:
            for last_known in filter(None, self.follows):
                self.follows[last_known].clear()
            self.pairs = 0
        self.pairs += 1
        may = self.follows[last][word] = self.apart(last, word)
        return may

    def prefixes(self, data: bytes) -> tuple[list[int], list[int]]:
        """For each prefix of a piece: how many tokens it has, and where its last token begins.  The first SHARED bytes, which many pieces have in common, are done once."""
        if len(data) <= SHARED:
            return self.extended(data, [0], [0], [{}])[:2]
        start = data[:SHARED]
        if start not in self.started:
            if len(self.started) >= KEPT // 10:
                self.started.clear()
            self.started[start] = self.extended(start, [0], [0], [{}])
        counts, begins, after = self.started[start]
        return self.extended(data, counts[:], begins[:], after[:])[:2]

    def extended(self, data: bytes, counts: list[int], begins: list[int], after: list[dict]) -> tuple[list[int], list[int], list[dict]]:
        """The same from a prefix that is done.  after: by prefix, what is known to follow its last token."""
        ids, longest, follows = self.ids, self.longest, self.follows
        if len(counts) == 1:
            after[0] = follows[b""]
        for end in range(len(counts), len(data) + 1):
            begin = end - longest.get(data[end - ENDING : end], ENDING - 1) if end > ENDING else 0
            for begin in range(begin if begin > 0 else 0, end):  # noqa: B020
                word = data[begin:end]
                if word in ids:
                    may = after[begin].get(word)
                    if may is None:
                        may = self.may_follow(data[begins[begin] : begin], word)
                    if may:
                        break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
            counts.append(counts[begin] + 1)
            begins.append(begin)
            after.append(follows.setdefault(word, {}))
        return counts, begins, after

    def tokens(self, data: bytes) -> list[int]:
        """The ids of a piece, read backwards from its last token."""
        _, begins = self.prefixes(data)
        out, end = [], len(data)
        while end:
            out.append(self.ids[data[begins[end] : end]])
            end = begins[end]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        """The pieces that are encoded apart.  Letters beyond the Latin blocks and unusual white space are left to the library, whose tables decide."""
        if text.isascii() or max(text) < "ɐ":
            if not ODD_SPACE.search(text):
                return self.cut(text)
        letters = byte_letters()
        return [bytes(letters[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between added tokens (id None) and those tokens themselves."""
        if self.special is None or not any(x in text for x in self.added):
            return [(text, None)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.added[m[0]])]
            at = m.end()
        return [x for x in [*out, (text[at:], None)] if x[0]]

    def count(self, text: str) -> int:
        """How many tokens a text has: the count at its last prefix, piece by piece."""
        return sum(1 if special is not None else sum(self.prefixes(piece.encode())[0][-1] for piece in self.pieces(part)) for part, special in self.parts(text))


def merging_engine(vocabulary: str) -> Callable[[str], list[int]] | None:
    """tiktoken's merging under the same vocabulary, several times as fast; None where it needn't give the same ids.

    That engine joins any two neighbours whose bytes are an entry, the least id first.
    It is given those entries alone that merging makes of their own bytes.  Where their
    ids follow the order of merges, that is the same: bytes that no earlier merge has
    crossed are by then in the two parts that the entry's own merge names.
    """
    import tiktoken

    model, encoder = json.loads(vocabulary)["model"], Encoder(vocabulary)
    made = sorted(encoder.made.items(), key=lambda x: x[1][0])
    reached = {bytes([b]) for b in range(256)} & encoder.ids.keys()
    plain = len(reached) == 256 and len(made) == len(encoder.ranks)
    for word, (_, left, right) in made:
        if word in encoder.ids and left in reached and right in reached:
            reached.add(word)
    ids = [encoder.ids[word] for word, _ in made if word in reached]
    if not plain or ids != sorted(set(ids)) or any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    return tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks={word: encoder.ids[word] for word in reached}, special_tokens={}).encode_ordinary


def spaced_apart(text: str) -> bool:
    """Whether every space stands between two characters that are no white space (or at an end), so that the text can be cut before each space and the parts encoded apart."""
    return "  " not in text and " \n" not in text and "\n " not in text and not ODD_SPACE.search(text)


def last_cut(text: str) -> int:
    """The last place before which a text may be cut without changing its pieces, whatever follows: a space or line end after no white space.  0 if there is none."""
    for k in range(len(text) - 1, 0, -1):
        if text[k] in " \n" and not text[k - 1].isspace():
            return k
    return 0


def prefix_counts(encoder: Encoder, text: str) -> list[int]:
    """The exact number of tokens of text[:i], for each i from 0 to its length."""
    counts, done, begin = [0], 0, 0  # done: tokens of all pieces before; begin: where the text since the last added token does
    for part, special in encoder.parts(text):
        if special is not None:
            # a prefix that cuts the added token's text has it as ordinary text after the last word before
            here = len(counts) - 1
            cut = begin + last_cut(text[begin:here])
            word = text[cut:here]
            counts += [counts[cut] + encoder.count(word + part[:k]) for k in range(1, len(part))] + [done + 1]
            done, begin = done + 1, here + len(part)
            continue
        space, before_space = "", done
        for piece in encoder.pieces(part):
            by_byte, _ = encoder.prefixes(piece.encode())
            at = 0
            for k, c in enumerate(piece):
                at += len(c.encode())
                n = done + by_byte[at]
                if piece in CONTRACTIONS and k == 1:
                    n = done + 2  # an apostrophe and a letter are no contraction yet
                elif k == 0 and space and c == " ":
                    n = before_space + encoder.prefixes((space + c).encode())[0][-1]  # ends in white space: one piece as yet
                counts.append(n)
            if piece.isspace():
                if not space:
                    before_space = done
                space += piece
            else:
                space = ""
            done += by_byte[-1]
    return counts
