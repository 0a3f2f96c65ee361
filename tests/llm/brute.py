"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return text.encode().lower().decode()


def without_repeats(docs: dict[int, str | None], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc_id in sorted(docs):
        data = (docs[doc_id] or "").encode()
        gone = bytearray(len(data))
        for start in range(len(data) - length + 1):
            piece = data[start : start + length]
            if piece in seen:
                gone[start : start + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def contamination(docs: dict[int, str | None], items: dict[str | None, str | None]) -> dict[int, tuple]:
    phrases: dict[tuple, set[str]] = {}
    for item, text in items.items():
        words = PLAIN_WORD.findall(lower(text or ""))
        width = min(13, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            phrases.setdefault(tuple(words[k : k + width]), set()).add(item)
    widths = {len(p) for p in phrases}
    out = {}
    for doc_id, text in docs.items():
        words = PLAIN_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for width in widths:
            for k in range(len(words) - width + 1):
                owners = phrases.get(tuple(words[k : k + width]))
                if owners:
                    found |= owners - {None}
                    hit.update(range(k, k + width))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words))
    return out
