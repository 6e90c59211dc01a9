"""Plain Python restatements of what the operators compute, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def spans(mask: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, m in enumerate([*mask, False]):
        if m and start is None:
            start = i
        elif not m and start is not None:
            out.append((start, i))
            start = None
    return out


def repeated_bytes(docs: dict[int, str | None], size: int = 100) -> dict:
    seen, out = set(), {}
    for doc in sorted(docs):
        data = (docs[doc] or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - size + 1):
            if data[i : i + size] in seen:
                gone[i : i + size] = [True] * size
            seen.add(data[i : i + size])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = (len(data), sum(gone), spans(gone), kept)
    return out


def repeated_words(docs: dict[int, str | None], size: int = 13) -> dict:
    seen, out = set(), {}
    for doc in sorted(docs):
        words = PLAIN.findall(docs[doc] or "")
        gone, mine = [False] * len(words), []
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            mine.append(window)
            if window in seen:
                gone[i : i + size] = [True] * size
        seen.update(mine)
        out[doc] = (len(words), sum(gone), spans(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def repeated_lines(docs: dict[int, str | None], size: int = 3) -> dict:
    seen, out = set(), {}
    for doc in sorted(docs):
        lines = docs[doc].split("\n") if docs[doc] is not None else []
        gone = [False] * len(lines)
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[doc] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = PLAIN.findall((text or "").translate(UP))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_components(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in docs.items()}
    label = {d: d for d in docs}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    posting = collections.defaultdict(list)
    for d in sorted(docs):
        common = collections.Counter(e for s in sets[d] for e in posting[s])
        for e, n in common.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                label[b] = a
        for s in sets[d]:
            posting[s].append(d)
    return {d: root(d) for d in docs}


def contamination(text: str | None, items: dict[int, str | None], size: int = 13) -> tuple[int, int, list[int]]:
    words = ALNUM.findall((text or "").translate(UP))
    hit, found = [False] * len(words), set()
    for item, item_text in items.items():
        own = ALNUM.findall((item_text or "").translate(UP))
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
                found.add(item)
    return len(words), sum(hit), sorted(found)
