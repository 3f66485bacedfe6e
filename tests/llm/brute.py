"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def exact(rows: list[tuple[int, str | None]]) -> set[tuple]:
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return {(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


def repeats(rows: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    split = {i: words(t) for i, t in rows}
    seen = Counter(tuple(w[k:k + window]) for w in split.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}


def near(rows: list[tuple[int, str | None]], width: int = 5, percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    of = components(ids, links)
    return {i: (len(sets[i]), of[i], of[i] == i) for i in ids}


def tiling(doc: list[str], item: list[str], least: int) -> int:
    """Words covered by greedy string tiling, by looking at every pair of places again for each tile."""
    used_doc, used_item, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not (used_item[i + k] or used_doc[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        n, i, j = best
        if n < least:
            return total
        used_item[i:i + n] = used_doc[j:j + n] = [True] * n
        total += n


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def language_models(rows, target: set[int], word_share: float, pair_share: float, weight: float, add: float) -> dict:
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    single, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in split.items():
        for m in (0, 1)[: 1 + (i in target)]:
            single[m].update(w)
    total = [sum(c.values()) for c in single]
    kept = {w for w, n in single[0].items() if n >= total[0] * word_share}
    named = {i: [w if w in kept else None for w in ws] for i, ws in split.items()}
    for i, w in named.items():
        for m in (0, 1)[: 1 + (i in target)]:
            pairs[m].update(zip(["<s>", *w[:-1]], w, strict=False))
    common = {k for k, n in pairs[0].items() if n >= total[0] * pair_share}
    out = {}
    for i, w in named.items():
        losses = []
        for m in (0, 1):
            loss = 0.0
            for v, x in zip(["<s>", *w[:-1]], w, strict=False):
                after = sum(n for k, n in pairs[m].items() if k[0] == v)
                held = sum(n for k, n in pairs[m].items() if k[0] == v and k in common)
                own = single[m][x] if x is not None else sum(n for y, n in single[m].items() if y not in kept)
                p = (1 - weight * held / max(after, 1)) * (own + add) / (total[m] + add * (len(kept) + 1))
                p += weight * pairs[m][v, x] / max(after, 1) if (v, x) in common else 0
                loss -= math.log2(p)
            losses.append(loss / len(w) if w else None)
        out[i] = (len(w), losses[1], losses[0])
    return out


def cross_entropies(rows, target: set[int], weight: float = 0.6, add: float = 0.5) -> dict:
    """`language_models` with every word and pair, in one pass over counters."""
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    word, pair, context = ([Counter(), Counter()] for _ in range(3))
    for i, w in split.items():
        for m in (0, 1)[: 1 + (i in target)]:
            word[m].update(w)
            pair[m].update(zip(["<s>", *w[:-1]], w, strict=False))
            context[m].update(["<s>", *w[:-1]] if w else [])
    total, classes, out = [sum(c.values()) for c in word], len(word[0]) + 1, {}
    for i, w in split.items():
        losses = []
        for m in (1, 0):
            loss = 0.0
            for v, x in zip(["<s>", *w[:-1]], w, strict=False):
                after = context[m][v]
                own = (word[m][x] + add) / (total[m] + add * classes)
                loss -= math.log2((1 - weight * (after > 0)) * own + weight * pair[m][v, x] / max(after, 1))
            losses.append(loss / len(w) if w else None)
        out[i] = (len(w), *losses)
    return out


def edge_rows() -> list[tuple[int | None, str | None]]:
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    again = "one two three four five six seven eight nine ten"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "short"), (5, again), (6, again), (6, again), (None, again), (None, None),
        (7, long_text), (8, long_text + " tail"), (9, "x" * 300_000), (10, again + "\n" + again), (11, "été ¿qué? 日本語 😀 <|endoftext|> á"),
    ]
