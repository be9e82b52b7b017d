"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def closure(items, links):
    """Smallest item reachable from each item."""
    least = {i: i for i in items}

    def root(i):
        while least[i] != i:
            least[i] = least[least[i]]
            i = least[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            least[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def shingles(text, words):
    found = WORD.findall((text or "").encode().lower())
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def near_copies(texts: dict, words: int, percent: int):
    """{id: (set size, component)}."""
    sets = {i: shingles(t, words) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = closure(sets, links)
    return {i: (len(s), least[i]) for i, s in sets.items()}


def repeats(texts: list, length: int):
    """(bytes, removed, spans, sha256 of what is left) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                covered[i:i + length] = True
        covered = covered[:len(d)]
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        left = bytes(np.frombuffer(d, dtype=np.uint8)[~covered])
        out.append((len(d), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def best_fit_bins(lengths, capacity):
    """Number of bins of best-fit decreasing, one document at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins = room - length
        bisect.insort(rooms, bins)
    return len(rooms)


def top_scores(rows, k, scale=1024):
    """rows: (id, vector). {query id: [(id, score)]} for ids divisible by 100."""
    whole = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in whole:
        if q % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def planted_words(doc_id, text):
    """The words of a text after the planting of op11."""
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def word_runs(words, shortest=12):
    """[(start, length, period)] of all runs, and the words left after collapsing."""
    number, least = {}, {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    for p in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-p] == x[p:]).astype(int), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= p and e + p - s >= shortest:
                least.setdefault((s, e + p), p)
    runs = sorted((s, e - s, p) for (s, e), p in least.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    kept = np.ones(len(words), dtype=bool)
    for s, length, p in runs:
        kept[s + p:s + length] = False
    return runs, [w for w, k in zip(words, kept) if k]


def walks(pages, rules, damping, rounds):
    """({host: trust}, {host: distrust}) of (id, url, html) pages by dense power iteration."""
    def parts(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        return (found[1].lower(), found[2]) if found else ("", "")

    seeds, edges = {"allow": Counter(), "block": Counter()}, Counter()
    for verdict, host, _ in rules:
        seeds[verdict][host] += 1
    hosts = set()
    for _, url, html in pages:
        host, path = parts(url)
        hosts.add(host)
        fitting = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        if fitting:
            seeds[max(fitting, key=lambda r: len(r[1] + r[2]))[0]][host] += 1
        links = re.findall(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)""", html)
        for out in {parts(("x:" if u.startswith("//") else "") + u)[0] for u in links}:
            if host and out and host != out:
                edges[host, out] += 1
                hosts.add(out)
    for host in list(hosts):  # to and from the domain above, if that has two labels
        labels = host.split(".")
        for i in range(len(labels) - 2):
            child, parent = ".".join(labels[i:]), ".".join(labels[i + 1:])
            edges[child, parent] += 0
            edges[parent, child] += 0
            hosts |= {child, parent}
    for child, parent in [e for e, n in edges.items() if not n]:
        edges[child, parent] = 1
    order = sorted(hosts | set(seeds["allow"]) | set(seeds["block"]))
    at = {h: i for i, h in enumerate(order)}
    moves = np.zeros((len(order), len(order)))
    for (a, b), n in edges.items():
        moves[at[a], at[b]] += n
    out = []
    for verdict, m in (("allow", moves), ("block", moves.T)):
        start = np.array([seeds[verdict][h] for h in order], dtype=float)
        start /= max(1, start.sum())
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        rank = start
        for _ in range(rounds):
            rank = (1 - damping) * start + damping * rank @ share
        out.append(dict(zip(order, rank)))
    return out
