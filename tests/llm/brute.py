"""Plain definitions that the operators are held against, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

BLANKS = "\x20\x09-\x0d"
LARGEST = (1 << 63) - 1


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def shingles(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(f"[^{BLANKS}]+", text)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def jaccard(rows):
    """(id, set size, smallest id reachable) of each (id, text)."""
    sets = [(LARGEST if i is None else i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                join(i, j)
    none = lambda x: None if x == LARGEST else x
    return by_id((none(i), len(s), none(find(i))) for i, s in sets)


def features(text):
    text = text or ""
    words = re.findall(f"[^{BLANKS}]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(f"[^{BLANKS}]", line):
            lines += 1
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, again, len(covered), lines


def unrepeated(rows, length=50):
    """(id, bytes, removed, runs, digest of the rest) of each (id, text)."""
    texts = [(LARGEST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                cover[p : p + length] = b"\1" * length
        rest = bytes(c for c, x in zip(t, cover) if not x)
        runs = sum(1 for k, x in enumerate(cover) if x and (k == 0 or not cover[k - 1]))
        out.append((None if i == LARGEST else i, len(t), sum(cover), runs, hashlib.sha256(rest).hexdigest()))
    return by_id(out)


def exact(rows):
    """(id, keep id, group size, kept, digest) of each (id, text)."""
    normal = [(i, re.sub(f"[{BLANKS}]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    out = []
    for i, t in normal:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return by_id(out)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def search(docs, items, depth=50):
    """(item, rank, document, score) of (id, text) documents and (id, text) items."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in words
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:depth])]
    return by_id(out)


def phrases(rows, depth=2000, least=10):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in f.items() if c >= least and len(q) == 3 > len(p) and p in (q[:2], q[1:])]
            if any(100 * c >= 50 * a for c in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:depth]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def accepts(nodes, words):
    """Numbers of words at the start of ``words`` that a parsed template accepts."""
    ends = {0}
    for node in nodes:
        if isinstance(node, str):
            ends = {e + 1 for e in ends if words[e : e + 1] == [node]}
        elif node[0] == "any":
            ends = {e + k for e in ends for k in range(node[1], node[2] + 1) if e + k <= len(words)}
        else:
            ends |= {e + k for e in ends for k in accepts(node[1], words[e:])}
    return ends
