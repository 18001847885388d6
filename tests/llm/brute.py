"""Plain Python versions of the operators' contracts, written from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

#: Texts at the edges: none, empty, white space, one word, repeats, symbols, several scripts, very long.
EDGE_TEXTS = [
    None, "", " \n\t", "word", "a b c a b c a b c", "x\n\nx\ny\nx ", "é ü ñ 漢字 テキスト é ü ñ 漢字 テキスト", "# $ % & | < > *** a",
    "one two three four five six", "one two three four five six", "lorem ipsum dolor " * 400,
    " ".join(f"w{i}" for i in range(20000)), "😀 😀 😀 😀 😀", "a\x0bb\x0cc\rd", "line\nline\nline\n" * 30,
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def op3(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def op8(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))
    return *(sum(x[1] == i for x in out) for i in range(3)), sha(line)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def op10(texts, items, n=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = []
    for t in texts:
        w, hit, ids = word(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if got := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    ids |= got
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def op9(texts):
    """(set size, smallest linked index) by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    near = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    for (a, b), both in near.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def op5(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
