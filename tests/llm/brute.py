"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import defaultdict

UPPER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def spaced(text):
    return (text or "").encode().split()


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(UPPER))


def later_cover(texts: dict, size: int) -> dict:
    """Per id: (words, flags of the words in a run that starts in a smaller id, places of such runs)."""
    first, out = {}, {}
    for i in sorted(texts):
        w = spaced(texts[i])
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i in texts:
        w = spaced(texts[i])
        cut, at = [False] * len(w), []
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                cut[k : k + size] = [True] * size
                at.append(k)
        out[i] = w, cut, at
    return out


def shingles(text, size=5):
    w = (text or "").encode().translate(UPPER).split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_components(texts: dict, percent=80) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(texts: dict, items: dict, size=10) -> dict:
    windows = defaultdict(set)
    for item, t in items.items():
        w = alnum(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (who := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= who
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def line_chunks(text, every=4):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        roll = h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)
        if roll % every == 0 or i == len(lines) - 1:
            chunks.append(lines[start : i + 1])
            start = i + 1
    return chunks


def without_repeats(texts: dict, every=4) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = (0, 0, None)
            continue
        kept, gone, total = [], 0, 0
        for chunk in line_chunks(texts[i], every):
            total += len(chunk)
            if len(chunk) > 1 and tuple(chunk) in seen:
                gone += len(chunk)
                continue
            if len(chunk) > 1:
                seen.add(tuple(chunk))
            kept += chunk
        out[i] = (total, gone, "\n".join(kept))
    return out
