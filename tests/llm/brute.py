"""Plain statements of the operators' contracts, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(parts, by=","):
    return hashlib.sha256(by.join(parts).encode()).hexdigest()


def op1(docs, items, window=10):
    rx = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: rx.findall((t or "").translate(low))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[k:k + window])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(ids), bool(hit)))
    return out


def op4(pages):
    groups = defaultdict(list)
    for p, html in pages:
        groups[(html or "").encode()].append(p)
    out = []
    for p, html in pages:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids) if ids else None
        revisit = p != top and len(groups[data]) > 1
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return out


def op5(docs, window=35):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(docs)}
    starts = Counter(tuple(w[i:i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = []
    for k, (d, _) in enumerate(docs):
        w, gone = words[k], set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha([x for i, x in enumerate(w) if i not in gone], " ")))
    return out


def op6(docs, size=400):
    data = [(t or "").encode() for _, t in docs]
    starts = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (d, _), b in zip(docs, data):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if starts[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def op7(text):
    text = text or ""
    found = []
    for m in re.finditer(r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    n = Counter(x[2] for x in found)
    return n["assign"], n["access"], n["hex"], sha([f"{k}:{s}:{e}" for s, _, k, e in sorted(found)])


def op8(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if r not in least or least[r] is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)]


def op9(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op10(text):
    text = text or ""
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    n = Counter(x[2] for x in found)
    return n["email"], n["ip"], n["card"], n["phone"], sha([f"{k}:{s}:{e}" for s, _, k, e in sorted(found)])


def op11_targets(sizes, weights=(3, 1, 2)):
    """Rounds of sharing, as the contract says them. sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    words, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = words - sum(2 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: 2.0 * sizes[s] for s in capped}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def op12(vectors, parts=16, entries=64):
    """vectors: (vec_id, components or None, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    d = len(rows[0][1]) // parts
    cut = lambda v: [v[p * d:(p + 1) * d] for p in range(parts)]
    books = [list(c) for c in zip(*[cut(v) for _, v, _ in sorted(rows)[:entries]])]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))
    for _ in range(2):
        groups = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in rows:
            for p, x in enumerate(cut(v)):
                groups[p][near(p, x)[1]].append(x)
        for p, g in enumerate(groups):
            for k, xs in g.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], lab) for i, v, lab in rows]
    by = Counter()
    for _, ds, lab in found:
        by[lab] += sum(e for e, _ in ds)
    sha_books = sha([str(x) for b in books for c in b for x in c])
    return [(i, "".join("%02x" % k for _, k in ds), sum(e for e, _ in ds), by[lab], sha_books) for i, ds, lab in found]


def op13(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    without = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            without[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for w in n:
        for v in without[w]:
            near[w].add(v)
            near[v].add(w)
        for i in range(len(w)):
            for v in without[w[:i] + w[i + 1:]]:
                if len(v) == len(w) and v != w and sum(a != b for a, b in zip(v, w)) == 1:
                    near[w].add(v)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
