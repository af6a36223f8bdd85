"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
import zlib

WS = r"[^\x20\x09-\x0D]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=4):
    w = re.findall(WS, low(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(rows, percent=80):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id, kept)] with union-find over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for x in ok:
        for y in ok:
            if x < y:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[find(x)] = find(y)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = min((rows[j][0] for j in ok if find(j) == find(i)), default=d) if i in ok else d
        out.append((d, len(sets[i]), comp, d is not None and comp == d))
    return out


def leaks(docs, items, size=10):
    windows = set()
    for i, t in items:
        w = re.findall(WORDS, low(t))
        n = min(size, len(w))
        windows |= {(i, tuple(w[a : a + n])) for a in range(len(w) - n + 1) if n}
    out = []
    for d, t in docs:
        w = re.findall(WORDS, low(t))
        hit, names = set(), set()
        for i, win in windows:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    names.add(i)
        ids = ",".join(sorted(str(i) for i in names if i is not None))
        out.append((d, len(w), len(hit), len([i for i in names if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, size=50):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, sha of the rest, rest)]."""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raws:
        for p in range(len(b) - size + 1) if d is not None else ():
            first[b[p : p + size]] = min(d, first.get(b[p : p + size], d))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1) if d is not None else ():
            if first[b[p : p + size]] < d:
                gone[p : p + size] = b"\1" * size
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(rest).hexdigest(), rest))
    return out


def urls(rows, rules):
    out = []
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        out.append((i, host, path, best and best[0] + best[1], best[2] if best else None))
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
