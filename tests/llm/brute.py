"""Plain readings of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACE = "[\\x20\\x09-\\x0D]"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def near(rows):
    sets = []
    for _, text in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", ascii_lower(text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i, _ in rows]
    comp = {i: i for i in ids if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, sets):
            for b, y in zip(ids, sets):
                if a is None or b is None or not x or not y:
                    continue
                if 100 * len(x & y) >= 75 * len(x | y) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return sorted(((i, len(s), comp.get(i), i == comp.get(i)) for i, s in zip(ids, sets)), key=str)


def suffix(rows, size=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + size] for _, t in raw for k in range(len(t) - size + 1))
    out = []
    for i, t in raw:
        gone = [False] * len(t)
        for k in range(len(t) - size + 1):
            if seen[t[k:k + size]] > 1:
                gone[k:k + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return sorted(out, key=str)


def leaks(rows, items):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", ascii_lower(t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(item) if item is not None else "null")
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def lines(rows):
    key = lambda s: ascii_lower(re.sub(f"^{SPACE}+|{SPACE}+\\Z", "", s))
    held = {}
    for i, text in rows:
        for s in (text or "").split("\n"):
            if i is not None and len(key(s)) >= 10:
                held.setdefault(key(s), set()).add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        keep = [s for s in all_ if i is None or len(key(s)) < 10 or min(held[key(s)]) == i]
        out.append((i, len(all_), len(all_) - len(keep), sha("\n".join(keep))))
    return sorted(out, key=str)


def quality(rows):
    out = []
    for i, text in rows:
        text = text or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", text)
        triples = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(triples)
        again = {k + j for k, t in enumerate(triples) if n[t] > 1 for j in range(3)}
        ls = [s for s in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", s)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)),
                    len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    return sorted(out, key=str)


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def listed(url):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = ascii_lower(host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return host, path, best and best[1], best and best[0]


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def joined(nodes, links):
    """The smallest node reachable from each."""
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {n: root(n) for n in nodes}


def simhash(rows):
    prints = []
    for _, text in rows:
        w = words(ascii_lower(text or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = joined(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return sorted(((i, f"{prints[k]:016x}", least.get(group[k])) for k, (i, _) in enumerate(rows)), key=str)


def runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(24, 3 * q) and not any(
                    all(w[k] == w[k + r] for k in range(a, a + length - r)) for r in range(1, q)):
                out.append((a, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def manifest(rows):
    """(id, leaf, claimed leaf, subroot, root, proof, folded root) of rows
    (doc_id, source, lang, n_chars, text); the claim lacks the text's newlines."""
    def leaf(r):
        text = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]
        return sha("".join(text))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def beside(levels, i):
        out = []
        for level in levels[:-1]:
            out.append(("".join(level[i - i % 3:i]), "".join(level[i + 1:i - i % 3 + 3])))
            i //= 3
        return out

    groups = {}
    for r in rows:
        claim = r[:4] + (r[4] and r[4].replace("\n", ""),)
        groups.setdefault(r[1], []).append((r[0], leaf(r), leaf(claim)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (id_, own, claim) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = beside(trees[s], i) + beside(top, k)
            got = claim
            for a, b in path:
                got = sha(a + got + b)
            out.append((id_, own, claim, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), got))
    return sorted(out, key=str)
