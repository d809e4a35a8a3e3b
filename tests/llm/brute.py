"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

WS = re.compile(r"[\x20\x09-\x0D]")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def shingles(t, n):
    w = words(t)
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((i, j) for h in holders.values() for k, j in enumerate(h) for i in h[:k])
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i][1]) + len(sets[j][1]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets)), key=str)


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        n = WS.sub("", t or "")
        best = min(groups[n])[3]
        out.append((d, best, len(groups[n]), d == best, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits(s):
    return re.sub(r"[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def spans(text, kinds):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    counts = Counter(name for *_, name in found)
    written = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
    return [counts[name] for name, *_ in kinds], hashlib.sha256(written.encode()).hexdigest(), written


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
