"""The secret scan re-stated over one text at a time, with Python's re, for comparison."""

import hashlib
import math
import re

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ALPHABETS = {"hex": ("0123456789abcdef", 16, 0.46875), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 0.3047), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 64, 0.6445)}
NULL = {"hex": (0.4941, 0.7435, 0.6534, -0.0368), "base32": (-1.2699, 0.8334, 0.0091, 0.039), "base64": (0.4899, 0.5396, 0.863, -0.1499)}


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def p_value(hit):
    if not re.search("[A-Za-z]", hit):
        return 1.0
    if re.fullmatch("(?=.*[0-9])([0-9a-f]+|[0-9A-F]+)", hit):
        name = "hex"
    else:
        name = "base32" if re.fullmatch("[A-Z2-7]+=*", hit) else "base64"
    alphabet, k, rate = ALPHABETS[name]
    body = hit.lower() if name == "hex" else hit.rstrip("=")
    n = len(body)
    mean = n * (n - 1) / k
    even = (sum(body.count(c) * (body.count(c) - 1) for c in alphabet) - mean) / math.sqrt(2 * mean * (1 - 1 / k)) if n > 1 else 9.0
    kinds = ["U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else "S" for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    runs = abs(changes - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1)) if n > 1 else 9.0
    x = [alphabet.index(c) + 1.0 for c in body if c in alphabet]
    d = [v - sum(x) / len(x) for v in x]
    square = sum(v * v for v in d)
    serial = abs(sum(a * b for a, b in zip(d, d[1:])) / square * math.sqrt(len(x))) if square else 9.0
    at, slope, base, up = NULL[name]
    far = math.sqrt(0.01 + max(even, 0) ** 2 + runs**2 + serial**2)
    return 0.5 * math.erfc(-(math.log(far) - at - slope * math.log(n)) / (base + up * math.log(min(n, 96))) / math.sqrt(2))


def scan(text, fdr=1e-3):
    text = text or ""
    spans = base(text)
    fresh = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if not any(s < m.end() and e > m.start() for s, _, e in spans)]
    total = sum(e - s for s, e, _ in fresh)
    scored = sorted((p_value(h) * total / (len(fresh) * (e - s)), s, e) for s, e, h in fresh)
    k = max((i + 1 for i, (q, _, _) in enumerate(scored) if q <= fdr * (i + 1) / len(scored)), default=0)
    return sorted(spans + [(s, 3, e) for _, s, e in scored[:k]])


def row(text):
    spans = scan(text)
    say = lambda x: ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in x)
    own = [x for x in spans if x[1] < 3]
    return tuple(sum(x[1] == k for x in spans) for k in range(4)) + (hashlib.sha256(say(own).encode()).hexdigest(), say(spans))
