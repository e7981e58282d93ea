"""Plain Python versions of the corpus queries' contracts."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rest(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    return [sum(k == kind for k, _, _ in out) for kind in ("email", "ip", "card", "phone")], hashlib.sha256(text.encode()).hexdigest(), text


def disclosing(docs, context=64, contexts=3, least=0.75, remove=0.9):
    """Spans (start, end, kind) of the terms that each text must lose: texts, and every (entity, term) share of information."""
    term = re.compile(r"[^\W\d_]{3,}")
    bases = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in pii(t)[2].split(",") if x)] for t in docs]
    blanks, near = [], Counter()
    for t, spans in zip(docs, bases):
        c = list(t or "")
        for _, a, b in spans:
            c[a:b] = " " * (b - a)
        blanks.append("".join(c))
    kinds = ("email", "ip", "card", "phone")
    for t, spans, blank in zip(docs, bases, blanks):
        for k, a, b in spans:
            low, high = max(0, a - context), min(len(blank), b + context)
            words = [m[0].lower() for m in term.finditer(blank[low:high]) if (m.start() > 0 or low == 0) and (m.end() < high - low or high == len(blank))]
            for w in words:
                near[f"{kinds.index(k)}:{t[a:b].lower()}", w, tuple(words)] += 1
    both, different, entity = Counter(), Counter(), Counter()
    for (e, w, _), n in near.items():
        both[e, w] += n
        different[e, w] += 1
        entity[e] += n
    every = Counter(m[0] for t in docs for m in term.finditer((t or "").lower()))
    total = sum(every.values())
    share = {(e, w): math.log2(both[e, w] / every[w] * total / entity[e]) / math.log2(total / entity[e]) for e, w in both if different[e, w] >= contexts}
    told = {k: v for k, v in share.items() if v >= least}
    out = []
    for t, spans, blank in zip(docs, bases, blanks):
        mine = {f"{kinds.index(k)}:{t[a:b].lower()}" for k, a, b in spans}
        found = []
        for m in term.finditer(blank):
            if shares := [told[e, m[0].lower()] for e in mine if (e, m[0].lower()) in told]:
                found.append((m.start(), m.end(), 5 if max(shares) >= remove else 4))
        out.append(found)
    return out, share


def quality(t):
    w = WORD.findall(t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), len(inside)


def ngrams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs, least=0.8):
    """docs: list of texts. Links of each, and its group's least index."""
    sets = [ngrams(t) for t in docs]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    common = Counter(p for v in inverted.values() for p in itertools.combinations(v, 2))
    root, links = list(range(len(docs))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= least * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [links[i] for i in range(len(docs))], [find(i) for i in range(len(docs))]


def tokens10(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def decontaminate(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = tokens10(t)
        for x in [tuple(w[k : k + 10]) for k in range(len(w) - 9)] if len(w) >= 10 else ([tuple(w)] if w else []):
            windows[x].add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for t in docs:
        w = tokens10(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def unigram(rows):
    """rows: (doc_id, text). (held_out, n_tokens, n_known, N, base) of each."""
    counts = Counter()
    for i, t in rows:
        if rest(i, 7) != 2:
            counts.update([*WORD.findall(lower(t)), ""])
    n, v, out = sum(counts.values()), len(counts), []
    for i, t in rows:
        w = [*WORD.findall(lower(t)), ""]
        out.append((rest(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url(u):
    if not u or "://" not in u:
        return "", "", None, None
    after = u.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", after, re.S).groups()
    host = lower(host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def targets(sizes, weights=(3, 1, 2)):
    """sizes: {source: words}, sources in order by code point, None last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(w[s] for s in free)
        full = {s for s in free if share * w[s] > 2 * sizes[s]}
        if not full:
            out |= {s: share * w[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def noisy_or(bags, labels, steps, rate, l1):
    """bags: documents of sentences of feature ids. Weights and bias after proximal Adam steps on the mean log loss, in plain loops."""
    ids = sorted({f for d in bags for s in d for f in s})
    n = sum(len(d) for d in bags)
    w, b = dict.fromkeys(ids, 0.0), -math.log(n / max(1.0, sum(labels)))
    m, v, mb, vb = dict.fromkeys(ids, 0.0), dict.fromkeys(ids, 0.0), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = dict.fromkeys(ids, 0.0), 0.0
        for d, y in zip(bags, labels):
            p = [1 / (1 + math.exp(-(b + sum(w[f] for f in s)))) for s in d]
            none = math.prod(1 - x for x in p)
            for s, x in zip(d, p):
                # d(-log(1 - none))/dz = -x * none / (1 - none); d(-log none)/dz = x
                one = (-x * none / (1 - none) if y else x) / len(bags)
                gb += one
                for f in s:
                    g[f] += one
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        for f in ids:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            scale = rate / (math.sqrt(v[f] / c2) + 1e-7)
            x = w[f] - scale * m[f] / c1
            w[f] = math.copysign(max(0.0, abs(x) - scale * l1), x)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-7)
    return w, b


def profile(text, letter):
    """Sum over the text's letter trigrams (runs of gaps are one, a gap at both ends) of letter vectors, rolled by place and
    multiplied; letter(c) is the vector of a code, 0 for a gap."""
    codes = [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0 for c in text or ""]
    codes = [0, *(c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]), 0]
    total = None
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if a or b or c:
            v = [x * y * z for x, y, z in zip(letter(c), rolled(letter(b), 1), rolled(letter(a), 2))]
            total = v if total is None else [x + y for x, y in zip(total, v)]
    return total


def rolled(v, k):
    v = list(v)
    return v[-k:] + v[:-k]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
