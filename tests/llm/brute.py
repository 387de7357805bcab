"""Plain, slow versions of the corpus queries, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words3(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))


def bpe(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def secrets(text):
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8 and m[1].isascii()]
    k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return len(a), len(k), len(h), sha(",".join(f"{('assign', 'access', 'hex')[r]}:{s}:{e}" for s, r, e in sorted(a + k + h)))


def contamination(text, items, length=8):
    w = words3(text)
    hit, found = set(), set()
    for item, t in items:
        x = words3(t)
        for i in range(max(1, len(x) - length + 1) if x else 0):
            win = x[i : i + length]
            for j in range(len(w) - len(win) + 1):
                if w[j] == win[0] and w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2


def licenses(text):
    w = words3(text)
    places, labels = [], set()
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def token_file(rows, library):
    out, start = {}, 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id] = start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    return out


def url_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = low(rest[:cut]), rest[cut:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=len, default=None)


def url_difference(url, learned, order=5, backing=2.0):
    """Accepted less rejected log-likelihood per byte; learned are URLs with their kind."""

    def mean(kind):
        seen, before = Counter(), Counter()
        for x, k in learned:
            if k == kind:
                b = b"\0" * (order - 1) + x.encode()
                for i in range(order - 1, len(b)):
                    for n in range(1, order + 1):
                        seen[b[i + 1 - n : i + 1]] += 1
                        before[b[i + 1 - n : i], n] += 1
        b, total = b"\0" * (order - 1) + url.encode(), 0.0
        for i in range(order - 1, len(b)):
            p = (seen[b[i : i + 1]] + 0.5) / (before[b"", 1] + 128)
            for n in range(2, order + 1):
                p = (seen[b[i + 1 - n : i + 1]] + backing * p) / (before[b[i + 1 - n : i], n] + backing)
            total += math.log(p)
        return total / max(len(url.encode()), 1)

    return mean(1) - mean(0)


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def near_duplicates(rows):
    rows = list(rows)
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def quality(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)} if len(w) < 400 else fast_hit(wins)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def fast_hit(wins):
    from collections import Counter

    n = Counter(wins)
    return {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}


def shingles(text, words=5):
    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def similar_groups(rows):
    """The smallest id of each row's group; sets of shingles with a similarity of 0.8 or more are linked."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            same = len(x & y)
            if x == y or 9 * same >= 4 * (len(x) + len(y)) > 0:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(rows)]


def weak_secrets(text, kinds):
    """Weak parts with a partner, every pair looked at; ``kinds`` has the patterns of accounts, keys and endpoints."""
    account, key, endpoint, like, reach = kinds
    base = [(m.start(), m.end(), k) for k, p in enumerate(STRONG) for m in re.finditer(p, text) if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k]]
    free = lambda p: [(m.start(), m.end()) for m in p.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in base)]
    keys, accounts, ends = [(s, e) for s, e in free(key) if like(text[s:e])], free(account), free(endpoint)
    lines = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda s: sum(x <= s for x in lines)
    joins = lambda x, ys: any(scope(x[0]) == scope(y[0]) and y[0] <= x[1] + reach and y[1] >= x[0] - reach for y in ys)
    secrets, names = keys + [(s, e) for s, e, k in base if k != 1], accounts + ends + [(s, e) for s, e, k in base if k == 1]
    found = [(s, 3, e) for s, e in accounts if joins((s, e), secrets)]
    found += [(s, 4, e) for s, e in keys if joins((s, e), names)]
    return sorted(found + [(s, 5, e) for s, e in ends if joins((s, e), secrets)])


STRONG = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")


def near(text, items, length, slop):
    """(items, words in their places) of near windows: every start, and every way to give the words places of their own."""
    w, found, hit = words3(text), set(), set()

    def fits(win, start, at=0, used=frozenset()):
        if at == len(win):
            return True
        places = range(max(0, start + at - slop), min(len(w), start + at + slop + 1))
        return any(w[p] == win[at] and p not in used and fits(win, start, at + 1, used | {p}) for p in places)

    for item, t in items:
        x = words3(t)
        for i in range(max(1, len(x) - length + 1) if x else 0):
            win = x[i : i + length]
            for j in range(-slop, len(w) + slop):
                if fits(win, j):
                    found.add(str(item))
                    hit.update(range(max(0, j), min(len(w), j + len(win))))
    return sorted(found), len(hit)
