"""Plain versions of the operators, and awkward inputs for them."""

import hashlib
import math
import re
from fractions import Fraction

SHARED = " ".join(f"common{i}" for i in range(70))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, copies, shared passages, and other columns with clashing names."""
    rows = [
        (1, None, "a", 1),
        (2, "", "b", 2),
        (3, " \t\n", None, None),
        (4, f"start one {SHARED} end one\nA line that repeats\nshort\n", "a", 4),
        (5, f"other  {SHARED}\tand more {SHARED}\n  a LINE that repeats ", "a", 5),
        (6, f"start one {SHARED} end one\nA line that repeats\nshort\n", "a", 4),
        (7, "é" * 9 + "\n" + "é" * 10 + "\nshort", "c", 7),
        (8, "é" * 10 + "\n" + "x" * 300 + "\nshort", "c", 8),
        (9, "x" * 120 + " y" * 120, "c", 9),
        (10, " y" * 5000 + "x" * 5000, "c", 10),
        (None, f"no id {SHARED}", "n", 0),
        (None, f"no id {SHARED}", "n", 0),
        (12, "the same row twice " * 20, "d", 12),
        (12, "the same row twice " * 20, "d", 12),
        (13, "a@b.co +1 (555) 555-0100 x 10.0.0.1 4111 1111 1111 1111", "d", 13),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, blob int")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


NO_ID = (1 << 63) - 1


def key(d):
    return NO_ID if d is None else d


def covered(units: list[list], ids: list, k: int) -> list[list[bool]]:
    first: dict = {}
    for d, u in zip(ids, units):
        for i in range(len(u) - k + 1):
            w = tuple(u[i : i + k])
            first[w] = min(first.get(w, NO_ID), key(d))
    out = []
    for d, u in zip(ids, units):
        gone = [False] * len(u)
        for i in range(len(u) - k + 1):
            if first[tuple(u[i : i + k])] < key(d):
                gone[i : i + k] = [True] * k
        out.append(gone)
    return out


def substring(rows, k=50):
    words = [WORD.findall(t or "") for _, t in rows]
    gone = covered(words, [d for d, _ in rows], k)
    return [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (d, _), w, g in zip(rows, words, gone)]


def suffix(rows, k=50):
    raw = [(t or "").encode() for _, t in rows]
    first: dict = {}
    for (d, _), u in zip(rows, raw):
        for i in range(len(u) - k + 1):
            w = u[i : i + k]
            first[w] = min(first.get(w, NO_ID), key(d))
    out = []
    for (d, _), u in zip(rows, raw):
        gone = bytearray(len(u))
        for i in range(len(u) - k + 1):
            if first[u[i : i + k]] < key(d):
                gone[i : i + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(u), sum(gone), spans, sha(bytes(x for x, y in zip(u, gone) if not y))))
    return out


def line_keys(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]


def lines(rows):
    docs: dict = {}
    for d, t in rows:
        for x in line_keys(t):
            docs.setdefault(x, set()).add(key(d))
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x, y in zip(all_lines, line_keys(t)) if len(y) < 10 or len(docs[y]) < 2 or min(docs[y]) == key(d)]
        out.append((d, len(all_lines), len(all_lines) - len(stay), sha("\n".join(stay))))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (key(r[0]), r[1:]))


def shingle_set(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(rows, n=5, percent=75):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = {key(d): key(d) for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(key(rows[i][0])), root(key(rows[j][0]))))
                parent[y] = x
    out = []
    for (d, _), s in zip(rows, sets):
        c = root(key(d))
        out.append((d, len(s), None if c == NO_ID else c, c == key(d)))
    return out


def mixed(rows, weights=None, block=32):
    """rows: (hash of the id, doc_id, source). The order of the mix, slot by slot: of all released blocks the one that is due first."""
    name = lambda s: "n" if s is None else "s" + s
    own: dict = {}
    for h, d, s in sorted(rows, key=lambda r: (r[0], key(r[1]))):
        own.setdefault(s, []).append(d)
    number = {s: k for k, s in enumerate(sorted(own, key=name))}
    w = {s: Fraction(math.sqrt(len(x)) if weights is None else weights.get(s, 0)) for s, x in own.items()}
    blocks = {s: [x[k : k + block] for k in range(0, len(x), block)] for s, x in own.items()}
    order = []
    while live := [s for s in blocks if blocks[s] and w[s] > 0]:
        total = sum(w[s] for s in live)
        done, t = dict.fromkeys(live, 0), 0
        while all(blocks[s] for s in live):
            ready = [(math.ceil((done[s] + 1) * total / w[s]), -w[s], number[s], s) for s in live if math.floor(done[s] * total / w[s]) <= t]
            s = min(ready)[3]
            order += blocks[s].pop(0)
            done[s] += 1
            t += 1
    for s in sorted(blocks, key=name):
        order += sum(blocks[s], [])
    return order


M = (1 << 64) - 1


def spread(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * times & M
    return x


def phrase_names(data: bytes, byte_keys, base, levels=4, rounds=3):
    """Names of the phrases of each level, symbol by symbol."""
    sym, label, out = [int(byte_keys[b]) for b in data], list(data), []
    for _ in range(levels if data else 0):
        runs = [k for k in range(len(sym)) if k == 0 or sym[k] != sym[k - 1]]
        many = [b - a for a, b in zip(runs, [*runs[1:], len(sym)])]
        label = [label[k] for k in runs]
        sym = [sym[k] if n == 1 else spread((sym[k] + n * 0x9E3779B97F4A7C15) & M) for k, n in zip(runs, many)]
        for _ in range(rounds):
            new = []
            for k, x in enumerate(label):
                differ = x ^ label[k - 1] if k else 1
                place = (differ & -differ).bit_length() - 1 if differ else 0
                new.append(2 * place + (x >> place & 1))
            label = new
        at = [k for k in range(len(sym)) if k == 0 or (k + 1 < len(sym) and label[k] > label[k - 1] and label[k] >= label[k + 1])]
        sym = label = [spread((sum(x * pow(base, i, 1 << 64) for i, x in enumerate(sym[a:b])) + b - a) & M) for a, b in zip(at, [*at[1:], len(sym)])]
        out.append(set(sym))
    return out + [set()] * (levels - len(out))


def fingerprint(data: bytes, byte_keys, base):
    one, two, three, four = phrase_names(data, byte_keys, base)
    upper = sorted(three | four)
    return [x >> 16 for x in upper[:64]], [x >> 16 for x in sorted(one | two)[:32]] if len(upper) < 16 else []


def likeness(a, b):
    pairs = [(a[0], b[0], 64)] + ([(a[1], b[1], 32)] if a[1] and b[1] else [])
    unions = [(set(x) & set(y), sorted(set(x) | set(y))[:n]) for x, y, n in pairs]
    total = sum(len(u) for _, u in unions)
    return sum(len(both & set(u)) for both, u in unions) / total if total else 1.0


def discovered(texts, kinds, valid, token, shapes, confidence=0.8, seeds=5):
    """All spans of each text: base ones, and those that contexts make known, round by round."""
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"

    def patterns(before, after):
        found = [("L ", re.search(rf"({word}+){space}+\Z", before)), ("LL ", re.search(rf"({word}+{space}+{word}+){space}+\Z", before)), ("R ", re.match(rf"{space}+({word}+)", after))]
        return {n + re.sub(rf"{space}+", " ", m[1]).lower() for n, m in found if m and not re.search("[0-9@]", m[1])}

    def matches(pattern, text):
        found = list(re.finditer(pattern, text, re.A))
        ends, starts = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)]
        return [(m, patterns(text[ends[k] : m.start()], text[m.end() : starts[k + 1]])) for k, m in enumerate(found)]

    base, loose, seen, able = [], [], set(), set()
    for text in texts:
        own = [(m.start(), i, m.end(), k, p, m[0].lower()) for i, (k, pattern) in enumerate(kinds.items()) for m, p in matches(pattern, text) if valid(k, m[0])]
        base.append(sorted(x[:4] for x in own))
        seen |= {(x, k, s) for _, _, _, k, p, s in own for x in p}
        some = []
        for m, p in matches(token, text):
            trimmed = re.sub(r"[.,;:!?]+\Z", "", m[0])
            surface, end = trimmed.lower(), m.start() + len(trimmed)
            if len(m[0]) >= 6 and ("@" in m[0] or len(re.findall("[0-9]", m[0])) >= 4) and not any(a < end and b > m.start() for a, _, b, _ in base[-1]):
                some.append((m.start(), end, surface))
                able |= {(x, surface) for x in p}
        loose.append(some)
    everything: dict = {}
    for x in [x for x, _, _ in seen] + [x for x, _ in able]:
        everything[x] = everything.get(x, 0) + 1
    known: dict = {}
    while True:
        good: dict = {}
        for x, k in [(x, k) for x, k, _ in seen] + [(x, known[s]) for x, s in able if s in known]:
            good[x, k] = good.get((x, k), 0) + 1
        strong = {(x, k): n / everything[x] for (x, k), n in good.items() if n >= seeds and n / everything[x] >= confidence}
        doubt: dict = {}
        for x, s in able:
            for k in kinds:
                if (x, k) in strong and re.search(shapes[k], s):
                    doubt[s, k] = doubt.get((s, k), 1.0) * max(1 - strong[x, k], 1e-9)
        best: dict = {}
        for (s, k), d in doubt.items():
            if s not in known:
                best[s] = max(best.get(s, (0, "")), (1 - d, k))
        if not best:
            break
        known |= {s: k for s, (_, k) in best.items()}
    names = list(kinds)
    return [sorted(b + [(a, names.index(known[s]), e, known[s]) for a, e, s in some if s in known]) for b, some in zip(base, loose)]
