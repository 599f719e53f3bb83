"""Plain counterparts of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def licence_base(text, phrases):
    words = TERMS.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in phrases:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), sorted(starts), ",".join(sorted(labels))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def quality(text):
    text = text or ""
    words = BLANK_WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    symbols = sum(text.count(s) for s in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def deleted_lines(docs, min_lines, min_words):
    """doc id -> places of the lines that go: those of runs, long enough, that occur at an earlier place."""
    seen, out = set(), defaultdict(set)
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = [(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for a in range(len(lines)):
            n, run = 0, ()
            for b in range(a, len(lines)):
                n += len(BLANK_WORDS.findall(lines[b][1]))
                run = hash((run, lines[b][1]))
                if n >= min_words or b - a + 1 >= min_lines:
                    if run in seen:
                        out[doc_id] |= {i for i, _ in lines[a : b + 1]}
                    seen.add(run)
    return out


def components(docs, size=2, percent=80):
    """doc id -> (set size, least id reachable)."""
    sets = {}
    for doc_id, text in docs:
        words = BLANK_WORDS.findall((text or "").translate(LOWER))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """source -> target, sources in order with None last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = sum(sizes.values()), set()
    while True:
        rest = budget - sum(epochs * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and weight[s] * rest > epochs * sizes[s] * free}
        if not above:
            return {s: float(epochs * sizes[s]) if s in capped else weight[s] * rest / free for s in sizes}
        capped |= above


def word_runs(words, min_words=12):
    """All maximal repetitions, (start, length, smallest period), by start, then period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end - start + p
            if end > start and length >= max(min_words, 2 * p):
                found.setdefault((start, length), p)
            start = end + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def phrases(docs, min_count=30, max_words=4, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, n, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        rows = []
        for p, a in candidates.items():
            inside = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * candidates[q] >= 80 * a for q in inside):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)
