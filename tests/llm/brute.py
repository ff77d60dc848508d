"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
    )


def normal_line(line):
    return " ".join(WORD.findall(re.sub(r"[0-9]", "0", line.lower())))


def quality(rows, min_docs=20, share=0.001, max_docs=1000):
    """rows: (doc_id, text, source). Returns (base counts, base_failed, removed lines, words, kept, text)."""
    texts, every = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        every[s or ""].add(t or "")
        for line in (t or "").split("\n"):
            if words(line):
                texts[s or "", normal_line(line)].add(t or "")
    out = []
    for _, t, s in rows:
        n = base_counts(t)
        gone = [
            x
            for x in (t or "").split("\n")
            if words(x) and (c := len(texts.get((s or "", normal_line(x)), ()))) > min_docs and c > min(len(every[s or ""]) * share, max_docs)
        ]
        lost = sum(len(words(x)) for x in gone)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        depleted = lost > 0 and (n[0] - lost < min(20, lost) or n[0] - lost < n[0] * 0.2)
        clean = t if not gone else "\n".join(x for x in t.split("\n") if x not in set(gone))
        out.append((n, failed, len(gone), lost, not failed and not depleted, clean))
    return out


def line_runs(rows, min_words=50):
    """rows: (doc_id, text) in order. Returns removed places by row."""
    seen, out = {}, []
    for n, (_, t) in enumerate(rows):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if words(x)]
        removed = set()
        for a in range(len(at)):
            total = 0
            for b in range(a, len(at)):
                total += len(words(lines[at[b]]))
                if total >= min_words:
                    key = "\n".join(lines[k] for k in at[a : b + 1])
                    if seen.setdefault(key, (n, a)) != (n, a):
                        removed.update(at[a : b + 1])
        out.append(sorted(removed))
    return out


def shingles(text):
    w = words(ascii_lower(text))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(rows, percent=85):
    """rows: (doc_id, text). Returns {doc_id: (n_shingles, component_id)}; ids differ."""
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def decontamination(docs, items, window=13):
    """docs, items: (id, text). Returns (n_words, n_hit, sorted items) by row."""
    windows = defaultdict(set)
    for name, t in items:
        w = bench_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    out = []
    for _, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out.append((len(w), len(hit), sorted(found)))
    return out
