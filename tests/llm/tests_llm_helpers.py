"""Plain Python versions of two operators for the pipeline's test."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    """component by doc_id, from all pairs."""
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in up}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contaminated(text, bench, n=10):
    w = words(text)
    for _, item in bench:
        iw = words(item)
        m = min(n, len(iw))
        grams = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        if m and any(tuple(w[i : i + m]) in grams for i in range(len(w) - m + 1)):
            return True
    return False
