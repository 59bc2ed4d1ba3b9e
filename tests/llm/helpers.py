"""Plain Python versions of what the operators compute."""

import re


def words(text):
    """Words as the operators see them: ASCII letters and digits and other characters, in lower case."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def shingle_set(text, size=5):
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def component_names(keys, links):
    """Smallest key reachable by links, per key."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}
