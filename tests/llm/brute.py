"""Plain versions of the operators, for small inputs."""

import re
import zlib

_WS = re.compile("[ \t-\r]+")
_BLANK = re.compile("[ \t\r\f\x0b]+")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingle_set(text, width):
    words = [w for w in _WS.split(ascii_lower(text or "")) if w]
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs, width, percent):
    """{doc_id: least reachable doc_id} by comparing all pairs of different sets."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def lines_removed(docs, percent=80):
    """{doc_id: set of removed line numbers}: lines with an earlier equal or similar line."""
    earlier, out = [], {}
    for i, text in sorted(docs):
        out[i] = set()
        for k, line in enumerate(text.split("\n")):
            s = frozenset(w for w in _BLANK.split(line.lower()) if w)
            if not s:
                continue
            if any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                out[i].add(k)
            earlier.append(s)
    return out


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = []
    for place, (kind, pattern, least, group) in enumerate([("assign", assign, 8, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0)]):
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def word_rules(text):
    text = text or ""
    words = [w for w in _WS.split(text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(_WS.split(line)):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)
