"""Plain versions of the corpus operators, for small inputs."""
import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLACK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(UPPER))


def shingles(text, n):
    w = words(text, BLACK)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near(rows, n, num, den):
    """(id, size of the set, component) per row of (id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def hits(text, items, n):
    """Number of words, hit words, ids of items that occur."""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        k = min(n, len(b))
        for i in range(len(b) - k + 1 if b else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == b[i:i + k]:
                    hit |= set(range(j, j + k))
                    found |= {str(item)} if item is not None else set()
    return len(w), hit, sorted(found)


def digest(text):
    return hashlib.sha256((text or "").translate(UPPER).encode()).hexdigest()
