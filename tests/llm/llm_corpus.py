"""Small tables for the tests of this folder, and plain Python versions of what operators compute."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for columns of their own.
CLASHING = ("row", "rank", "shard", "slot", "salt", "range", "key", "kept", "component_id", "sig", "score", "windows", "cuts", "spans", "items", "n_hit", "hash")


def words(seed, n, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}x" for _ in range(n)]


def text(seed, n, size=400):
    return " ".join(words(seed, n, size))


def docs(spark, texts, extra=(), first=0):
    """Documents from texts or (doc_id, text) pairs, one column more for each name in ``extra``."""
    pairs = [x if isinstance(x, tuple) else (first + i, x) for i, x in enumerate(texts)]
    rows = [(i, t, ("en", "de")[k % 2], f"src{k % 3}", None if t is None else len(t), *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in extra))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(pairs, size, percent=80):
    """{doc_id: (shingles, component)} by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}
