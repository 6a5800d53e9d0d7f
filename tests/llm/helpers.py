"""Fixtures and brute-force versions that several tests use."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """(doc_id, text[, source]) -> a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    """Nulls everywhere, an empty text, repeated rows and a very long text."""
    rows = [(1, None), (2, ""), (None, "x y z"), (4, " \n\t "), (4, " \n\t "), (6, "word " * 60_000), (7, "a" * 50_000), (8, "same text here"), (8, "same text here"), (9, "same text here")]
    df = docs_of(spark, rows)
    return df.union(spark.createDataFrame([(None, None, None, None, None)], DOCS))


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
