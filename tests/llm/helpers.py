"""Small documents with every odd case, and plain versions of what the operators compute."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, row long, n long, ids string, piece int, key long"


def odd_texts():
    random.seed(5)
    parts = ["a", "'ll", "'s", " ", "  ", "\n", "\t", "é", "é", "1", "?!", " ", "word ", "日本", "İ", ".", ", "]
    mixed = ["".join(random.choice(parts) for _ in range(random.randint(0, 900))) for _ in range(30)]
    return [*mixed, None, "", " ", "x" * 3000, " " * 3000, "a b " * 2000, "same text here for all", "same text here for all", "\U0001f600 ok"]


def odd_docs(spark, texts=None):
    """Null and repeated ids, a repeated row, and columns whose names the operators use themselves."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, texts[0]), (7, "another row of id seven")]
    full = [(i, t, "en", "src0", len(t or ""), 1, 2, 3, "x", 4, 5) for i, t in rows]
    return rows, spark.createDataFrame(full, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def least_components(nodes, links):
    """{node: smallest node reachable}."""
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for u, v in links:
        u, v = find(u), find(v)
        at[max(u, v)] = min(u, v)
    return {n: find(n) for n in nodes}
