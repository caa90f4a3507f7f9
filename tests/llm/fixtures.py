"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, source string, kept boolean, size string, __key int"


def docs(spark):
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "a", True, "x", 1),
        (2, "the  quick\tbrown fox jumps over the lazy dog", "a", None, "x", 1),
        (3, "the quick brown fox jumps over the lazy dog", None, False, None, None),
        (3, "the quick brown fox jumps over the lazy dog", None, False, None, None),
        (4, "", "b", True, "x", 1),
        (5, None, "b", True, "x", 1),
        (None, "nobody knows me at all here", "b", True, "x", 1),
        (None, None, None, None, None, None),
        (6, " \t\n ", "b", True, "x", 1),
        (7, long, "c", True, "x", 1),
        (8, long + " tail", "c", True, "x", 1),
        (9, "Über ▁ Сло́во 日本語\n\n  two  spaces ", "c", True, "x", 1),
        (10, "solo", "c", True, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def union(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
