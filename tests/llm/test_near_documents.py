"""The pipeline's near-duplicate stage against brute force."""

import random

from lorebase.llm import near_documents
from lorebase.llm.simhash import _fingerprint
from tests.llm.fixtures import docs, empty, union


def test_keep_one(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(90)) for _ in range(7)]
    data = []
    for i in range(50):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(90)] = f"x{rng.randint(0, 3)}"
        data.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in data)]
    near = [(i, j) for i in range(50) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    bits = [_fingerprint(t, 5, 42) & (1 << 64) - 1 for _, t in data]
    near += [(i, j) for i in range(50) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3]
    got = sorted(r["doc_id"] for r in near_documents.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == sorted(set(union(50, near)))


def test_keep_one_awkward(spark):
    kept = near_documents.keep_one(docs(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(spark).columns and ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and 8 not in ids and 7 in ids
    assert near_documents.keep_one(empty(spark)).count() == 0
