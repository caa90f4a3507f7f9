"""Operators on documents against brute force, on small awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorebase.llm import exact_dedup, mixing, paragraphs, pieces, rolling, sharding, simhash, substrings, toxicity
from tests.llm.fixtures import docs, empty, union


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "source").collect()
    assert len(got) == 13
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    want = collections.defaultdict(list)
    for r in docs(spark).collect():
        want[hashlib.sha256(norm(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    for r in got:
        ids = want[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
    assert sum(r["kept"] for r in got) == len(want)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_state_goes_on(spark, tmp_path):
    """The same checkpoint takes in only what came since and knows the keys of before."""
    log = exact_dedup.digest_log(spark.createDataFrame([(2, "a b"), (5, "c")], "doc_id long, text string").transform(lambda d: _scan(d, tmp_path / "one")), "doc_id", "text")
    log.write.parquet(str(tmp_path / "log"))
    state = exact_dedup.stream_state(spark, str(tmp_path / "log"), log.schema, str(tmp_path / "ckp"))
    assert sorted((r["__first"]["id"], r["__n"]) for r in state.collect()) == [(2, 1), (5, 1)]
    more = exact_dedup.digest_log(spark.createDataFrame([(1, "a  b"), (9, "d")], "doc_id long, text string").transform(lambda d: _scan(d, tmp_path / "two")), "doc_id", "text")
    more.write.mode("append").parquet(str(tmp_path / "log"))
    state = exact_dedup.stream_state(spark, str(tmp_path / "log"), log.schema, str(tmp_path / "ckp"))
    assert sorted((r["__first"]["id"], r["__n"]) for r in state.collect()) == [(1, 2), (5, 1), (9, 1)]


def test_exact_dedup_takes_any_column_names(spark):
    """Columns named as the operator's own are kept, and results do not change."""
    names = ["__id", "__at", "__digest", "__first", "__n", "__text", "__keep", "__kept", "__bucket", "__mine", "__m", "__lost", "__rank", "__where", "__kept_text"]
    d = docs(spark).select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    key = lambda df: sorted(rows(df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")), key=repr)
    got = exact_dedup.exact_dedup(d)
    assert set(names) < set(got.columns) and got.select(*names).distinct().collect() == d.select(*names).distinct().collect()
    assert key(got) == key(exact_dedup.exact_dedup(docs(spark))) == key(exact_dedup.exact_dedup_ids(d))
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns and kept.count() == got.where("kept").count() == 8


def test_exact_dedup_digest_collisions(spark, monkeypatch):
    """Texts of one digest that differ are told apart by their bytes."""
    monkeypatch.setattr(exact_dedup, "_digest", lambda c: F.sha2(F.substring(exact_dedup.normalised(F.col(c)), 1, 3), 256))
    d = spark.createDataFrame([(1, "abc one"), (2, "abc two"), (3, "abc  one"), (4, "abc two"), (5, "abc six"), (6, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(d).collect()}
    assert got == {1: (1, 2, True), 2: (2, 2, True), 3: (1, 2, False), 4: (2, 2, False), 5: (5, 1, True), 6: (6, 1, True)}


def test_exact_dedup_goes_on_with_earlier_tables(spark, tmp_path):
    one = _scan(spark.createDataFrame([(2, "a b"), (5, "c")], "doc_id long, text string"), tmp_path / "t1")
    two = _scan(spark.createDataFrame([(3, "a  b"), (1, "c"), (9, "d")], "doc_id long, text string"), tmp_path / "t2")
    home = str(tmp_path / "home")
    exact_dedup.decisions(one, "doc_id", "text", home, one)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(two, checkpoint=home, earlier=one).collect()}
    assert got == {3: (2, 2, False), 1: (1, 2, True), 9: (9, 1, True)}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(two, checkpoint=home)


def _scan(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_sharding_law(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    got = sharding.shard_documents(d, 40).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got) and 0 < sum(r["grown_shard"] == 40 for r in got) < 200
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["size"] == len(r["text"]) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in got)


def test_sharding_moves_only_into_the_raised_subtree(spark):
    tree = sharding.Tree.of(20)
    d = spark.range(4000).select("id", sharding.assign(F.col("id"), tree).alias("a"), sharding.assign(F.col("id"), tree.reweighted(3, 3.0)).alias("b")).where("a <> b").collect()
    assert d and all(r["b"] < 10 for r in d)  # only within, or into, the region of shard 3
    assert all(r["b"] == 3 for r in d if r["a"] < 5)  # in its rack, only into the shard


def test_sharding_awkward(spark):
    got = sharding.shard_documents(docs(spark), 3).collect()
    assert len(got) == 13 and {r["size"] for r in got if r["text"] is None} == {16}
    assert sharding.shard_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["__n", "__rn", "__order", "__bucket", "__before", "given", "order", "bucket", "nth", "before", "file", "row", "n"])
def test_sharding_takes_any_column_name(spark, name):
    d = docs(spark).select("doc_id", "text", F.lit("mine").alias(name))
    got = sharding.shard_documents(d, 3)
    assert got.count() == 13 and {r[name] for r in got.collect()} == {"mine"}


def test_sharding_draws_by_plain_recomputation(spark):
    """Each level's child has the smallest -ln(u) / weight, with u from the keyed hash."""
    tree = sharding.Tree((((((0, 1.0), (1, 2.0)), ((2, 1.0),)), (((3, 4.0), (4, 0.5), (5, 1.0)),))))
    keys = spark.range(200).select("id", sharding.assign(F.col("id"), tree).alias("shard")).collect()
    names = {n: w for r, region in enumerate(tree.regions) for n, w in [(f"region {r}", sum(w for k in region for _, w in k)), *[(f"rack {r}/{k}", sum(w for _, w in rack)) for k, rack in enumerate(region)], *[(f"shard {r}/{k}/{s}", w) for k, rack in enumerate(region) for s, w in rack]]}
    hashes = spark.range(200).select("id", *[F.xxhash64(F.lit(7), F.lit(n), F.col("id")).alias(n) for n in names]).collect()
    for got, h in zip(keys, hashes, strict=True):
        draw = lambda n: -np.log((((h[n] & (1 << 64) - 1) >> 11) + 0.5) / 2**53) / names[n]  # noqa: B023, E731
        r = min(range(len(tree.regions)), key=lambda r: draw(f"region {r}"))  # noqa: B023
        k = min(range(len(tree.regions[r])), key=lambda k: draw(f"rack {r}/{k}"))  # noqa: B023
        assert got["shard"] == min((s for s, _ in tree.regions[r][k]), key=lambda s: draw(f"shard {r}/{k}/{s}"))  # noqa: B023


def test_mixing_takes_any_column_names(spark):
    names = ["__id", "__source", "__size", "__tie", "__s", "__m", "__bin", "__whole", "__p", "__u", "__q", "__cut", "__left", "__given", "__copy", "__copies"]
    d = docs(spark).select("doc_id", "text", "source", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    plain = sorted(rows(mixing.mix(docs(spark)).select("doc_id", "size", "source_size", "target", "taken")), key=repr)
    got = mixing.mix(d)
    assert sorted(rows(got.select("doc_id", "size", "source_size", "target", "taken")), key=repr) == plain
    assert [tuple(r) for r in got.select(*names).distinct().collect()] == [tuple(range(len(names)))]
    taken = mixing.mix_rows(docs(spark))
    assert taken.columns == docs(spark).columns
    want = collections.Counter()
    for i, size, _, _, took in plain:
        want[i] += int(took / size + 0.5) if size else 0
    assert collections.Counter(r["doc_id"] for r in taken.collect()) == +want


def test_mixing_targets(spark):
    s = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    size, weight = {"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 1, "b": 2, "c": 3, None: 1}
    full, left = set(), dict(size)
    while True:  # the resharing as it is told
        rest = sum(size.values()) - sum(3 * size[k] for k in full)
        t = {k: 3.0 * size[k] if k in full else rest * weight[k] / sum(weight[x] for x in left if x not in full) for k in size}
        over = {k for k in size if t[k] > 3 * size[k] and k not in full}
        if not over:
            break
        full |= over
    assert got == pytest.approx(t)


def test_mixing_takes_targets(spark):
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(800)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(3)).collect()}
    total = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
        total[r["source"]] += r["taken"]
    for r in got:
        assert abs(total[r["source"]] - r["target"]) <= 1
    ids = {r["doc_id"]: r["taken"] for r in mixing.mix_ids(d).collect()}
    assert ids == again
    assert mixing.mix(docs(spark)).count() == 13 and mixing.mix(empty(spark)).count() == 0


def _near_texts(n=60, seed=3):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(120)) for _ in range(6)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        out.append((i + 100, " ".join(w)))
    return out


def _slow_fp(t, width=3):
    b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", b)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << k for k in range(64) if h and 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark):
    data = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + _near_texts()
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = simhash.near_dedup(d).collect()
    fps = [_slow_fp(t) for _, t in data]
    by = {f"{f:016x}" for f in fps}
    assert len(got) == len(data) and {r["fingerprint"] for r in got} == by
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = collections.defaultdict(list)
    for (i, _), r in zip(data, root, strict=True):
        want[r].append(i)
    least = {f"{fps[k]:016x}": min((i for i in want[r] if i is not None), default=None) for k, r in enumerate(root)}
    assert all(r["component_id"] == least[r["fingerprint"]] for r in got)
    assert simhash.near_dedup(empty(spark)).count() == 0
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns


def test_simhash_points_and_cells(spark):
    """Coordinates are segment bit counts; close points meet in a cell of either half."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40, np.int64)
    near = base.copy()
    for i in range(len(near)):
        for k in rng.choice(64, i % 4, replace=False):
            near[i] ^= np.uint64(1 << int(k)).astype(np.int64)
    data = [(int(a), int(b)) for a, b in zip(base, near, strict=True)]
    counts = lambda x: [(x >> 4 * s & 15).bit_count() for s in range(16)]
    d = spark.createDataFrame(data, "a long, b long")
    got = d.select("a", "b", simhash.embedded(F.col("a")).alias("va"), simhash.manhattan(simhash.embedded(F.col("a")), simhash.embedded(F.col("b"))).alias("d")).collect()
    for r in got:
        assert counts(r["va"]) == counts(r["a"]) and all((r["va"] >> 4 * s & 15) in (0, 1, 3, 7, 15) for s in range(16))
        assert r["d"] == sum(abs(x - y) for x, y in zip(counts(r["a"]), counts(r["b"]), strict=True)) <= ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count()
    v = simhash._unary(base.view(np.uint64)).view(np.int64).tolist()
    assert [r["va"] for r in got] == v
    points = d.select(F.col("a").alias("__fp"), simhash.embedded(F.col("a")).alias("v"))
    own, look = simhash.placed(points, [], [(0, range(8), simhash._HALF), (1, range(8, 16), simhash._HALF << 32)])
    assert own.count() == 80 and look.count() == sum(2 + sum(c < 4 for c in counts(a)) for a, _ in data)


@pytest.mark.parametrize("crowd", [1, 2, 64])
def test_simhash_links_crowded_cells(spark, crowd):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, np.int64)
    fps = np.unique(np.concatenate([b ^ (np.int64(1) << rng.integers(0, 20, 60)) ^ (np.int64(1) << rng.integers(0, 40, 60)) for b in base]))
    d = spark.createDataFrame([(int(f),) for f in fps], "__fp long")
    found = simhash.links(d, 3, crowd=crowd, tile=16).collect()
    at = {int(f): i for i, f in enumerate(fps)}
    u = fps.view(np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 3]
    assert union(len(fps), [(at[r["a"]], at[r["b"]]) for r in found]) == union(len(fps), near)


def test_paragraphs(spark):
    rng = random.Random(9)
    lines = [" ".join(f"v{rng.randint(0, 400)}" for _ in range(60)) for _ in range(8)]
    data = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(lines).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 5)}"
            out.append(" ".join(w) if rng.random() < 0.8 else "")
        data.append((i, "\n".join(out)))
    data += [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    d = spark.createDataFrame(data, "doc_id long, text string")
    for crowd, radius, least in ((2, 10, 14), (24, 12, 14), (24, 5, 1), (24, None, 1)):
        got = paragraphs.dedup_paragraphs(d, bands=12, rows=2, radius=radius, least=least, crowd=crowd, tile=8).collect()
        assert len(got) == len(data)
        total, removed = _slow_removed(data, radius, least)
        assert sum(r["n_removed"] for r in got) == removed and sum(r["n_paragraphs"] for r in got) == total
        assert all(len(r["removed"]) == len(r["removed_words"]) == len(r["keep_ids"]) == r["n_removed"] for r in got)
    assert paragraphs.dedup_paragraphs(empty(spark)).count() == 0


def _slow_cut(words, radius):
    """Paragraphs of one text by the rule as it is told, a word at a time."""
    w = rolling.Words([" ".join(words)])
    h = [None] + [int(w.hashes(np.array([i]), np.array([i + 2]))[0]) >> 1 for i in range(1, len(words) - 1)]
    cuts = [0]
    for i in range(1, len(words) - 1):
        around = [(h[j], j) for j in range(max(1, i - radius), min(len(words) - 2, i + radius) + 1)]
        if min(around) == (h[i], i):
            cuts.append(i)
    return list(zip(cuts, [*cuts[1:], len(words)], strict=True))


def _slow_removed(data, radius, least):
    sets = []
    for _, t in data:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        cut = [] if not words else _slow_cut(words, radius) if radius else [(0, len(words))]
        for a, b in cut if any(b - a >= least for a, b in cut) else [(0, len(words))] if words else []:
            if b - a >= least or b - a == len(words):
                sets.append({tuple(words[i : min(i + 5, b)]) for i in range(a, max(a + 1, b - 4))})
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return len(sets), len(sets) - len(set(union(len(sets), near)))


def test_paragraphs_recall_of_embedded_passages(spark):
    """Passages of 51 to 90 words inside other words and lines are caught, other texts left alone."""
    rng = random.Random(12)
    word = lambda: f"u{int(rng.paretovariate(0.7)) % 3000}"
    passages = [" ".join(word() for _ in range(rng.randint(51, 90))) for _ in range(100)]
    data = []
    for i in range(600):
        inside = passages[i % 100] if i < 300 else " ".join(word() for _ in range(60))
        around = [rng.choice(" \n").join(word() for _ in range(rng.randint(1, 80))) for _ in range(2)]
        data.append((i, around[0] + rng.choice(" \n") + inside + " " + around[1]))
    got = {r["doc_id"]: r["n_removed"] for r in paragraphs.dedup_paragraphs(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(100, 300)) >= 0.95 * 200
    assert not any(got[i] for i in range(300, 600))


@pytest.mark.parametrize("cores", ["1", "7"])
def test_row_keys_do_not_follow_the_parallelism(spark, tmp_path, cores):
    """Rows keep their names however files are packed into tasks."""
    path = str(tmp_path / "docs")
    spark.range(400).selectExpr("id AS doc_id", "concat('some words to read ', id % 50) AS text").repartition(12).write.parquet(path)
    one = {tuple(r) for r in paragraphs._numbered(spark.read.parquet(path), "doc_id").collect()}
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", cores)
    try:
        assert {tuple(r) for r in paragraphs._numbered(spark.read.parquet(path), "doc_id").collect()} == one
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_substrings(spark):
    rng = random.Random(2)
    chunk = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    data = [(i, "".join(rng.choice(chunk) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(None, None), (77, ""), (78, "ab" * 150), (79, "q" * 199), (80, "q" * 200), (3, "zz" * 20)]
    data += [(90, data[5][1] + "end"), (5, data[5][1])]
    d = spark.createDataFrame(data, "doc_id long, text string")
    n = 60
    texts = [(t or "").encode() for _, t in data]
    count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    want = []
    for (i, _), t in zip(data, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = rows(substrings.remove_repeats(d, length=n, gram=12))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    heads = [f"{a}{b}" for a in "mtbskdnlrp" for b in ("ar", "el", "on", "if")]
    clean = [f"{a}{b}" for a in heads for b in ("ado", "ile", "une", "ast", "oth")]
    data, labels = [], []
    for i in range(900):
        w = [rng.choice(clean) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["vilestuff", "grottyman"])
        elif i % 5 == 1:
            w[7:9] = ["vilestuff", "remover"]
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    data += [(2000, "such v1lestuff and gr0ttymаn here"), (2001, None), (2002, ""), (None, "marado"), (2003, "vilestuff remover"), (2003, "vilestuff remover")]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(d, lab).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    mark = {r["doc_id"]: r for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(mark[i]["held_out"] for i in held)
    assert sum(mark[i]["predicted"] == y for i, y in labels if mark[i]["held_out"]) >= 0.97 * len(held)
    assert mark[2000]["predicted"] == 1 and mark[2003]["predicted"] == 0 and mark[2001]["score"] == mark[2002]["score"] < 0.7
    assert toxicity.score_documents(d.limit(0), lab).count() == 0
    assert toxicity.score_documents(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_scores_by_plain_recomputation(spark):
    """Matching, exceptions and the score of a given lexicon, told without an automaton."""
    rng = random.Random(3)
    weights = {" grott": 3.0, " vile ": 2.5, " vilest": 4.0, " mud ": 1.0}
    lex = toxicity.Lexicon(weights, [" vile cheese ", " old mud "], -4.0, 1.2)
    vocabulary = ["grotty", "grott", "vile", "vilest", "vilestuff", "mud", "cheese", "old", "plain", "muddy", "a", "vi1e"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", None]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lex).collect()}
    for i, t in enumerate(texts):
        words = toxicity.folded(t)
        starts = [k for k in range(len(words)) if words[k] == " " and k + 1 < len(words)]
        excused = [(k, k + len(p)) for p in lex.exceptions for k in range(len(words)) if words.startswith(p, k)]
        hits = {}
        for k in starts:
            fit = [(w, e) for e, w in weights.items() if words.startswith(e, k) and not any(a <= k and k + len(e) <= b for a, b in excused)]
            if fit:
                hits[k] = max(fit)
        used, total = collections.Counter(), 0.0
        for k in sorted(hits):
            w, e = hits[k]
            used[e] += 1
            total += w if used[e] <= 3 else 0.0
        n = max(0, words.count(" ") - 1)
        x = -4.0 + 1.2 * (total / (1 + np.log2(1 + n / 256)) if hits else 0.0)
        assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-9, (i, t)


def test_pieces(spark):
    got = pieces.encode_documents(docs(spark), drop=0.3).collect()
    assert len(got) == 13 and all(r["lossless"] for r in got)
    back = pieces.decode_documents(pieces.encode_documents(docs(spark), drop=0.3))
    assert sorted(back.select("text").collect(), key=repr) == sorted(docs(spark).select("text").collect(), key=repr)
    assert pieces.encode_documents(empty(spark)).count() == 0


def test_pieces_equal_the_library_without_dropout_and_vary_with_it():
    import sentencepiece

    model = pieces.Pieces(pieces.MODEL)
    plain, other = pieces.Encoder(model, 0.0, 5), pieces.Encoder(model, 0.2, 5)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["The quick  brown fox, jumped.\nOver 12 lazy dogs!", "", " ", "日本語 <s> naïve\tcafé", "a" * 700]
    for t in texts[:4]:
        assert plain.encode(t) == sp.encode(t)
    for t in texts:
        assert model.decode(plain.encode(t)) == t
        seen = {tuple(other.encode(t, key)) for key in range(6)}
        assert all(model.decode(list(s)) == t for s in seen)
    assert len({tuple(other.encode(texts[0], key)) for key in range(6)}) > 1
    assert other.encode(texts[0], 3) == pieces.Encoder(model, 0.2, 5).encode(texts[0], 3)
    words = ["▁hello", "▁tokenization", "x", "▁日本語"]
    assert model.segment_many(words, 0.4, [3] * 4) == [model.segment(w, 0.4, 3) for w in words]


def test_every_merge_of_every_occurrence_is_drawn():
    """No cap on a unit's segmentations, the odds of single draws, and none of it by what is remembered."""
    model, rng = pieces.Pieces(pieces.MODEL), random.Random(4)
    encoder, forgetful = pieces.Encoder(model, 0.1, 5), pieces.Encoder(model, 0.1, 5, memory=1)
    for w, many in (("information", 20), ("the", 4), ("of", 2)):
        seen, slow = collections.Counter(), collections.Counter()
        for key in range(100):
            states = encoder._segmented([" " + w] * 100, encoder._places(100, key)).tolist()
            seen.update(encoder.ids[encoder.at[x] :][: encoder.size[x]].tobytes() for x in states)
            slow.update(np.array(model.segment_drawn("▁" + w, lambda: rng.random() < 0.1), np.int32).tobytes() for _ in range(100))
        assert len(seen) >= many
        for x in seen | slow:
            p = (seen[x] + slow[x]) / 20_000
            assert abs(seen[x] - slow[x]) <= 5 * (20_000 * p * (1 - p)) ** 0.5 + 1
        text = " ".join([w] * 100)
        assert [encoder.encode(text, k) for k in range(20)] == [forgetful.encode(text, k) for k in range(20)]
        places = encoder._places(100, 7).tolist()
        assert encoder.encode(text, 7) == [i for p in places for i in model.segment("▁" + w, 0.1, p)]


def test_pieces_of_very_long_units_equal_the_library():
    import sentencepiece

    plain = pieces.Encoder(pieces.Pieces(pieces.MODEL), 0.0, 5)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in ("a" * 700, "".join(random.Random(3).choice("information日本語x9") for _ in range(3000)), "internationalization" * 80 + " and on"):
        assert plain.encode(t) == sp.encode(t)


def test_op1_crowds_of_a_common_passage(spark):
    """Sets that hold one passage and little else meet as few classes, and their components equal brute force."""
    rng = random.Random(4)
    passage, data = list(range(9)), []
    for i in range(400):
        own = [100 + 3 * i + k for k in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        data.append((i, passage[: rng.choice([9, 9, 9, 8])] + own + rng.choice([[], [], [50], [50, 51]])))
    for i in range(400, 460):
        data.append((i, [rng.randrange(2000, 2030) for _ in range(rng.randint(8, 20))]))
    data = [(i, sorted(set(h))) for i, h in data]
    sets = [set(h) for _, h in data]
    near = [(i, j) for i in range(460) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = union(460, near)
    df = spark.createDataFrame(data, "cid long, h array<long>")
    for crowd in (2, 24):
        links = [(r["a"], r["b"]) for r in paragraphs.crowd_links(df, 0.8, crowd, 8).collect()]
        at = {n: k for k, n in enumerate(dict.fromkeys([*range(460), *(n for e in links for n in e)]))}
        roots = union(len(at), [(at[a], at[b]) for a, b in links])[:460]
        assert len(set(roots)) == len(set(want)) == len(set(zip(roots, want, strict=True)))
    kinds = paragraphs.crowd_heads(df.where("cid < 400"), 0.8).groupBy("g").agg(F.count_distinct("size", "rest").alias("n")).agg(F.max("n")).first()[0]
    assert kinds < 60


def test_workers_let_the_encoder_go(spark):
    """What a worker keeps for one operator doesn't stay in memory while another one runs."""
    import pyarrow as pa

    from lorebase.llm import pieces, simhash, toxicity

    def kept(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([pieces._encoder.cache_info().currsize] * b.num_rows)], names=["n"]) for b in batches)

    docs = spark.range(1).selectExpr("id AS doc_id", "'some words of a text' AS text").coalesce(1)
    count = lambda: docs.select("doc_id").mapInArrow(kept, "n long").head()["n"]
    for other in (lambda: simhash.fingerprints(docs), lambda: toxicity.score(docs, toxicity.Lexicon({}))):
        for _ in range(8):  # a task may get any idle worker
            pieces.encode_documents(docs).collect()
        assert count() == 1
        for _ in range(8):
            other().collect()
        assert count() == 0
