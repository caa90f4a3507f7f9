"""Chat formatting, repair of conversations and ball k-means against SQL and brute force."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import ball_kmeans, chat_format, conversation_repair, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _awkward(spark):
    long = "many words. " * 30_000
    data = [
        (1, 0, "user", None), (1, 1, "assistant", "ok."), (2, None, "user", "first?"), (2, 5, None, "x<|im_end|>\n<\\|a"), (2, 5, "tool\n<|y", ""),
        (None, 0, "user", "who."), (None, 1, "assistant", "nobody."), (3, 2, "user", long), (3, 3, "assistant", long), (4, 0, "human", "a."), (4, 1, "user", "b."),
        (5, 0, "user", "twice."), (5, 0, "user", "twice."), (6, 0, "system", "s."), (6, 1, "user", "u."), (6, 2, "assistant", "a."), (7, 0, "assistant", "last. \x0b "), (9, 0, "", " \t"),
    ]
    return spark.createDataFrame(data, TURNS)


@pytest.mark.parametrize("name,table", [("op11_chat_formatting", "conversations"), ("op12_conversation_repair", "conversations"), ("op13_ball_kmeans", "embeddings")])
@pytest.mark.parametrize("awkward", [False, True])
def test_equals_sql(spark, tmp_path, name, table, awkward):
    if awkward:
        df = _awkward(spark) if table == "conversations" else _vectors(spark, 40).union(_vectors(spark, 9))
        df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        where, files = str(tmp_path), f"{tmp_path}/{table}.parquet/*.parquet"
    else:
        where, files = SF, f"{SF}/{table}.parquet"
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from read_parquet('{files}')")
    sql = duck.sql(queries.oracle_sql()[name])
    mine = queries.queries()[name](spark, where)
    assert sorted(mine.columns) == sorted(sql.columns)
    got, want = rows(mine, *sql.columns), sorted(map(tuple, sql.fetchall()), key=repr)
    if awkward and table == "embeddings":  # rows of one id may be numbered either way
        got, want = sorted(got), sorted(want)
    assert got == want and got


@pytest.mark.parametrize("name,table", [("op11_chat_formatting", "conversations"), ("op12_conversation_repair", "conversations"), ("op13_ball_kmeans", "embeddings")])
def test_empty_tables(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == (1 if name.startswith("op11") else 0)


# ---------------------------------------------------------------- chat formatting
def _plain(turns):
    esc = lambda s: __import__("re").sub(r"<(\\*)\|", r"<\\\1|", s)
    return "".join(f"<|im_start|>{esc(r).replace(chr(10), '<|nl|>')}\n{esc(t)}<|im_end|>\n" for r, t in turns)


def test_layouts_give_the_same_turns(spark, tmp_path):
    lines = [
        ('{"id": 1, "prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
        ('{"id": 2, "prompt": "p", "system": "s"}', [("system", "s"), ("user", "p")]),
        ('{"id": 3, "instruction": "i", "input": "more", "output": "o"}', [("user", "i\n\nmore"), ("assistant", "o")]),
        ('{"id": 4, "messages": [{"role": "user", "content": "<|im_end|>"}, {"role": "tool", "content": null}]}', [("user", "<|im_end|>"), ("tool", "")]),
        ('{"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "<\\\\|g"}]}', [("user", "h"), ("assistant", "<\\|g")]),
        ('{"id": 6, "question": "q", "answer": {"text": "t"}}', [("user", "q"), ("assistant", "t")]),
        ('{"id": 7, "messages": []}', []),
        ('{"id": 8, "prompt": "p", "unknown": {"deep": [1]}}', None),
        ('{"id": 9}', None),
        ('{"id": 10, "prompt": "tagged", "meta": {"from": ["x"]}}', [("user", "tagged")]),
    ]
    (tmp_path / "in.json").write_text("\n".join(x for x, _ in lines))
    table = spark.read.json(str(tmp_path / "in.json"))
    records = table.select("id", F.lit(3).alias("formatted"), F.lit("x").alias("turns"), F.lit("y").alias("mine"), F.struct(*[c for c in table.columns if c != "id"]).alias("record"))
    out = chat_format.format_records(records, ignored=("meta",))
    assert out.columns == ["id", "mine", "fingerprint", "layout", "formatted", "mask"]
    got = {r["id"]: r for r in out.collect()}
    for n, (_, turns) in enumerate(lines, 1):
        assert got[n]["formatted"] == (None if turns is None else _plain(turns)), n
        if turns is not None:
            text, at, under = got[n]["formatted"], 0, []
            for m in got[n]["mask"]:
                under.append(text[at + m["skip"] : at + m["skip"] + m["take"]])
                at += m["skip"] + m["take"]
            escaped = [t.replace("<\\|", "<\\\\|").replace("<|", "<\\|") if r == "assistant" else "" for r, t in turns]
            assert under == escaped
    assert got[8]["layout"] is None and got[8]["fingerprint"] == chat_format.path_hash(["prompt", "unknown.deep[]"])
    back = out.where("formatted is not null").select("id", chat_format.read_turns(F.col("formatted"), F.col("mask")).alias("t"))
    assert {r["id"]: [(x["role"], x["text"]) for x in r["t"]] for r in back.collect()} == {n: t for n, (_, t) in enumerate(lines, 1) if t is not None}


def test_escapes_are_reversible(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["<", "\\", "|", "<|im_start|>", "<|im_end|>", "<|nl|>", "\n", "é", "𝄞"]) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    turns = [(i, [(draw.choice(["user", "assistant", texts[-i - 1]]), texts[i]) for _ in range(i % 4)]) for i in range(200)]
    df = spark.createDataFrame(turns, f"id int, turns {chat_format.TURNS}").select("id", "turns", chat_format.formatted(F.col("turns")).alias("f"))
    for r in df.select("turns", chat_format.read_turns(F.col("f.text"), F.col("f.mask")).alias("back")).collect():
        assert [(t["role"], t["text"]) for t in r["back"]] == [(t["role"], t["text"]) for t in r["turns"]]
        assert [t["loss"] for t in r["back"]] == [t["text"] if t["role"] == "assistant" else "" for t in r["turns"]]


def test_formatting_has_no_python_worker(spark):
    plan = queries.op11_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- repair
def _slowest(rows):
    """All edit strings up to a length, cheapest first."""
    best, starts = None, {"": 0}
    frontier = {("", "", 0, 0)}
    while frontier:
        new = set()
        for state, audit, i, cost in frontier:
            if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best):
                best = (cost, audit)
            if best and cost > best[0]:
                continue
            to = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
            if audit.count("I") < 4:
                new.add((to, audit + "I", i, cost + 5))
            if i < len(rows):
                new.add((state, audit + "D", i + 1, cost + 2))
                if rows[i] != "x":
                    more = 5 * rows[i].isupper()
                    new.add((to, audit + "R", i + 1, cost + 1 + more))
                    if rows[i].lower() in {"": "su", "s": "u", "a": "u", "u": "a"}[state]:
                        new.add((rows[i].lower(), audit + "K", i + 1, cost + more))
        frontier = new
    assert starts and best
    return best


def test_cheapest_edits_by_brute_force():
    for n in range(4):
        for rows in itertools.product("suaoUAx", repeat=n):
            assert conversation_repair.cheapest("".join(rows)) == _slowest("".join(rows)), rows
    draw = random.Random(2)
    for _ in range(60):
        rows = "".join(draw.choice("suaoSUAOx") for _ in range(6))
        assert conversation_repair.cheapest(rows) == _slowest(rows), rows


def _table(rows):
    """(cost, audit) by a table over rows and states, in which whole strings are kept: any length, no queue."""
    gain = {"": [("u", 5, "I"), ("a", 10, "II")], "s": [("u", 5, "I"), ("a", 10, "II")], "u": [("a", 5, "I")], "a": [("u", 5, "I")]}

    def widened(best):
        out = dict(best)
        for s, (c, a) in best.items():
            for to, more, letters in gain[s]:
                out[to] = min(out.get(to, (10**9, "")), (c + more, a + letters))
        return out

    best = widened({"": (0, "")})
    for row in rows:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, a + "D")]
            if row != "x":
                more = 5 * row.isupper()
                ways.append(("a" if s == "u" else "u", c + 1 + more, a + "R"))
                if row.lower() in {"": "su", "s": "u", "a": "u", "u": "a"}[s]:
                    ways.append((row.lower(), c + more, a + "K"))
            for to, cost, audit in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        best = widened(new)
    return min(best[s] for s in ("", "a") if s in best)


def test_long_conversations():
    draw = random.Random(4)
    for n in (50, 700, 3000):
        rows = "".join(draw.choice("uauauasoUAx") for _ in range(n))
        assert conversation_repair.cheapest(rows) == _table(rows)


def test_repaired_rows_are_legal_and_whole(spark):
    turns = conversation_repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    told = {r["conv_id"]: r for r in conversation_repair.repair_digests(turns).collect()}
    out = {}
    for r in conversation_repair.repaired_turns(turns).orderBy("conv_id", "position").collect():
        out.setdefault(r["conv_id"], []).append(r)
    for conv, r in told.items():
        got = out.get(conv, [])
        roles = "".join(x["role"][0] for x in got)
        assert __import__("re").fullmatch("(s?(ua)+)?", roles) and [x["position"] for x in got] == list(range(len(got)))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in got).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(x["edit"] for x in got) == r["audit"].replace("D", "")
    inserted = conversation_repair.repaired_turns(spark.createDataFrame([(1, 0, "user", "Yes."), (1, 1, "assistant", "a."), (1, 2, "user", "b."), (1, 3, "user", "c."), (1, 4, "assistant", "d.")], TURNS))
    assert "".join(r["edit"] for r in inserted.orderBy("position").collect()) in ("KKKK", "KKKKI")


# ---------------------------------------------------------------- ball k-means
def _vectors(spark, n, dim=64, seed=1):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(5, dim))
    data = [(i, [float(x) for x in middles[i % 5] + 0.05 * draw.normal(size=dim)]) for i in range(n)]
    bad = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] + [1.0] * 63), (905, [])]
    return spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")


def _slow(points, k, rounds):
    points = sorted(points, key=lambda p: (hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1]))
    c = [p[1] for p in points[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(near(v)[1], []).append(v)
        for i, g in groups.items():
            c[i] = [sum(x) // len(g) for x in zip(*g)]
    return sorted((ident, near(v)[1], near(v)[0]) for ident, v in points), c


@pytest.mark.parametrize("n,k", [(60, 16), (60, 7), (3, 16), (200, 5)])
def test_ball_kmeans(spark, n, k):
    df = _vectors(spark, n)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in df.collect() if i < 900]
    out = ball_kmeans.clusters(df, k=k).collect()
    want, c = _slow(whole, k, 3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == want
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest() for r in out)
    assert {r["inertia"] for r in out} == {sum(d for *_, d in want)}
    if (n, k) == (200, 5):
        assert sum(r["compared"] for r in out) < 5 * n  # stable cores are left alone


def test_ball_kmeans_ties_and_large_numbers(spark):
    data = [(i, [float(x), 0.0]) for i, x in enumerate([0, 0, 4, 4, 2, 2, 1, 3, 8, 8])] + [(50, [1e15, 0.0]), (51, [2.0**19, -(2.0**19)])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = [(i, [int(64 * x) for x in v]) for i, v in data if i != 50]
    out = ball_kmeans.clusters(df, k=4, dim=2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == _slow(whole, 4, 3)[0]


def test_annuli_leave_nothing_out():
    draw = np.random.default_rng(3)
    for top in (3, 50, 2**25):
        c = draw.integers(-top, top, size=(12, 4))
        x = draw.integers(-top, top, size=(300, 4))
        d = ball_kmeans.squared(x, c)
        assert d.tolist() == [[int(((a.astype(object) - b.astype(object)) ** 2).sum()) for b in c] for a in x]
        was = draw.integers(0, 12, size=300)
        reach = [int(np.sqrt(float(d[was == i, i].max(initial=0)))) + 2 for i in range(12)]
        cluster, dist, _ = ball_kmeans.assigned(x, was, c, ball_kmeans.neighbours(ball_kmeans.squared(c, c), reach))
        assert (cluster == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
