"""Payloads, tool calls and layout against plain readings and hostile input."""

import json
import random
import time

from pyspark.sql import functions as F

from lorebase.sources import harvest, layout, tool_calls


def _walk(value, out):
    """Sources of a parsed payload, objects before what is in them."""
    if isinstance(value, dict):
        url = value.get("url") or value.get("uri") or value.get("link")
        if url:
            title = value.get("title") or value.get("media") or "Web source"
            out.append((title if isinstance(title, str) else "Web source", url if isinstance(url, str) else ""))
        for v in value.values():
            _walk(v, out)
    elif isinstance(value, list):
        for v in value:
            _walk(v, out)
    return out


def _payload(draw, depth=0):
    kind = draw.random()
    if depth > 6 or kind < 0.35:
        return draw.choice(["", "http://a/1", "x\n\"\\é", 0, 1, -2.5e3, True, False, None, [], {}])
    if kind < 0.6:
        return [_payload(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice(["url", "uri", "link", "title", "media", "other", "ключ"]): _payload(draw, depth + 1) for _ in range(draw.randint(0, 5))}


def test_sources_of_any_payload():
    draw = random.Random(8)
    for n in range(500):
        value = _payload(draw)
        text = json.dumps(value, ensure_ascii=n % 2 == 0, indent=None if n % 3 else 1)
        assert [(t, u) for _, t, u in harvest.sources_of(text)] == _walk(value, []), text
    for bad in ("", None, '{"a":1,}', "[1 2]", '{"a"}', "{]", "[}", "nul", "[01]", '{"a":1}x', "{1:2}", '["\x01"]'):
        assert harvest.sources_of(bad) is None, bad
    deep = "[" * 200_000 + '{"url": "http://deep"}' + "]" * 200_000
    assert harvest.sources_of(deep) == [(200_000, "Web source", "http://deep")]


def test_harvest(spark):
    payload = json.dumps({"sources": [{"url": "http://a/1"}, {"url": "HTTPS://b/2.", "title": " B "}, {"link": "http://u:p@c"}, {"uri": "ftp://d"}, {"url": "http://a/1#ws_call_id=7", "media": "A"}]})
    text = "One [Named](http://a/1) and http://a/1\n\n \nTwo http://e/5, http://a/1 http://a/1.\n\nNone"
    rows = spark.createDataFrame([(1, payload, text), (2, "no json", "see http://x/y"), (3, None, None), (4, "[]", "")], "id long, payload string, text string")
    got = {(r["id"], r["index"]): (r["title"], r["url"], r["content"]) for r in harvest.harvested(rows, 3).collect()}
    one, two = "One [Named](http://a/1) and http://a/1", "Two http://e/5, http://a/1 http://a/1."
    assert got == {
        (1, 1): ("A", "http://a/1", f"{one}\n\n{two}\n\n{two}"),
        (1, 2): ("B", "HTTPS://b/2", ""),
        (1, 3): ("", "http://e/5", two),
        (2, 1): ("", "http://x/y", "see http://x/y"),
    }


def test_tool_calls():
    say = lambda s: s.replace("<", "<||DSML||").replace("<||DSML||/", "</||DSML||")
    cleaned, calls = tool_calls.scan("a " + say('<tool_calls><invoke name="f"><parameter name="x" number="true">1.5</parameter><parameter name="y" boolean="TRUE">on</parameter><parameter name="z" integer="true">many</parameter><parameter>lost</parameter></invoke></tool_calls>') + " b")
    assert cleaned == "a  b" and calls == [{"id": "textual-tool-1", "name": "f", "arguments": '{"x": 1.5, "y": true, "z": "many"}'}]
    # without a block the calls go by themselves; a call that has no name, or never closes, is none
    cleaned, calls = tool_calls.scan("a" + say('</tool_calls><invoke><parameter name="x">1</parameter></invoke><invoke name="g"></invoke>') + "b" + say('<invoke name="open">'))
    assert [c["name"] for c in calls] == ["g"] and calls[0]["id"] == "textual-tool-2" and cleaned == "ab" + say('<invoke name="open">')
    # broken nesting: what opens first is closed by what closes first
    cleaned, calls = tool_calls.scan(say('<invoke name="one"><invoke name="two"><parameter name="p">v<parameter name="q">w</parameter></invoke></invoke>'))
    assert [(c["name"], json.loads(c["arguments"])) for c in calls] == [("one", {"p": 'v' + say('<parameter name="q">') + "w"})]
    assert tool_calls.scan(None) == ("", []) and tool_calls.scan("plain < text > | DSML") == ("plain < text > | DSML", [])


def test_hostile_texts_take_linear_time():
    m = "<||DSML||"
    for piece in (m + "invoke ", m + "invoke>", "<" + " " * 50, m + "parameter name='", m + "invoke name='a" + "b" * 50, "|" * 40, m + "tool_calls>"):
        took = []
        for n in (2_000, 32_000):
            began = time.perf_counter()
            tool_calls.scan(piece * n + ">")
            took.append(time.perf_counter() - began)
        assert took[1] < 60 * max(took[0], 0.005), (piece, took)


def test_layout_reads_columns_in_order(spark):
    words = [("left-one", 10, 10, 55, 20), ("right-one", 300, 10, 355, 20), ("left-two", 10, 32, 55, 42), ("right-two", 300, 32, 355, 42)]
    head = [("A", 10, 0, 20, 5), ("headline", 24, 0, 330, 5)]
    rows = [("p", *w) for w in words] + [("q", *w) for w in words + head] + [("r", "alone", 5, 5, 9, 9), ("r", None, 1, 1, 2, 2), ("r", "nowhere", None, 1, 2, 2)]
    df = spark.createDataFrame([(p, t, *(None if x is None else float(x) for x in c)) for p, t, *c in rows], "page string, text string, x0 double, top double, x1 double, bottom double")
    got = {}
    for r in layout.page_blocks(df).orderBy("page", "block_no").collect():
        got.setdefault(r["page"], []).append((r["content"], r["n_lines"]))
    assert got == {"p": [("left-one\nleft-two", 2), ("right-one\nright-two", 2)], "q": [("A headline", 1), ("left-one\nleft-two", 2), ("right-one\nright-two", 2)], "r": [("alone", 1)]}


def test_pages_of_many_words_go_on_over_batches(spark):
    """A page longer than an Arrow batch, and many short ones and one without a name in one task, are laid out as if alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(p, float(10 * (i % 5)), float(14 * (i // 5)), float(10 * (i % 5) + 8), float(14 * (i // 5) + 10), f"w{i}") for p, n in ((None, 3), (1, 40), (2, 1), (3, 7), (4, 8)) for i in range(n)]
        got = layout.page_blocks(spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double, text string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in (None, 1, 2, 3, 4):
        want = layout.blocks(layout.lines([r[1:] for r in rows if r[0] == p]))
        assert [(r["content"], r["n_lines"]) for r in sorted(got, key=lambda r: r["block_no"]) if r["page"] == p] == [(b[4], n) for b, n in want]


def test_lines_follow_the_mean_of_their_tops():
    drift = [(10.0 * k, 1.0 * k, 10.0 * k + 8, 1.0 * k + 10, f"w{k}") for k in range(20)]
    # each top is 1 below the last; a line's mean lags behind by half, and ends it after 4.5
    assert [x[4].count(" ") + 1 for x in layout.lines(drift)] == [9, 9, 2]
    assert [s[4] for s in layout.lines([(0, 0, 10, 8, "a"), (41, 0, 50, 8, "b"), (83, 0, 90, 8, "c")])] == ["a b", "c"]


def test_columns_of_a_table(spark):
    df = spark.createDataFrame([(1, "t")], "a int, b string").select(tool_calls.tool_calls(F.lit(None).cast("string")).alias("f"))
    assert df.first()["f"]["cleaned"] == "" and df.first()["f"]["calls"] == []
