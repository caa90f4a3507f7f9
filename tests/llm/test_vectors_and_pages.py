"""Embedding dedup, WARC packages, and the pipeline's shape."""

import base64
import collections
import hashlib
import io
import json
import zipfile

import numpy as np
import pytest

from lorebase.llm import embedding_dedup, warc
from lorebase.operators import components
from tests.llm.fixtures import union


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    e = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(e).collect()}
    root = union(400, pairs)
    assert all(got[n] == root[n] for p in pairs for n in p if p[0] != p[1])
    assert components.connected_components(e.limit(0)).count() == 0


def test_quantised_links_are_exact():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.11, x * 3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {(i, j) for p, r in embedding_dedup.tile_links(x, x, 0.98, step=7) for i, j in zip(p.tolist(), r.tolist(), strict=True)}
    assert found == set(zip(*np.nonzero(x @ x.T >= 0.98), strict=True))
    q, s, e = embedding_dedup.quantise(x)
    assert (np.linalg.norm(x - s[:, None] * q, axis=1) <= e).all()


def test_near_dedup(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    data = []
    for i in range(90):
        v = base[i % 30] + rng.normal(size=8).astype(np.float32) * 0.08
        data.append((i, [float(a) for a in v], int(i % 30 % 3)))
    data += [(100, data[3][1], data[3][2]), (101, data[3][1], None), (102, None, 1), (103, [0.0] * 8, 1), (104, [float("nan")] * 8, 1), (105, [None, 1.0], 1), (None, data[3][1], data[3][2]), (106, [], 1), (100, data[3][1], data[3][2]), (107, [float("inf"), 1.0], 1)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in embedding_dedup.near_dedup(d, tile=16).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    ok = [k for k, (i, v, lab) in enumerate(data) if i is not None and v and lab is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    x = {k: np.array(data[k][1], np.float32).astype(float) for k in ok}
    near = [(a, b) for a in ok for b in ok if a != b and len(x[a]) == len(x[b]) and data[a][2] == data[b][2] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98]
    root, links = union(len(data), near), collections.Counter(a for a, _ in near)
    for k, (i, _, _) in enumerate(data):
        assert (links[k], i if k not in ok else data[root[k]][0], i is not None and (k not in ok or data[root[k]][0] == i)) in got[i]
    assert embedding_dedup.near_dedup(d.limit(0)).count() == 0


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (6, None, None), (7, "http://b/\r\nX: y", ""), (8, "http://c/ü", "é" * 70000), (None, "http://d", "<p>same</p>"), (9, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages):
    got = warc.round_trip(pages).collect()
    data = pages.collect()
    want = collections.Counter((r["page_id"], len((r["html"] or "").encode()), base64.b32encode(hashlib.sha1((r["html"] or "").encode()).digest()).decode()) for r in data)
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    kind = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kind[5, "response", None] == 1 and kind[5, "revisit", 5] == 1 and kind[1, "revisit", 5] == 1 and kind[None, "revisit", 5] == 1
    assert kind[7, "response", None] == 1 and kind[6, "revisit", 7] == 1
    assert warc.round_trip(pages.limit(0)).count() == 0
    whole = warc.round_trip(pages.limit(3), least_bytes=10_000).collect()
    assert all(r["record_type"] == "response" for r in whole)


def _package(stored=True, index=True, junk=b""):
    out = io.BytesIO()
    w = warc.PackageWriter(out, 300)
    for i in range(9):
        w.add(i, f"http://x/{i}", b"payload %d" % i * 20, i == 4, 3)
    if not index:
        w._lines = []
    w.close()
    return out.getvalue() + junk


@pytest.mark.parametrize("index", [True, False])
def test_package_places(index):
    data = _package(index=index)
    f = io.BytesIO(data)
    found = sorted(set(warc.places(f, len(data))))
    assert len(found) == 9
    import zlib

    records = [warc.parse_record(zlib.decompress(data[a : a + n], 31)) for a, n in found]
    assert [r["headers"]["warc-record-id"] for r in records] == [f"<urn:x-page:{i}>" for i in range(9)]
    assert records[2]["payload"] == b"payload 2" * 20 and records[4]["payload"] == b"" and records[4]["http"]["content-length"] == "180"


def test_package_with_half_an_index():
    """Records that no index line names are found too; lines of absent members are passed over."""
    import zlib

    out = io.BytesIO()
    w = warc.PackageWriter(out, 700)
    for i in range(9):
        w.add(i, f"http://x/{i}", b"payload %d" % i * 20, False, None)
    w._lines = [*w._lines[1:3], w._lines[5], '- 0 {"filename": "gone.warc.gz", "offset": 0, "length": 5}']
    w.close()
    data = out.getvalue()
    f = io.BytesIO(data)
    found = sorted(warc.places(f, len(data)))
    assert len(found) == len(set(found)) == 9
    assert [warc.parse_record(zlib.decompress(data[a : a + n], 31))["payload"] for a, n in found] == [b"payload %d" % i * 20 for i in range(9)]


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in (("archive/a.warc.gz", b"x" * 50), ("indexes/index.cdxj", json.dumps({}).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(body)
    data = out.getvalue()
    # move the end record's fields into ZIP64 records, as an archive of over 4 GiB has them
    import struct

    end = data.rfind(b"PK\x05\x06")
    n, length, offset = struct.unpack_from("<HII", data, end + 10)
    far = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, offset) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    packed = data[:end] + far + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    members = warc.read_directory(io.BytesIO(packed), len(packed))
    assert [m["name"] for m in members] == ["archive/a.warc.gz", "indexes/index.cdxj"]
    assert packed[members[0]["begin"] :][:50] == b"x" * 50


def test_pipeline_stages(spark, tmp_path):
    """Planted rows: toxic ones, copies and near copies go, clean ones stay, columns and names are kept."""
    import random

    import corpus_pipeline

    rng = random.Random(5)
    heads = [f"{a}{b}" for a in "mtbskdnlrp" for b in ("ar", "el", "on", "if")]
    clean = [f"{a}{b}" for a in heads for b in ("ado", "ile", "une", "ast", "oth")]
    word = lambda: rng.choice(clean)
    rows, toxic = [], set()
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vilestuff", "grottyman"])
        rows.append((i, " ".join(w), f"s{i % 3}", "kept as it is"))
    base = {i: t for i, t, _, _ in rows}
    rows += [(1000 + i, base[i].replace(" ", "  ", 4), "s0", "x") for i in range(1, 60, 5)]  # copies but for spaces
    near = {}
    for i in range(2, 60, 5):
        w = base[i].split()
        w[30] = "changed"
        near[2000 + i] = i
        rows.append((2000 + i, " ".join(w), "s1", "x"))
    rows += [(3000, None, "s2", "x"), (3001, "", None, "x"), (None, " ".join(word() for _ in range(50)), "s2", "x")]
    sf = tmp_path / "sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __copy string")
    docs.write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(600)], "doc_id long, toxic int").write.parquet(str(sf / "labels.parquet"))
    docs, seen = spark.read.parquet(str(sf / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(sf))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    ids = {k: set(v) for k, v in seen.items()}
    assert len(toxic & ids["toxicity"]) <= 0.05 * len(toxic) and len(set(base) - toxic - ids["toxicity"]) <= 5
    assert not any(1000 <= i < 2000 for i in ids["exact dedup"] if i) and set(range(1, 60, 5)) & ids["toxicity"] <= ids["exact dedup"]
    assert not [i for i, of in near.items() if i in ids["SimHash near-dedup"] and of in ids["SimHash near-dedup"]]
    assert len(ids["exact dedup"] - set(near) - ids["SimHash near-dedup"]) <= 2 and None in ids["SimHash near-dedup"]
    assert ids["mixing"] <= ids["SimHash near-dedup"] and len(seen["pieces"]) == len(seen["mixing"]) > 0
    assert docs.where("NOT lossless").count() == 0
    assert {r["source"] for r in spark.read.parquet(str(tmp_path / "stage3")).select("source").distinct().collect()} >= {"s0", "s1", "s2"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(sf / "documents.parquet")).limit(0), str(sf)).count() == 0
