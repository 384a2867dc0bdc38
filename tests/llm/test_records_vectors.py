import hashlib
import io
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import projection, top_k, warc
from tracewright.llm.shared import open_fs, work_dir


@pytest.fixture
def pages(spark):
    long = "<p>" + "payload " * 100_000
    rows = [(3, "http://a", "x" * 100), (1, "http://b", "x" * 100), (2, None, "x" * 99), (4, "http://c", "x" * 99), (5, "u\r\nv: w", long), (6, "u", long), (7, "u", None), (8, "u", ""), (None, "n", "x" * 100), (None, "n", "y" * 200), (None, "n", "y" * 200)]
    rows += [(9, "r", "repeated " * 20), (9, "r", "repeated " * 20), (10, "ü", "\r\n\r\nWARC/1.1\r\n\r\n" * 20 + "é")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'d' AS digest", "2 AS first")


def test_round_trip(spark, pages):
    found = warc.round_trip(pages, work_dir(spark)).collect()
    rows = pages.select("page_id", "html").collect()
    first = {}
    for i, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    expect = []
    for i, h in rows:
        data = (h or "").encode()
        to = first.get(h)
        revisit = len(data) >= 100 and to is not None and to != i
        expect.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(to if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(expect)


def test_chunk_table_rebuilds_payloads(spark, pages):
    manifest = warc.write_pages(pages, work_dir(spark))
    rows = warc.read_chunks(manifest).where("record_id IN (1, 5, 8, 10)").collect()
    html = {i: (h or "").encode() for i, h in pages.select("page_id", "html").collect() if i is not None}
    for i in (1, 5, 8, 10):
        own = sorted((r for r in rows if r.record_id == i), key=lambda r: r.chunk)
        assert b"".join(bytes(r.data) for r in own) == html[i] and [r.chunk for r in own] == list(range(len(own)))
        assert [r.last for r in own] == [False] * (len(own) - 1) + [True]
        for k, r in enumerate(own):
            assert r.digest == hashlib.sha256(b"".join(bytes(x.data) for x in own[: k + 1])).hexdigest() and len(r.data) <= warc.CHUNK
    assert max(r.chunk for r in rows) >= 3


def test_archives_are_members_and_damage_is_seen(spark, pages):
    manifest = warc.write_pages(pages, work_dir(spark)).collect()
    assert sum(m.records for m in manifest) == pages.count()
    fs, path = open_fs(max(manifest, key=lambda m: m.bytes).path)
    data = fs.open_input_file(path).read()
    member = zlib.decompressobj(31)
    assert member.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ") and member.eof
    with pytest.raises((ValueError, zlib.error)):
        for _, body in warc.read_records(io.BytesIO(data[:-30])):
            b"".join(body)


def test_a_payload_of_many_chunks_takes_little_memory(tmp_path):
    """400 MB of chunk rows through both halves of the writer and through the reader, of which none may
    hold more than some chunks."""
    piece, chunks = bytes(range(256)) * (warc.CHUNK // 256), 1600

    def rows():
        for k in range(0, chunks, 4):
            yield pa.RecordBatch.from_arrays([pa.array([7] * 4), pa.array(["u"] * 4), pa.array(range(k, k + 4), pa.int32()), pa.array([chunks] * 4, pa.int32()), pa.array([piece] * 4, pa.binary())], names=["id", "uri", "chunk", "chunks", "data"])

    pa.default_memory_pool().release_unused()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    most = 0

    def watched(items):
        nonlocal most
        for item in items:
            most = max(most, pa.total_allocated_bytes() - before)
            yield item

    with open(tmp_path / "c", "wb") as out, pa.ipc.new_stream(out, warc.CHUNKS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as file:
        (header,) = list(warc.put_chunks(watched(rows()), file))
    whole = hashlib.sha256()
    for _ in range(chunks):
        whole.update(piece)
    assert header == (0, 7, "u", chunks * warc.CHUNK, whole.hexdigest())
    with open(tmp_path / "c", "rb") as source, open(tmp_path / "w", "wb") as out:
        warc.put_record(out, 1, "d", (*header[1:], None), (data for _, data in watched(warc.get_chunks(source))))
    with open(tmp_path / "w", "rb") as source:
        ((fields, size),) = [(fields, sum(map(len, watched(body)))) for fields, body in warc.read_records(source)]
    assert size == header[3] and fields["WARC-Type"] == "response"
    assert most < 16 << 20 and tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_a_payload_that_most_records_share(spark, monkeypatch):
    monkeypatch.setattr(warc, "OFTEN", 4)
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [(i, "u", "hot " * 700 if i % 3 else f"own {i} " * 40) for i in range(90)] + [(200 + i, "u", f"own {6 * i} " * 40) for i in range(5)]
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), work_dir(spark)).collect()}
    for i, _, h in rows:
        first = min(k for k, _, x in rows if x == h)
        assert found[i] == (("response", None, len(h)) if first == i else ("revisit", first, len(h)))


def test_no_pages(spark, pages):
    assert warc.round_trip(pages.limit(0), work_dir(spark)).collect() == []


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS n", "2 AS id", "'k' AS key", "3 AS node", "4 AS score")


def clusters(seed=1, n=300, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist(), 0) for i in range(n)]
    for c in range(3):
        base = rng.standard_normal(dim)
        for _ in range(90):
            rows.append((len(rows), (base + 0.17 * rng.standard_normal(dim)).astype(np.float32).tolist(), 1))
    rows += [(1000 + k, rows[5][1], 2) for k in range(30)] + [(2000, [2 * x for x in rows[6][1]], 2)]
    return rows


def check_links(found, rows, threshold=0.95):
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    label = {}
    for k in range(len(rows)):
        if k not in label:
            group, todo = {k}, [k]
            while todo:
                for m in links[todo.pop()]:
                    if m not in group:
                        group.add(m)
                        todo.append(m)
            least = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
            label |= {m: least for m in group}
    expect = sorted((str(rows[k][0]), len(links[k]), str(label[k])) for k in range(len(rows)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == expect
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_links_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(projection, "TILE", 32)
    monkeypatch.setattr(projection, "PACKED", 20)
    rows = clusters()
    check_links(projection.components(vectors(spark, rows).repartition(3), work_dir(spark), window=16).collect(), rows)


def test_links_in_a_crowded_cone_that_no_window_shows(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 128, raising=False)
    monkeypatch.setattr(projection, "CELL", 32, raising=False)
    rng = np.random.default_rng(5)
    away = lambda v: (lambda r: r - (r @ v) * v)(rng.standard_normal(64))
    scaled = lambda v: v / np.sqrt(v @ v)
    axis = scaled(rng.standard_normal(64))
    # A third lies in a cone, any two at a cosine of about 0.9; 20 pairs in it at about 0.955.
    cone = [scaled(np.sqrt(0.9) * axis + np.sqrt(0.1) * scaled(away(axis))) for _ in range(380)]
    pairs = [scaled(0.955 * v + np.sqrt(1 - 0.955**2) * scaled(away(v))) for v in cone[:20]]
    rows = [(i, scaled(v).tolist(), 0) for i, v in enumerate([*cone, *pairs, *rng.standard_normal((800, 64))])]
    found = projection.components(vectors(spark, rows, "double").repartition(3), work_dir(spark), passes=2, window=8).collect()
    assert sum(r.n_links > 0 for r in found) >= 40
    check_links(found, rows)


def test_passes_find_the_share_of_pairs_that_they_promise(spark):
    """Lone pairs at a cosine of 0.95 among evenly spread vectors: windows alone, without the exact step."""
    rng = np.random.default_rng(7)
    units = projection.unit(rng.standard_normal((6000, 48)))
    turned = rng.standard_normal((600, 48))
    turned -= (turned * units[:600]).sum(axis=1, keepdims=True) * units[:600]
    units = np.concatenate([units, 0.951 * units[:600] + np.sqrt(1 - 0.951**2) * projection.unit(turned)])
    passes, mean, met = projection.passes_for(len(units), 8, 0.95, 0.05), units.mean(axis=0), np.zeros(600, bool)
    for p in range(passes):
        place = np.empty(len(units), int)
        place[np.argsort(projection.keys(units, mean, p), kind="stable")] = np.arange(len(units))
        met |= np.abs(place[:600] - place[6000:]) <= 8
    assert met.mean() >= 0.95 and [projection.passes_for(n, 64, 0.95, 0.01) for n in (0, 50_000, 10**8)] == [4, 11, 39]


def test_links_of_one_large_component(spark):
    """50,000 vectors in one component, among them chains of near copies: every one's links in full."""
    angles = np.sort(np.random.default_rng(9).random(50_000)) * 5.5
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angles)]
    found = sorted(projection.components(vectors(spark, rows, "double").repartition(8), work_dir(spark)).collect(), key=lambda r: r.vec_id)
    reach = np.arccos(0.95)
    expect = np.searchsorted(angles, angles + reach) - np.searchsorted(angles, angles - reach) - 1
    # Angles closer to the threshold than rounding decide either way.
    assert len(found) == 50_000 and np.abs(np.array([r.n_links for r in found]) - expect).max() <= 1
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_cells_are_left_out_only_if_no_pair_can_be_linked():
    rng = np.random.default_rng(6)
    units = projection.unit(np.concatenate([c + 0.15 * rng.standard_normal((20, 12)) for c in rng.standard_normal((30, 12))]))
    balls = [projection.ball(units[k : k + 20]) for k in range(0, 600, 20)]
    centres, radii = np.array([c for c, _ in balls]), np.array([r for _, r in balls])
    able = projection.near(centres, radii, centres, radii, 0.95)
    linked = (units @ units.T >= 0.95).reshape(30, 20, 30, 20).any(axis=(1, 3))
    assert not able.all() and not (linked & ~able).any()


def test_links_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.001], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 2.0, 0.0], 0), (10, [1e-300, 2e-300], 0), (None, [5.0, -1.0], 0), (11, [-0.0, 3.0], 0), (12, [0.0, 3.0], 0)]
    check_links(projection.components(vectors(spark, rows, "double"), work_dir(spark)).collect(), rows)
    assert projection.components(vectors(spark, rows).limit(0), work_dir(spark)).collect() == []


def brute_top(rows, queries, k):
    ints = {r: [int(np.floor(256.0 * np.float64(x))) for x in v] for r, (i, v, _) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ints:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[r])), rows[r][0]) for r in ints if r != q and len(ints[r]) == len(ints[q]))
            out += [(rows[q][0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 100)
    monkeypatch.setattr(top_k, "LEAF", 8)
    monkeypatch.setattr(top_k, "BLOCK", 5)
    rows = clusters(seed=2)
    frame = vectors(spark, rows)
    found = top_k.top_k(frame, frame.where("vec_id % 20 = 0"), work_dir(spark), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(rows, [k for k, r in enumerate(rows) if r[0] % 20 == 0], 5)


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [float("nan"), 0.0], 0), (5, [1.0], 0), (6, [-0.001, 0.0], 0), (50, [2.0, -1.0], 0), (100, [], 0), (None, [1.0, 1.0], 0), (150, [3.0], 0), (7, [0.0, 0.0], 0)]
    frame = vectors(spark, rows, "double")
    found = top_k.top_k(frame, frame.where("vec_id % 50 = 0"), work_dir(spark), k=5).collect()
    expect = brute_top(rows, [k for k, r in enumerate(rows) if r[0] is not None and r[0] % 50 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expect
    assert top_k.top_k(frame.limit(0), frame.limit(0), work_dir(spark)).collect() == []
    assert top_k.top_k(frame, frame.limit(0), work_dir(spark)).collect() == []
    twice = vectors(spark, [(0, [1.0], 0), (0, [1.0], 0), (1, [2.0], 0)], "double")
    again = top_k.top_k(twice, twice.where("vec_id = 0"), work_dir(spark)).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in again) == [(1, 1, 256 * 512), (2, 0, 65536)]


def test_top_k_of_large_components_is_exact(spark, monkeypatch):
    """Products past 2**53 and past 2**63, near ties among them, beside usual vectors."""
    monkeypatch.setattr(top_k, "SHARD", 64)
    monkeypatch.setattr(top_k, "LEAF", 8)
    monkeypatch.setattr(top_k, "HELD", 1000)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(150)]
    rows += [(1000 + i, (1e6 * rng.standard_normal(16)).tolist(), 0) for i in range(120)]
    rows += [(2000 + i, (np.ones(16) * 1e6 + np.eye(16)[i % 16] / 256).tolist(), 0) for i in range(40)]
    rows += [(3000 + i, (1e12 * rng.standard_normal(16)).tolist(), 0) for i in range(30)]
    frame = vectors(spark, rows, "double")
    found = top_k.top_k(frame, frame.where("vec_id % 10 = 0"), work_dir(spark), k=5).collect()
    expect = [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in brute_top(rows, [k for k, r in enumerate(rows) if r[0] % 10 == 0], 5)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expect
    assert any(abs(s) > 1 << 53 for *_, s in expect) and any(s == (1 << 63) - 1 for *_, s in expect)
    alone = vectors(spark, [(0, [1e20], 0), (1, [1e308], 0), (2, [1.0], 0)], "double")
    assert [tuple(r) for r in top_k.top_k(alone, alone.where("vec_id = 0"), work_dir(spark)).collect()] == [(0, 1, 2, (1 << 63) - 1)]


def test_keys_of_scores_sort_like_them():
    scores = [-(10**60), -(10**40), -(1 << 63) - 1, -5, 0, (1 << 63) - 1, 1 << 63, (1 << 63) + 1, 10**40, 10**60]
    assert sorted(scores, key=lambda s: (top_k.beyond(s), max(-(1 << 63), min((1 << 63) - 1, s)))) == scores


def test_tree_boxes_are_tight_and_reach_bounds_hold():
    rng = np.random.default_rng(3)
    points = rng.integers(-300, 300, (1000, 6)).astype(float)
    tree = top_k.build(points)
    assert sorted(tree["order"]) == list(range(1000))
    queries = rng.integers(-300, 300, (20, 6)).astype(float)
    reach = top_k.bounds(tree, queries)
    leaves = len(tree["cuts"]) - 1
    for k in range(leaves):
        rows = points[tree["order"][tree["cuts"][k] : tree["cuts"][k + 1]]]
        assert (tree["low"][leaves - 1 + k] == rows.min(axis=0)).all() and ((queries @ rows.T).max(axis=1) <= reach[:, leaves - 1 + k]).all()
