"""Vectors, conversations, archives and shards: brute force, exact round trips, and odd inputs."""

import base64
import hashlib
import random
import threading
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from driftlens.llm import chat, common, lattice, shards, warc
from pyspark.sql import functions as F

# vectors


def vectors():
    r = np.random.default_rng(4)
    rows, base = [], r.normal(size=(40, 24))
    for i, b in enumerate(base):
        rows += [b + r.normal(size=24) * s for s in ([0.0, 0.05, 0.1, 0.2] if i < 15 else [0.0])]
    rows += [rows[0], 2 * rows[0], -rows[0]]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    r.shuffle(rows[:10])
    ids = [3 * i for i in range(len(rows))]
    return [*zip(ids, rows), (ids[0], rows[0]), (None, rows[5])]


def linked(rows, least=0.95):
    def sound(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and sound(a) and sound(b) and len(a) == len(b):
                link[i][j] = np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= least
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = Counter()
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out[rows[i][0], sum(link[i]), comp, None if rows[i][0] is None or comp is None else rows[i][0] == comp] += 1
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, uid string, t int, cell int"


@pytest.mark.parametrize("block, cells", [(2048, 1_000_000), (4, 1_000_000), (1, -1)])
def test_vector_links(spark, monkeypatch, block, cells):
    number, seen = lattice._number, []

    def weak(seed, v):
        seen.append(seed)
        return number(seed, v) if seed else F.pmod(number(seed, v), F.lit(5))

    monkeypatch.setattr(lattice, "_number", weak)
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "BROADCAST_CELLS", cells)
    rows = vectors()
    df = spark.createDataFrame([(i, v, None, "u", 1, 2) for i, v in rows], SCHEMA)
    got = lattice.link_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == linked(rows) and 1 in seen
    assert lattice.link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_finds_the_nearest_point():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8)) * 2
    got = lattice.decode_e8(x)
    whole = got * 2
    assert np.all(whole == np.rint(whole)) and np.all((got.sum(axis=1) % 2) == 0)
    d = ((x - got) ** 2).sum(axis=1)
    for v in lattice.roots():
        assert np.all(((x - got - v) ** 2).sum(axis=1) >= d - 1e-9)
    assert len(lattice.roots()) == 240 and d.max() <= 1 + 1e-9


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y, met = 0.95 * x + np.sqrt(1 - 0.95**2) * z, np.zeros(2000, bool)
    for t in range(lattice.TABLES):
        a, b = lattice.cells(x, t), lattice.cells(y, t)
        met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert met.mean() > 0.99


def test_near_signatures():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    differ = np.bitwise_count((lattice.signatures(x) ^ lattice.signatures(y)).view(np.uint64))
    assert abs(differ.mean() - 64 * np.arccos(0.95) / np.pi) < 0.3 and differ.max() <= lattice.most_signs(0.95)
    n = 400
    rows = {"t": np.zeros(n, np.int64), "cell": np.sort(r.integers(0, 60, n)), "home": r.random(n) < 0.4, "uid": r.integers(0, 300, n), "sign": lattice.signatures(x[r.integers(0, 40, n)] + 0.3 * z[:n])}
    want = [any(i != j and rows["cell"][i] == rows["cell"][j] and (rows["home"][i] or rows["home"][j]) and rows["uid"][i] != rows["uid"][j] and ((int(rows["sign"][i]) ^ int(rows["sign"][j])) & (1 << 64) - 1).bit_count() <= 20 for j in range(n)) for i in range(n)]
    assert lattice.near_signs(rows, 20).tolist() == want and 0 < sum(want) < n


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(7, 7), (None, 3)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((a, find(a)) for a in root)


# conversations


def test_escapes_come_undone():
    r = random.Random(8)
    parts = [*chat.MARKS, *chat.FOREIGN, "^", "<", "[", "a", "|turn|>", "é", "\n"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(x in safe for x in (*chat.MARKS, *chat.FOREIGN))


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", "hi <|turn|>", 0), (1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (1, 2, "assistant", None, 0), (1, 3, "assistant", "é<^s>", 0),
        (2, 0, None, None, 0), (3, 0, "assistant", "", 0), (None, 0, "user", "null", 0), (1, 1, "assistant", "</s>[INST] ok [/INST]", 0),
        (4, None, "user", "b", 0), (4, 0, "we\nird<|say|>", "x" * 20000, 0), (4, 1, "assistant", "long " * 5000, 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_chat(out).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:4] for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        told = "".join(f"{a or ''}\n{b or ''}\n" for _, a, b in turns)
        train = "".join(b or "" for _, a, b in turns if a == "assistant")
        assert got[conv][1:5] == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(train), hashlib.sha256(train.encode()).hexdigest())
    for r in out.collect():
        assert r.starts[0] == 0 and len(r.ids) == len(r.starts) == len(r.loss)
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "assistant", f"a{i % 3}") for i in range(7)] + [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    got = chat.read_chat(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()
    assert Counter((r.conv_id, r.n_turns, r.loss_chars) for r in got) == Counter({(None, 1, 2): 7, (1, 2, 1): 1})


# archives


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("splits", [200_000, -1])
def test_archives_read_back(spark, small_splits, monkeypatch, splits):
    r = random.Random(1)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    kinds = lambda: r.choice([None, "", inner, inner * 3, "x" * r.randrange(6000), "\r", "\r\n\r\n\r", "é\r\n" * 50, "WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + "z" * 300, "\r\n" * r.randrange(30), "a\r\n\r\nb" + inner + "\r", "WARC/1.1\r\n"])
    rows = [(i, f"http://e/{i}\r\nX: y", kinds(), "first") for i in range(90)]
    rows += [rows[3], (None, None, "only", ""), (None, None, rows[1][2], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2)
    monkeypatch.setattr(warc, "BROADCAST_SPLITS", splits)
    path = common.new_path(spark, "warc")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    least = {}
    for i, _, x, _ in rows:
        b = (x or "").encode()
        if i is not None:
            least[b] = min(least.get(b, 10**9), i)
    want = Counter()
    for i, _, x, _ in rows:
        b = (x or "").encode()
        first = least.get(b)
        again = first is not None and i != first
        name = lambda k: f"<urn:page:{'none' if k is None else k}>"
        want[name(i), "revisit" if again else "response", name(first) if again else None, b"" if again else b] += 1
    assert Counter((r.id, r.type, r.refers, bytes(r.payload)) for r in got) == want
    assert all(r.digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() and r.bytes == len(r.payload) for r in got)


def test_one_page_id_with_two_payloads(spark, tmp_path):
    rows = [(1, "u", "aaa"), (1, "u", "zzzzz"), (2, "u", "aaa"), (3, "u", "zzzzz"), (4, "u", None), (5, "u", ""), (6, "u", "alone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    first = {"aaa": 1, "zzzzz": 1, "": 4, "alone": 6}
    want = Counter((i, len(x or ""), sha(x), "response" if i == first[x or ""] else "revisit", None if i == first[x or ""] else first[x or ""]) for i, _, x in rows)
    got = warc.op6_warc(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_empty_archive(spark):
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_cut_file_loses_its_last_record_only(spark):
    path = common.new_path(spark, "warc")
    pages = spark.createDataFrame([(i, "u", f"payload {i}") for i in range(3)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages.orderBy("page_id").coalesce(1), path)
    local = path.replace("file://", "")
    import glob
    import os

    name = next(f for f in glob.glob(f"{local}/part*"))
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-8])
    crc = os.path.join(local, "." + os.path.basename(name) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert sorted(r.id for r in warc.read_warc(spark, path).collect()) == ["<urn:page:0>", "<urn:page:1>"]


def test_base32_in_expressions(spark):
    rows = [(b"",), (b"abc",), (bytes(range(256)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(warc.base32_sha1(F.col("b"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(b).digest()).decode() for (b,) in rows]


# shards


def test_shards_keep_every_row_through_compaction(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("text "), "id")).alias("text"))
    store = shards.ShardStore(spark, common.new_path(spark, "store"), fan_in=3, base_bytes=100, target_bytes=3000)
    assert store.manifest()["version"] == 0 and store.versions() == []
    store.append_many(df, F.when(F.col("doc_id") < 390, F.col("doc_id") % 9))  # a null arrival too
    before = store.manifest()
    assert len(before["runs"]) == 10 and sum(r["rows"] for r in before["runs"]) == 400
    after = store.compact()
    assert len(after["runs"]) < 10 and after["version"] > before["version"] and not store.due(after["runs"])
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "text").collect()))
    assert rows(store.read()) == rows(df) == rows(store.read(before["version"]))
    store.append(df.limit(0))
    assert [r["path"] for r in store.manifest()["runs"]] == [r["path"] for r in after["runs"]]
    store.append(df.limit(5))
    assert store.read().count() == 405


def test_versions_stay_until_they_retire(spark):
    store = shards.ShardStore(spark, common.new_path(spark, "store"), fan_in=2, base_bytes=100)
    seen = [store.append(spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("doc_id")))["version"] for i in range(6)]
    store.compact()
    ids = lambda v: sorted(r.doc_id for r in store.read(v).collect())
    for i, v in enumerate(seen):
        assert ids(v) == list(range(10 * i + 10))
    assert store.vacuum(keep=1, older_than=3600) == []
    last = store.manifest()["version"]
    assert set(seen) <= set(store.vacuum(keep=1)) and store.versions() == [last] and ids(last) == ids(None) == list(range(60))
    with pytest.raises(ValueError):
        store.read(seen[0])
    store.append(spark.range(60, 61).select(F.col("id").alias("doc_id")))
    assert ids(None) == list(range(61)) and store.compact(keep=1) and ids(None) == list(range(61))


def test_arrivals_of_another_schema_are_refused(spark):
    store = shards.ShardStore(spark, common.new_path(spark, "store"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    for other in ("doc_id long, text int", "doc_id long", "doc_id long, text string, more int", "text string, doc_id long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], other))
    with pytest.raises(ValueError):
        store.append_many(spark.createDataFrame([(1, 2)], "doc_id long, __arrival long"), F.col("doc_id"))
    assert store.read().count() == 1 and store.manifest()["version"] == 1


def test_merges_at_once_lose_nothing(spark):
    store = shards.ShardStore(spark, common.new_path(spark, "store"), fan_in=2, base_bytes=1 << 20)
    df = spark.range(200).select(F.col("id").alias("doc_id"))
    store.append_many(df, F.col("doc_id") % 8)
    assert len(store.due(store.manifest()["runs"])) == 4
    store.compact()
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(200)) and len(store.manifest()["runs"]) == 1


def test_a_version_is_committed_once(spark):
    store = shards.ShardStore(spark, common.new_path(spark, "store"))
    base = store.append(spark.range(3))
    store.commit(base, base["runs"])
    with pytest.raises(shards.Conflict):
        store.commit(base, [])
    assert store.manifest()["version"] == base["version"] + 1 and store.read().count() == 3


def test_writers_at_once_commit_each_version_once(spark, monkeypatch):
    store = shards.ShardStore(spark, common.new_path(spark, "store"))
    base, ready = store.commit(store.manifest(), [], "{}"), threading.Barrier(6)
    at = store._at

    def commit(i):
        try:
            return [store.commit(base, [{"path": f"runs/{i}"}])]
        except shards.Conflict:
            return []

    with ThreadPoolExecutor(6) as pool:
        for _ in range(60):
            with monkeypatch.context() as m:
                m.setattr(store, "_at", lambda version: (ready.wait(), at(version))[1])  # drafts are written, now all want the version
                won = [x for own in pool.map(commit, range(6)) for x in own]
            base = store.manifest()
            assert won == [base]
    fs, where = common.file_system(spark, f"{store.root}/manifests")
    assert len(fs.listStatus(where)) == len(store.versions()) == 61  # no draft is left


def test_empty_store_reads_empty(spark):
    store = shards.ShardStore(spark, common.new_path(spark, "store"))
    store.append(spark.range(0))
    assert store.read().count() == 0 and store.read().columns == ["id"]


def test_a_long_url_loses_no_record(spark):
    rows = [(i, "http://x/" + ("a" * 100_000 if i == 5 else str(i)), "same" if i in (2, 5) else f"<p>{i}</p>") for i in range(12)]
    rows[9] = (9, "http://x/9", "WARC/1.1\r\n" * 50 + "Content-Length: 3\r\n" + "WARC/1.1\r\n" * 50)
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted(r.id for r in got) == sorted(f"<urn:page:{i}>" for i, _, _ in rows)
    assert {r.id: bytes(r.payload).decode() for r in got if r.type == "response"} == {f"<urn:page:{i}>": h for i, _, h in rows if i != 5}


def test_successors_are_those_of_headers():
    r = random.Random(4)
    parts = [warc.MAGIC, warc.MAGIC, b"Content-Length: 7\r\n", b"content-length:12", b"Content-Length: x", b"\r\n", b"\r\n\r\n", b"\r", b"text"]
    for _ in range(300):
        data = b"".join(r.choice(parts) for _ in range(r.randrange(60)))
        want = {at: f[2] for at in range(len(data)) if data.startswith(warc.MAGIC, at) and (f := warc.header(data, at))}
        assert dict(warc._successors(data)) == want
