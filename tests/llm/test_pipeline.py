"""The pipeline's stages on a small corpus."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from driftlens.llm import common, pieces, quality, simhash

from .test_documents import SCHEMA, WORD, corpus, fences_of, levels, prose, quality_of


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert len(corpus_pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, _ = common.materialise(stage(spark, docs, ""), f"stage{i}")
        if i < 4:
            assert out.columns == docs.columns, name
            assert 0 < out.count()
            docs = out
    assert out.columns == [*docs.columns, "n_pieces", "pieces", "lossless"] and all(r.lossless for r in out.collect())


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_run_repeats(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda: Counter((r.doc_id, r.text, tuple(r.pieces)) for r in corpus_pipeline.run(spark, d).collect())
    a = rows()
    assert a == rows() and sum(a.values()) > 50


@pytest.mark.parametrize("rows", [50_000, 20])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "ROOT_ROWS", rows)
    monkeypatch.setattr(simhash, "FAMILY", 256 if rows > 20 else 2)
    monkeypatch.setattr(simhash, "STARS", 4 if rows > 20 else 1)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 2_000_000 if rows > 20 else -1)
    r = random.Random(6)
    docs, i = corpus(), 1000
    for _ in range(12):  # families of one base text with ever more words replaced, around 0.8
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        for k in range(8):
            words = list(base)
            for at in r.sample(range(len(words)), len(words) * k // 150):
                words[at] = f"v{r.randrange(3000)}"
            i += 1
            docs.append((i if r.random() < 0.8 else None, " ".join(words), "en", "s1", 1, 1, "k", 1, "q"))
    sets = []
    for d in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(docs)))
    for _ in docs:
        before = list(root)
        for i, x in enumerate(sets):
            for j in range(i):
                if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(root[i], []).append((d[0], d[1]))
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, SCHEMA), "").collect())
    assert sum(got.values()) == len(groups)
    for rows in groups.values():
        ids = [d for d, _ in rows if d is not None]
        assert sum(got[x] for x in set(rows)) == 1 and any(got[x] and x[0] == (min(ids) if ids else None) for x in rows)


@pytest.mark.parametrize("frontier", [1 << 16, 200])
def test_a_family_below_the_threshold_is_told_in_few_rows(spark, monkeypatch, frontier):
    """Texts of one base, most of them a little less than 0.8 alike: nearly all pairs are candidates."""
    monkeypatch.setattr(simhash, "FAMILY", 64)
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    told, kept = [], simhash.materialise

    def counted(df, name, *more):
        out = kept(df, name, *more)
        if name == "candidates":
            told.append(out[0].count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    r = random.Random(5)
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(150), 1 + i % 5):
            words[at] = f"v{r.randrange(10**6)}"
        docs.append((i, " ".join(words), "en", "s1", 1, 1, "k", 1, "q"))
    for i in range(40):  # and some that differ from all
        docs.append((1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(100)), "en", "s1", 1, 1, "k", 1, "q"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (d[1].split() for d in docs)]
    trees = simhash.Trees(len(docs))
    alike = [(i, j) for i, x in enumerate(sets) for j in range(i) if 5 * len(x & sets[j]) >= 4 * len(x | sets[j])]
    trees.join(np.array(alike))
    got = sorted(x.doc_id for x in corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, SCHEMA), "").collect())
    assert got == sorted({docs[i][0] for i in trees.root.tolist()}) and 150 < len(got) < 330
    assert len(told) == simhash.STARS + 1 and told[-1] < 300 * 5 + 10


def metrics(text):
    n, chars, symbols, dups, repeats = quality_of(text)
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    return {"mean_word": 1000 * chars // max(n, 1), "symbols": 1000 * symbols // max(chars, 1), "dup_lines": 1000 * dups // max(lines, 1), "repeats": 1000 * repeats // max(n, 1)}


def judged(rows):
    """Rows that the quality rules keep, thresholds from sorted values."""
    base = [quality_of(d[1])[0] >= 50 and 100 * quality_of(d[1])[4] <= 50 * quality_of(d[1])[0] for d in rows]
    limits = fences_of([(d[2], d[3], metrics(d[1])) for d, ok in zip(rows, base) if ok])
    inside = lambda d: all(limits[d[2], d[3], m][0] <= x <= limits[d[2], d[3], m][1] for m, x in metrics(d[1]).items())
    return [d for d, ok in zip(rows, base) if ok and inside(d)]


def passages_cut(rows):
    """Texts without the bytes of 50-byte strings that a smaller doc_id has, whole characters at a time."""
    order, first = lambda d: 1 << 62 if d is None else d, {}
    for d in rows:
        b = (d[1] or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 63), order(d[0]))
    for d in rows:
        b = (d[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(d[0]):
                gone[p : p + 50] = b"\1" * 50
        left, at = b"", 0
        for run in re.finditer(b"\1+", bytes(gone)):
            lo, hi = run.span()
            while 0 < lo < len(b) and b[lo] & 0xC0 == 0x80:
                lo += 1
            while 0 < hi < len(b) and b[hi] & 0xC0 == 0x80:
                hi -= 1
            if lo < hi:
                left, at = left + b[at:lo], hi
        text = None if d[1] is None else (left + b[at:]).decode()
        if text is None or WORD.search(text):
            yield (d[0], text, *d[2:4], None if text is None else len(text), *d[5:])


def mixed(rows):
    """Copies of each row that the mix takes, in the order of hashes, by exact budgets."""
    per = Counter()
    for d in rows:
        per[d[3]] += len(WORD.findall(d[1] or ""))
    target = {s: int(x + 1e-9) for s, x in levels(dict(per)).items()}
    place = lambda d: hashlib.md5(f"mix:{d[0] if d[0] is not None else 'null:' + hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    for s in per:
        left = target[s] % per[s] if per[s] else 0
        for d in sorted((d for d in rows if d[3] == s), key=lambda d: (place(d), len(WORD.findall(d[1] or "")))):
            n = len(WORD.findall(d[1] or ""))
            taken = (target[s] // per[s] * n if per[s] else 0) + min(n, max(0, left))
            left -= n
            while taken > 0:
                text = d[1] if taken >= n else "".join(re.split(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", d[1])[:taken])
                yield (d[0], text, *d[2:4], len(text), *d[5:])
                taken -= n


def test_stages_are_those_of_brute_force(spark):
    r = random.Random(12)
    passage = prose(r, 40)
    docs = corpus()
    for i in range(160):
        text = prose(r, r.randint(55, 160))
        if i % 4 == 0:
            text = text[:200] + " " + passage + " " + text[200:]
        if i % 9 == 0:
            text = "日本 " + text + " é" * r.randrange(4)
        if i % 16 == 5:
            text = text.replace(" ", " ## ")
        docs.append((1000 + i if i % 11 else None, text, r.choice(["en", "de"]), r.choice(["s1", "s2", None]), len(text), 1, "k", 2, "q"))
    docs += [docs[-1], docs[-5]]
    rows = lambda df: [tuple(x) for x in df.collect()]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    good, _ = common.materialise(corpus_pipeline.quality_rules(spark, frame, ""), "good")
    assert Counter(rows(good)) == Counter(judged(docs)) and 50 < good.count() < len(docs) - 20
    left, _ = common.materialise(corpus_pipeline.near_copies(spark, good, ""), "left")
    kept = rows(left)
    assert 50 < len(kept) < good.count() and not Counter(kept) - Counter(rows(good))
    cut, _ = common.materialise(corpus_pipeline.repeated_passages(spark, left, ""), "cut")
    assert Counter(rows(cut)) == Counter(passages_cut(kept)) and sum(len(x[1]) for x in rows(cut)) < sum(len(x[1]) for x in kept) - 1000
    mix, _ = common.materialise(corpus_pipeline.source_mix(spark, cut, ""), "mix")
    assert Counter(rows(mix)) == Counter(mixed(rows(cut)))
    out = corpus_pipeline.encoded(spark, mix, "")
    assert Counter(tuple(x[:9]) for x in rows(out)) == Counter(rows(mix))
    assert all(x.decoded == x.text for x in pieces.decode(out).collect())


def test_intermediate_folders_go(spark):
    import os

    where = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    assert quality.op9_quality_rules(spark, "/root/testdata/sf0.001").count() == 200
    assert len(set(os.listdir(where)) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
