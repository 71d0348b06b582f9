"""SimHash, suffixes, quality, mixing, tokens and pieces on documents: brute force, and odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftlens.llm import bytesets, common, mixing, pieces, quality, simhash, suffixes, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, spans int, rid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "Äther", "日本", "x"]) + str(r.randrange(40)) for _ in range(n))
    shared, base = say(30), say(300)
    texts = [
        None, "", " \n\t ", "one", "two words", "a b c", base, base, base + " end", base.replace("alpha", "Alpha", 1), base.upper(),
        shared + " " + say(80), say(60) + "\n" + shared, say(20) + shared + say(20) + shared, "line of text here\n" * 40, "ab" * 400, "z" * 3000,
        say(5000), "é" * 90, "x" + "é" * 90, "emoji 😀😀 ▁ text \x00 end", *[say(r.randrange(1, 120)) for _ in range(30)],
    ]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), len(t or ""), 1, "k", 2, "q") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[11], (None, "no id " + shared, "en", "s1", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    common.small_batches(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text, width=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64)) if h else 0


def test_xxh64_agrees_with_the_library():
    r = np.random.default_rng(0)
    buf = r.integers(0, 256, 9000).astype(np.uint8)
    start, size = r.integers(0, 6000, 500), r.integers(0, 150, 500)
    size[:3] = 2500, 2048, 2049
    got = bytesets.xxh64(buf, start, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(buf[a : a + n].tobytes(), seed=42) for a, n in zip(start, size)]


def test_fingerprints_and_components(docs, none):
    got = simhash.cluster(simhash.with_fingerprint(docs)).collect()
    rows = corpus()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((d[0], fingerprint(d[1])) for d in rows)
    print_of = [fingerprint(d[1]) for d in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (print_of[i] ^ print_of[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, d in enumerate(rows):
        if d[0] is not None:
            least[root[i]] = min(least.get(root[i], 10**9), d[0])
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d[0], least.get(root[i])) for i, d in enumerate(rows))
    assert simhash.cluster(simhash.with_fingerprint(none)).count() == 0


def test_full_trie_roots_split_alike(docs, monkeypatch):
    prints = simhash.with_fingerprint(docs)
    whole = {(r.doc_id, r.component_id) for r in simhash.cluster(prints, 3).collect()}
    monkeypatch.setattr(simhash, "ROOT_ROWS", 1)
    assert {(r.doc_id, r.component_id) for r in simhash.cluster(prints, 3).collect()} == whole


def test_trie_pairs_are_all_pairs_within_budget():
    r = random.Random(3)
    keys = []
    for _ in range(120):
        x = r.getrandbits(64)
        for _ in range(4):
            y = x
            for _ in range(r.randrange(5)):
                y ^= 1 << r.randrange(64)
            keys.append(y)
    keys = np.unique(np.array(keys, np.uint64))
    for budget in (0, 1, 2, 4):
        got = simhash.trie_pairs(keys, np.array([[0, len(keys)]]), np.array([[0, len(keys)]]), budget)
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget}
        assert len(got) == len(want) and set(map(tuple, got.tolist())) == want


def test_prints_and_keys_of_sets():
    r = np.random.default_rng(3)
    sets = [np.sort(r.integers(0, 1 << 64, n, np.uint64)) for n in (1, 2, 7, 255, 256, 700)]
    got = simhash.set_prints(np.concatenate(sets), np.r_[0, np.cumsum([*map(len, sets)])], 3)
    for i, x in enumerate(sets):
        for k in range(3):
            h = [int(v) for v in simhash._mixed(x, k)]
            assert int(got[i, k]) == sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))
    blocks = simhash._blocks(simhash.PREFIX, simhash.ERRORS)
    top = (1 << simhash.PREFIX) - 1
    for turn, key, place in simhash._trie_keys(got.view(np.int64), range(4), blocks):
        t, (at, width) = turn // len(blocks), blocks[turn % len(blocks)]
        for i in range(len(sets)):
            word = int(got[i, t // 2])
            word = (word << 32 | word >> 32) & (1 << 64) - 1 if t % 2 else word
            prefix = word >> 64 - simhash.PREFIX
            turned = (prefix << at | prefix >> simhash.PREFIX - at) & top
            assert int(key[i]) == turned << 64 - simhash.PREFIX | word & (1 << 64 - simhash.PREFIX) - 1
            assert int(place[i]) == (turn << 24) + (turned >> simhash.PREFIX - width)


def test_budgets_by_depth():
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    keys = np.unique(np.array([b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(14))) & (1 << 64) - 1 for b in base for _ in range(6)], np.uint64))
    budget = [(32, 2), (64, 9)]
    got = simhash.trie_pairs(keys, np.array([[0, len(keys)]]), np.array([[0, len(keys)]]), budget)
    near = lambda x: x.bit_count() <= 9 and (x >> 32).bit_count() <= 2
    assert set(map(tuple, got.tolist())) == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if near(int(keys[i] ^ keys[j]))} and len(got)


def test_one_document_of_each_group_stays(docs, none):
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 6 in ids and ids.count(6) == 1 and not {7, 10} & set(ids) and 17 in ids
    assert simhash.drop_near_copies(none).count() == 0


def test_only_copies_go_where_ids_are_null_or_repeat(spark):
    r = random.Random(8)
    say = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [(1, a), (None, a + " "), (None, b), (None, c), (2, d), (3, d), (3, e), (3, f), (None, b + "\n")]
    out = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((x.doc_id, x.text.strip()) for x in out)
    assert got == Counter([(1, a), (None, b), (None, c), (2, d), (3, e), (3, f)])


def covered(rows):
    """(n_bytes, n_removed, n_spans, sha) of each row, by sets of strings of smaller ids."""
    order = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 63), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(d):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats_are_those_of_brute_force(docs, none):
    got = suffixes.drop_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(covered([(d[0], d[1]) for d in corpus()]))
    assert suffixes.drop_repeats(none).count() == 0


@pytest.mark.parametrize("size", [0, 48 << 20])
def test_repeats_with_hashes_that_clash(docs, monkeypatch, size):
    """Hashes that agree for different rows, or different strings, change nothing; nor does the size from which tables are joined by sorting."""
    number, seen = suffixes._number, []

    def weak(seed, sha):
        seen.append(seed)
        return number(seed, sha) if seed else F.pmod(number(seed, sha), F.lit(7))

    monkeypatch.setattr(suffixes, "_number", weak)
    monkeypatch.setattr(suffixes, "BROADCAST", size)
    monkeypatch.setattr(suffixes, "BUCKET", 1 << 13)
    got = suffixes.drop_repeats(docs).collect()
    assert 1 in seen and Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(covered([(d[0], d[1]) for d in corpus()]))
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(3)]
    pick = [r.randrange(3) for _ in range(40)]
    text, size = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), np.full(40, 60)
    order, first = suffixes._kinds(np.zeros(40, np.uint64), np.zeros(40, np.uint64), np.arange(40) * 60, size, text)
    assert first.tolist() == [True] + [pick[a] != pick[b] for a, b in zip(order[:-1], order[1:])]


def test_texts_longer_than_a_piece(monkeypatch):
    r = random.Random(9)
    a = "".join(r.choice("abcdef ") for _ in range(2500))
    texts = [a, "q" * 30 + a[1200:1900] + "r" * 900, a[600:800]]
    buf, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(suffixes, "PIECE", 500)

    def strings():
        """(place, minimizer, text) of all strings of all runs."""
        for lo, at, _, runs in suffixes._runs_of(buf, off):
            for f, c, m, d in zip(runs.first, runs.count, runs.m, runs.doc, strict=True):
                yield from ((int(at + f + k), int(m), int(d + lo)) for k in range(c))

    whole = sorted(strings())
    monkeypatch.setattr(suffixes, "LONG", 700)
    assert sorted(strings()) == whole and len(whole) == sum(len(t) - 49 for t in texts)


def test_suffix_order_is_that_of_suffixes():
    r = random.Random(1)
    for _ in range(60):
        n, a = r.randrange(300), r.choice([1, 2, 26])
        s = np.array([r.randint(1, a) for _ in range(n)] * r.choice([1, 2]), np.int64)
        assert suffixes.suffix_order(s, 10**9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_cut_texts_keep_whole_characters(docs):
    out = {r.doc_id: r.text for r in suffixes.cut_repeats(docs).collect() if r.doc_id is not None}
    assert suffixes.cut_repeats(docs).columns == docs.columns
    assert out[7] == "" and out[0] is None and out[6] == corpus()[6][1]
    assert out[19].startswith("x") and set(out[19][1:]) <= {"é"}


def quality_of(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(zip(w, w[1:], w[2:]))
    cov = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov)


def test_quality_statistics(docs, none):
    got = quality.judge(docs).collect()
    rows = [(d[0], *quality_of(d[1])) for d in corpus()]
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == sum(r.kept for r in got)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_junk_goes_and_clean_stays(spark):
    r = random.Random(2)
    clean = [prose(r, r.randint(60, 200)) for _ in range(400)]
    junk = [c.replace(" ", "### ") for c in clean[:40]]
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *junk])]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(400))


def lines(r, n, twice):
    """A text of n lines of which ``twice`` repeat earlier ones."""
    own = [prose(r, 12) for _ in range(n - twice)]
    return "\n".join([*own, *own[:twice]])


def test_what_is_odd_follows_the_group(spark):
    """A fifth to almost a half of lines repeated is odd where hardly any document repeats lines, and not where many do."""
    r = random.Random(3)
    rows = [(i, lines(r, 20, 0), "en", "tidy") for i in range(500)] + [(1000 + i, lines(r, 20, 4 + i % 6), "en", "forum") for i in range(500)]
    rows += [(500 + k, lines(r, 20, k), "en", "tidy") for k in range(4, 10)]
    kept = {x.doc_id for x in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    base = {d for d, t, *_ in rows if 100 * quality_of(t)[4] <= 50 * quality_of(t)[0]}
    assert kept >= {d for d in base if d < 500 or d >= 1000} and {500 + k for k in range(6, 10)}.isdisjoint(kept)
    few = [x for x in rows if x[3] == "tidy"]
    kept = {x.doc_id for x in quality.keep_good(spark.createDataFrame(few, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(500))


def fences_of(rows):
    """(lang, source, metric) -> (low, high) from (lang, source, {metric: x}) by sorting all values."""
    def cut(x):
        s = max(0, x.bit_length() - quality.BITS)
        return x >> s << s

    def at(values, q):
        values = sorted(map(cut, values))
        return float(values[max(0, int(np.ceil(q * len(values))) - 1)])

    out = {}
    for m, (q1, q2, reach, more, low) in quality.RULES.items():
        everything = [x[m] for _, _, x in rows]
        wide = (at(everything, q1), at(everything, q2))
        wide = (*wide, wide[1] - wide[0])

        def drawn(values, wide):
            n, p = len(values), quality.PRIOR
            lo, hi = ((n * at(values, q) + p * w) / (n + p) for q, w in ((q1, wide[0]), (q2, wide[1])))
            return lo, hi, max(hi - lo, quality.LEAST_SPREAD * wide[2])

        for lang, source in {x[:2] for x in rows}:
            own = drawn([x[m] for a, s, x in rows if (a, s) == (lang, source)], drawn([x[m] for a, _, x in rows if a == lang], wide))
            out[lang, source, m] = (own[0] - reach * own[2] - more if low else -1.0, own[1] + reach * own[2] + more)
    return out


@pytest.mark.parametrize("groups", [100_000, -1])
def test_verdicts_are_those_of_sorted_values(spark, monkeypatch, groups):
    monkeypatch.setattr(quality, "GROUPS", groups)
    r = random.Random(4)
    sizes = {("en", "a"): 260, ("en", "b"): 30, ("de", "a"): 12, (None, "b"): 7, ("de", None): 3}
    rows = []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            t = lines(r, r.randint(6, 30), r.choice([0, 0, 0, 1, 3, 5]))
            t = t.replace("a", r.choice(["a"] * 8 + ["#", "aaaaaaaaaaa", ""]))
            rows.append((len(rows), t, lang, source, "x", 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, low_symbols int")
    part = lambda t: dict(zip(quality.RULES, (1000 * a // max(b, 1) for a, b in ((q[1], q[0]), (q[2], q[1]), (q[3], sum(1 for x in t.split("\n") if WORD.search(x))), (q[4], q[0]))))) if (q := quality_of(t)) else None
    good = {d: q[0] >= 50 and 100 * q[4] <= 50 * q[0] for d, t, *_ in rows if (q := quality_of(t))}
    limits = fences_of([(lang, source, part(t)) for d, t, lang, source, *_ in rows if good[d]])
    inside = lambda lang, source, x: all(limits[lang, source, m][0] <= x[m] <= limits[lang, source, m][1] for m in x)
    want = {d: good[d] and inside(lang, source, part(t)) for d, t, lang, source, *_ in rows}
    assert {x.doc_id: x.kept for x in quality.judge(docs).collect()} == want and 0 < sum(good.values()) - sum(want.values()) < 100
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == {d for d, k in want.items() if k}


def test_sketches_merge_to_the_whole(docs):
    stats = quality.text_stats(docs)
    whole = quality.merge(quality.sketches(stats), "lang").collect()
    parts = quality.sketches(stats.filter("doc_id % 2 = 0")).unionByName(quality.sketches(stats.filter("doc_id % 2 = 1 or doc_id is null")))
    assert Counter(map(tuple, quality.merge(parts, "lang").collect())) == Counter(map(tuple, whole))


def levels(sizes, cycle=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mix_targets_and_cuts(docs, none):
    sizes = mixing.measure(docs)
    rows = mixing.plan_mix(sizes, mixing.source_targets(sizes)).collect()
    per = Counter()
    for d in corpus():
        per[d[3]] += len(WORD.findall(d[1] or ""))
    want = levels(dict(per))
    taken = Counter()
    for r in rows:
        assert r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in per) and len(rows) == len(corpus())
    again = Counter(map(tuple, mixing.plan_mix(sizes, mixing.source_targets(sizes)).collect()))
    assert again == Counter(map(tuple, rows))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(words[s] == taken[s] for s in per)
    assert mixing.mix(none).count() == 0
    empty = mixing.measure(none)
    assert mixing.plan_mix(empty, mixing.source_targets(empty)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_mix_gives_each_word_where_rows_repeat(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "HIGH_BITS", 1)
    say = lambda n, w: " ".join([w] * n)
    rows = [(7, say(10, "same"), "a", 1.0, 2)] * 37 + [(None, say(9, "none"), "b", 1.0, 2)] * 41 + [(None, say(5 + i % 3, f"n{i}"), "b", 1.0, 2) for i in range(30)]
    rows += [(100 + i, say(20 + i, "c"), "c", 1.0, 2) for i in range(30)] + [(200 + i, say(11, "a"), "a", 1.0, 2) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, taken int").repartition(3)
    per = Counter()
    for _, t, s, *_ in rows:
        per[s] += len(t.split())
    want = {s: int(x + 1e-9) for s, x in levels(dict(per)).items()}
    assert any(w % per[s] for s, w in want.items())
    sizes = mixing.measure(docs)
    got = mixing.plan_mix(sizes.withColumns({"_sum": F.lit(1), "_left": F.lit("x"), "target": F.lit(0)}), mixing.source_targets(sizes)).collect()
    taken, words = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
    assert dict(taken) == want and len(got) == len(rows) and all(r._sum == 1 and r._left == "x" for r in got)
    for r in mixing.mix(docs).collect():
        words[r.source] += len(r.text.split())
    assert dict(words) == want


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 1000}, {"a": 5}, {"a": 0, "b": 0}, {"a": 10, None: 500, "b": 3, "c": 0}])
def test_mix_levels(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(levels(sizes))


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts(docs, none, rule):
    got = tokens.count_tokens(docs, rule=rule, keep=("doc_id", "lang")).collect()
    tok = tokens.bpe(f"{tokens.TOKENIZERS}/{tokens.RANKS}")
    want = Counter()
    for d in corpus():
        text = d[1] or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        cuts = np.cumsum([0] + [len(x.encode()) for x in lines])
        ids = tok.encode(text)
        count, cross, at = Counter(), Counter(), 0
        for i in ids:
            end = at + len(tok.bytes[i])
            a, b = np.searchsorted(cuts, at, side="right") - 1, np.searchsorted(cuts, end - 1, side="right") - 1
            share = {s: min(end, cuts[s + 1]) - max(at, cuts[s]) for s in range(a, b + 1)}
            to = {"first": a, "last": b, "most": max(share, key=lambda s: (share[s], -s))}[rule]
            count[to] += 1
            cross[a] += a != b
            at = end
        pos = 0
        for s, x in enumerate(lines):
            want[d[0], d[2], s, pos, pos + len(x), count[s], cross[s], len(ids)] += 1
            pos += len(x)
    assert Counter(map(tuple, got)) == want
    assert tokens.count_tokens(none).count() == 0


def attributed(parts, rule):
    """(start_char, end_char, n_tokens, n_crossing, doc_tokens) of each of a text's parts, token by token."""
    tok = tokens.bpe(f"{tokens.TOKENIZERS}/{tokens.RANKS}")
    cuts = np.cumsum([0] + [len(x.encode()) for x in parts])
    ids, at = tok.encode("".join(parts)), 0
    count, cross = Counter(), Counter()
    for i in ids:
        end = at + len(tok.bytes[i])
        share = [(min(end, cuts[s + 1]) - max(at, cuts[s]), -s) for s in range(len(parts))]
        on = [-s for n, s in share if n > 0]
        count[{"first": on[0], "last": on[-1], "most": -max(share)[1]}[rule]] += 1
        cross[on[0]] += len(on) > 1
        at = end
    chars = np.cumsum([0] + [len(x) for x in parts])
    return [(chars[s], chars[s + 1], count[s], cross[s], len(ids)) for s in range(len(parts))]


@pytest.mark.parametrize("rule", ["first", "last", "most"])
@pytest.mark.parametrize("sep", ["\n", " ", ""])
def test_tokens_of_fields(spark, rule, sep):
    r = random.Random(6)
    some = lambda: r.choice([None, "", "hel", "lo wor", "ld  ", "é", "日本", "a title", "  spaces ", "x" * 50, "\n\n"])
    rows = [(i, some(), some(), some(), 1) for i in range(120)] + [(None, None, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, url string, text string, field int").repartition(2)
    got = tokens.count_fields(docs, ["title", "url", "text"], sep, rule).collect()
    want = Counter()
    for i, *f, _ in rows:
        parts = [(x or "") + (sep if k < 2 else "") for k, x in enumerate(f)]
        for name, told in zip(("title", "url", "text"), attributed(parts, rule)):
            want[i, name, *told] += 1
    assert Counter(map(tuple, got)) == want and any(x.n_crossing for x in got)
    assert tokens.count_fields(docs.limit(0), ["title", "text"]).count() == 0


@pytest.mark.parametrize("rule, most", [("first", 200_000), ("last", 200_000), ("most", -1)])
def test_tokens_of_spans(spark, monkeypatch, rule, most):
    monkeypatch.setattr(tokens, "BROADCAST_SPANS", most)
    r = random.Random(7)
    texts = [None, "", "word", *["".join(r.choice(["hello ", "world", "é", "日本", "\n", "  ", "abc def"]) for _ in range(r.randrange(1, 30))) for _ in range(60)]]
    docs, spans, want = [(i, t, "n") for i, t in enumerate(texts)], [(None, "x", 0, 3), (9999, "y", 0, 3), (2, "far", 40, 50)], Counter()
    docs += [docs[5], (None, "no id", "n")]
    cuts = {}
    for i, t in enumerate(texts):
        at = sorted(r.sample(range(len(t or "") + 1), min(len(t or "") + 1, 2 * r.randrange(4))))
        cuts[i] = [(a, b) for a, b in zip(at[::2], at[1::2]) if a < b] if i != 2 else []
        spans += [(i, f"s{a}", a, b + (1000 if b == len(t) else 0)) for a, b in cuts[i]]
    for i, t, _ in docs:
        t, last, parts = t or "", 0, []
        for a, b in cuts.get(i, []):
            parts += [(None, t[last:a])] * (a > last) + [(f"s{a}", t[a:b])]
            last = b
        parts += [(None, t[last:])] * (last < len(t) or not parts)
        for (name, _), told in zip(parts, attributed([x for _, x in parts], rule)):
            want[i, name, *told] += 1
    table = spark.createDataFrame(spans, "doc_id long, name string, start_char int, end_char int")
    frame = spark.createDataFrame(docs, "doc_id long, text string, name string").repartition(2)
    assert Counter(map(tuple, tokens.count_spans(frame, table, rule=rule).collect())) == want
    with pytest.raises(Exception, match="overlap"):
        tokens.count_spans(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), spark.createDataFrame([(1, "a", 0, 5), (1, "b", 4, 6)], table.schema)).collect()


def test_tokens_across_boundaries():
    start, end = np.array([0, 3, 9]), np.array([3, 9, 10])
    sections = np.array([0, 4, 8])
    assert tokens.allocate(start, end, sections, "first")[0].tolist() == [0, 0, 2]
    assert tokens.allocate(start, end, sections, "last")[0].tolist() == [0, 2, 2]
    assert tokens.allocate(start, end, sections, "most")[0].tolist() == [0, 1, 2]
    assert tokens.allocate(start, end, sections, "most")[1].tolist() == [False, True, False]
    with pytest.raises(ValueError):
        tokens.allocate(start, end, sections, "none")


def test_pieces_are_lossless_and_repeat(docs, none):
    a = pieces.encode(docs)
    rows = a.collect()
    assert all(r.lossless for r in rows) and a.columns[: len(docs.columns)] == docs.columns
    assert Counter((r.doc_id, tuple(r.pieces)) for r in rows) == Counter((r.doc_id, tuple(r.pieces)) for r in pieces.encode(docs.repartition(1)).collect())
    back = pieces.decode(a.select("doc_id", "text", "pieces")).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode(none).count() == 0
    other = pieces.encode(docs, seed=1).collect()
    assert {tuple(r.pieces) for r in other if r.n_pieces > 50} != {tuple(r.pieces) for r in rows if r.n_pieces > 50}


def test_sampled_pieces_follow_their_weights():
    model, n = pieces.pieces(f"{pieces.TOKENIZERS}/{pieces.MODEL}", "zipf"), 20_000
    text = "hello"
    buf = np.frombuffer((text * n).encode(), np.uint8)
    ids, at, same = pieces.segment(model, buf, np.arange(n + 1) * len(text), np.arange(n, dtype=np.uint64), 1.0)
    assert same.all()
    got = Counter(tuple(ids[a:b]) for a, b in zip(at[:-1], at[1:]))
    known = {x: i for i, x in enumerate(model.bytes) if x and i not in model.byte_id}

    def ways(b):
        if not b:
            yield (), 0.0
        for k in range(1, len(b) + 1):
            if b[:k] in known:
                for rest, w in ways(b[k:]):
                    yield (known[b[:k]], *rest), w + model.weight[known[b[:k]]]

    weights = {s: np.exp(w) for s, w in ways(b" " + text.encode())}
    total = sum(weights.values())
    assert set(got) <= set(weights)
    for s, w in weights.items():
        assert abs(got[s] / n - w / total) < 0.02


def test_cuts_of_whole_documents_follow_their_weights():
    """Forward and backward sums over the lattice of a whole text, without runs, give the chance of a cut at each byte."""
    model, n = pieces.pieces(f"{pieces.TOKENIZERS}/{pieces.MODEL}", "zipf"), 3000
    text = "Whole documents are sampled, not words: the lattice runs from the first byte to the last one, 1234 times over."
    b = b" " + text.encode()
    known = {x: model.weight[i] for i, x in enumerate(model.bytes) if x and i not in model.byte_id}
    most = max(map(len, known))
    ahead, back = np.zeros(len(b) + 1), np.zeros(len(b) + 1)
    ahead[0] = back[-1] = 1.0
    for i in range(1, len(b) + 1):
        ahead[i] = sum(ahead[k] * np.exp(known[b[k:i]]) for k in range(max(0, i - most), i) if b[k:i] in known)
    for i in range(len(b) - 1, -1, -1):
        back[i] = sum(back[k] * np.exp(known[b[i:k]]) for k in range(i + 1, min(len(b), i + most) + 1) if b[i:k] in known)
    want = ahead * back / ahead[-1]
    buf = np.frombuffer((text * n).encode(), np.uint8)
    ids, at, same = pieces.segment(model, buf, np.arange(n + 1) * len(text.encode()), np.arange(n, dtype=np.uint64), 1.0)
    assert same.all()
    got = np.zeros(len(b) + 1)
    for lo, hi in zip(at[:-1], at[1:]):
        got[np.r_[0, np.cumsum(model.length[ids[lo:hi]])]] += 1
    assert np.abs(got / n - want).max() < 0.05 and ((want > 0.1) & (want < 0.9)).sum() > 10


def test_clustered_columns_keep_their_names(spark):
    rows = [(1, 5, "a", "b", 1.0), (2, 5, "a", "b", 2.0), (3, None, "a", "b", 3.0), (4, 4, "a", "b", 4.0), (5, 7 << 40, "x", "y", 0.0), (None, 7 << 40, "x", "y", 0.0)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long, least string, component string, component_id double")
    got = simhash.cluster(prints)
    assert got.columns == ["doc_id", "fp", "least", "component", "component_id"]
    assert sorted((r.doc_id or 0, r.least, r.component_id) for r in got.collect()) == [(0, "x", 5), (1, "a", 1), (2, "a", 1), (3, "a", 3), (4, "a", 1), (5, "x", 5)]
