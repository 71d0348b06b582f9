"""SimHash near-duplicates: fingerprints of word shingles, and a self-join of their binary trie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import LOWER, U, buffer, joined_words, xxh64
from .common import components, delete, lean, materialise, settled, small_batches, table

BITS = 64
#: Fingerprints that one task joins at once; a trie root with more is cut into blocks, of which each pair is a task's.
ROOT_ROWS = 50_000
#: Node pairs that go down the trie at once.
FRONTIER = 1 << 16
#: Tries of a similarity join: each fingerprint of 64 bits is the key of two, its halves exchanged. A pair is a candidate if in any trie
#: its keys differ in at most ERRORS of the leading PREFIX bits and TOTAL of all, and its check fingerprints in at most CHECK bits.
TRIES, PREFIX, ERRORS, TOTAL, CHECK = 32, 32, 2, 14, 20
#: Tries that are joined alone first, one a turn, each giving stars: what hangs together is held against its node with the most partners.
STARS = 4
#: Members of a component, and documents near it, that one task compares; more are cut into blocks, of which each pair is a task's.
FAMILY = 256
#: Nodes near components that a task holds before it sends them, 32 bytes each.
HELD = 1_000_000
#: Nodes near components that a task may tell of any family, however small; see ``_candidates``.
TOLD = 16
#: Copies up to which their ids and text hashes (16 bytes) are broadcast to the documents; beyond, the anti-join sorts and merges.
BROADCAST_ROWS = 2_000_000
#: A place is a turn and a root: the turn in the bits above these.
_ROOT = 24


def majority(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The 64 bits set in over half the hashes; zero for none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def shingles(buf: np.ndarray, off: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and where each text's begin."""
    text, start, end, first = joined_words(LOWER[buf], off)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    base = np.r_[0, np.cumsum(count)]
    i = np.arange(base[-1]) - np.repeat(base[:-1] - first[:-1], count)  # first word of each shingle
    last = np.minimum(i + width - 1, np.repeat(first[1:], count) - 1)
    return xxh64(text, start[i], end[last] - start[i], seed), base


def fingerprints(buf: np.ndarray, off: np.ndarray, width: int, seed: int) -> np.ndarray:
    h, base = shingles(buf, off, width, seed)
    return np.array([majority(h[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)], np.uint64)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp (long): per text, in whole, lower-cased in A-Z, over shingles of ``width`` words, repeats included.

    A text of fewer words has its whole sequence as its shingle; null, empty and white texts have fingerprint 0. ``keep``
    may not name a column fp. Rows that repeat have a row each, and an empty table gives no rows.
    """
    kept = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_b"))

    def run(batches):
        for batch in batches:
            buf, off = buffer(batch.column(len(keep)))
            for lo, hi in _pieces(off):
                fp = fingerprints(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width, seed)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]], pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[: len(keep)]) + ", fp long"
    return kept.mapInArrow(lean(run), schema)


def _pieces(off: np.ndarray, size: int = 256 << 10):
    """Runs of texts of about ``size`` bytes, so that arrays over a batch's bytes stay small; a longer text is alone."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def steps(budget) -> list[tuple[int, int]]:
    """An error budget as [(leading bits, most that differ among them)], from that or from a number for all bits."""
    return [(BITS, budget)] if isinstance(budget, int) else list(budget)


def traverse(keys: np.ndarray, left: np.ndarray, right: np.ndarray, budget, bits: int = BITS, known=None):
    """Yields arrays of pairs (i, j) of sorted ``keys`` within ``budget`` (see ``steps``), from pairs of trie nodes.

    A node is a range of the sorted keys that share their leading bits; ``left`` and ``right`` are (n, 2) ranges, all at
    the same depth, ``64 - bits`` bits down. Both nodes of a pair go down together; children that disagree spend one bit
    of the budget and pairs beyond it are cut off. Small pairs are compared outright. At most FRONTIER pairs go down at
    once, the rest waits on a stack, so memory doesn't follow the number of pairs. ``known(left, right)`` may tell
    node pairs that need no more pairs.
    """
    budget = steps(budget)
    stack = [(bits - 1, left, right, np.zeros(len(left), np.int64))]
    while stack:
        bit, left, right, spent = stack.pop()
        if len(left) > FRONTIER:
            stack += [(bit, left[k : k + FRONTIER], right[k : k + FRONTIER], spent[k : k + FRONTIER]) for k in range(0, len(left), FRONTIER)]
            continue
        if known is not None and len(left):
            on = ~known(left, right)
            left, right, spent = left[on], right[on], spent[on]
        small = (left[:, 1] - left[:, 0]) * (right[:, 1] - right[:, 0]) <= 16 if bit >= 0 else np.ones(len(left), bool)
        if small.any():
            yield from _compare(keys, left[small], right[small], budget)
            left, right, spent = left[~small], right[~small], spent[~small]
        if not len(left):
            continue
        most = next(m for b, m in budget if b >= BITS - bit)
        # the first key with this bit set
        mid = lambda r, bit=bit: np.clip(np.searchsorted(keys, ((keys[r[:, 0]] >> U(bit)) | U(1)) << U(bit)), r[:, 0], r[:, 1])
        ml, mr, same = mid(left), mid(right), (left == right).all(axis=1)
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                a = np.stack([(left[:, 0], ml)[x], (ml, left[:, 1])[x]], axis=1)
                b = np.stack([(right[:, 0], mr)[y], (mr, right[:, 1])[y]], axis=1)
                cost = spent + (x != y)
                ok = (cost <= most) & (a[:, 1] > a[:, 0]) & (b[:, 1] > b[:, 0])
                if (x, y) == (1, 0):
                    ok &= ~same  # the mirror of (0, 1)
                ok &= ~((a == b).all(axis=1) & (a[:, 1] - a[:, 0] == 1))  # a key with itself
                parts.append((a[ok], b[ok], cost[ok]))
        stack.append((bit - 1, *(np.concatenate(z) for z in zip(*parts, strict=True))))


def trie_pairs(keys: np.ndarray, left: np.ndarray, right: np.ndarray, budget, bits: int = BITS) -> np.ndarray:
    """All pairs at once."""
    return np.concatenate([np.zeros((0, 2), np.int64), *traverse(keys, left, right, budget, bits)])


def _compare(keys: np.ndarray, left: np.ndarray, right: np.ndarray, budget: list[tuple[int, int]]):
    """Pairs of two nodes' keys within the budget, about FRONTIER comparisons at a time."""
    cut = [0, *(np.flatnonzero(np.diff(np.cumsum((left[:, 1] - left[:, 0]) * (right[:, 1] - right[:, 0])) // FRONTIER)) + 1), len(left)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        l, r = left[lo:hi], right[lo:hi]  # noqa: E741
        nr = r[:, 1] - r[:, 0]
        each = (l[:, 1] - l[:, 0]) * nr
        k = np.arange(each.sum()) - np.repeat(np.r_[0, np.cumsum(each)[:-1]], each)
        nr_, same = np.repeat(nr, each), np.repeat((l == r).all(axis=1), each)
        i, j = np.repeat(l[:, 0], each) + k // nr_, np.repeat(r[:, 0], each) + k % nr_
        differ = keys[i] ^ keys[j]
        ok = ~same | (i < j)
        for b, most in budget:
            ok &= np.bitwise_count(differ >> U(BITS - b)) <= most
        if ok.any():
            yield np.stack([i[ok], j[ok]], axis=1)


class Trees:
    """Disjoint trees over 0..n-1, joined by arrays of pairs; the root of a tree is its smallest node.

    ``labels``: nodes of one label hang together from the start.
    """

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.root, self._changes = np.arange(n), None
        if labels is not None and n:
            _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
            self.root = first[inverse]

    def join(self, pairs: np.ndarray) -> None:
        root, (a, b) = self.root, (self.root[pairs[:, 0]], self.root[pairs[:, 1]])
        a, b = a[a != b], b[a != b]
        if len(a):
            self._changes = None
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether all nodes of both ranges are in one tree."""
        if self._changes is None:
            self._changes = np.r_[0, 0, np.cumsum(self.root[1:] != self.root[:-1])]  # [k]: changes among the first k nodes
        c = self._changes
        one = lambda r: c[r[:, 1]] == c[r[:, 0] + 1]
        return one(left) & one(right) & (self.root[left[:, 0]] == self.root[right[:, 0]])

    def edges(self) -> np.ndarray:
        away = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.stack([away, self.root[away]], axis=1)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest of ``pairs`` over 0..n-1 as (node, smallest node of its tree)."""
    trees = Trees(n)
    trees.join(pairs)
    return trees.edges()


# --- trie rows: place, pair, block, key and more; a place is a turn and a root of its trie -----------------------------


def _dealt(rows: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """``rows`` (place, more) with block and pair, dealt by (pair, place) and sorted by it.

    Places with more than ROOT_ROWS rows (``counts``: place, n) are cut into blocks by a hash of ``by``, and a row goes to
    each pair of blocks that its own is in, so a task never holds more than two blocks of a place.
    """
    full = counts.filter(F.col("n") > ROOT_ROWS).select(F.col("place").alias("_p"), F.ceil(F.col("n") / ROOT_ROWS).cast("long").alias("_blocks"))
    n = full.count()
    if n:
        rows = rows.join(F.broadcast(full) if n <= BROADCAST_ROWS else full, F.expr("place = _p"), "left")
        rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.lit(1), by), F.col("_blocks")), F.lit(-1).cast("long")))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda x: F.shiftleft(F.least(x, F.col("block")), 24) + F.greatest(x, F.col("block")))
        rows = rows.withColumn("pair", F.explode(F.when(F.col("_blocks").isNotNull(), pairs).otherwise(F.array(F.lit(-1).cast("long"))))).drop("_p", "_blocks")
    else:
        rows = rows.withColumns({"block": F.lit(-1).cast("long"), "pair": F.lit(-1).cast("long")})
    return rows.repartition("pair", "place").sortWithinPartitions("pair", "place")


def _segments(batches):
    """(turn, rows) from dealt rows: columns by name, sorted by key as unsigned numbers, of whole places of one turn and pair, about ROOT_ROWS at a time."""
    held, size = [], 0

    def of(parts):
        x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        turn = x["place"] >> _ROOT
        cut = np.flatnonzero((turn[1:] != turn[:-1]) | (x["pair"][1:] != x["pair"][:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(turn)], strict=True):
            part = {c: v[a:b] for c, v in x.items()}
            part["key"] = part["key"].view(np.uint64)
            order = np.argsort(part["key"], kind="stable")
            yield int(turn[a]), {c: v[order] for c, v in part.items()}

    for batch in batches:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        n = batch.num_rows
        if not n:
            continue
        change = np.flatnonzero((x["place"][1:] != x["place"][:-1]) | (x["pair"][1:] != x["pair"][:-1])) + 1
        first = not held or (held[-1]["place"][-1], held[-1]["pair"][-1]) != (x["place"][0], x["pair"][0])
        cut = int(change[-1]) if len(change) else 0
        if size + cut >= ROOT_ROWS and (cut or first):
            held.append({c: v[:cut] for c, v in x.items()})
            yield from of([h for h in held if len(h["place"])])
            held, size, x = [], 0, {c: v[cut:] for c, v in x.items()}
        held.append(x)
        size += len(x["place"])
    if size:
        yield from of(held)


def _nodes(keys: np.ndarray, width: int) -> np.ndarray:
    """The ranges of sorted keys that share their first ``width`` bits, where more than one does."""
    top = keys >> U(BITS - width)
    cut = np.r_[0, np.flatnonzero(top[1:] != top[:-1]) + 1, len(keys)]
    out = np.stack([cut[:-1], cut[1:]], axis=1)
    return out[out[:, 1] - out[:, 0] > 1]


def _across(x: dict) -> np.ndarray | None:
    """Blocks of the rows, if only pairs of different ones are wanted here."""
    pair = int(x["pair"][0])
    return x["block"] if pair >= 0 and pair >> 24 != pair & ((1 << 24) - 1) else None


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks of ``bits`` bits: keys within the budget agree in one."""
    widths = [bits // (budget + 1) + (i < bits % (budget + 1)) for i in range(budget + 1)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """A spanning set (a, b) of the links between distinct fingerprints ``fp`` that differ in at most ``budget`` bits.

    The 64 bits fall into budget + 1 blocks, so linked fingerprints agree in one: each block in turn is rotated to the
    top and its values are the roots of a trie, of which pairs of nodes are traversed below. A task takes whole roots, some
    ROOT_ROWS fingerprints at a time, and gives a forest of their links, not all pairs. No fingerprints give no links.
    """
    blocks = _blocks(BITS, budget)
    turns = []
    for i, (at, w) in enumerate(blocks):
        key = F.expr(f"(fp << {at}) | shiftrightunsigned(fp, {BITS - at})" if at else "fp")
        turns.append(F.struct(F.lit(i << _ROOT).cast("long").alias("turn"), F.lit(BITS - w).alias("down"), key.alias("key")))
    rows = prints.select("fp").distinct().select(F.explode(F.array(*turns)).alias("t")).select((F.col("t.turn") + F.expr("shiftrightunsigned(t.key, t.down)")).alias("place"), "t.key")

    def run(batches):
        for turn, x in _segments(batches):
            (at, width), keys, block = blocks[turn], x["key"], _across(x)
            trees = Trees(len(keys))
            node = _nodes(keys, width)
            for pairs in traverse(keys, node, node.copy(), budget, BITS - width, trees.together):
                trees.join(pairs if block is None else pairs[block[pairs[:, 0]] != block[pairs[:, 1]]])
            tree = trees.edges()
            if len(tree):
                back = ((keys >> U(at)) | (keys << U(BITS - at)) if at else keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(back[tree[:, 0]]), pa.array(back[tree[:, 1]])], ["a", "b"])

    counts = rows.groupBy("place").agg(F.count("*").alias("n"))
    return _dealt(rows, counts, "key").mapInArrow(lean(run), "a long, b long")


def cluster(prints: DataFrame, budget: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp, any more) with component_id, the smallest doc_id that links reach.

    Documents of one fingerprint are one node, so copies never pair up. A null doc_id can't name a component: it is
    no candidate for the smallest, and a component of nulls only has a null component_id. A null fp links with nothing else. A
    column component_id of ``prints`` is replaced, others keep any name they have. An empty table gives no rows.
    """
    kept = [c for c in prints.columns if c != "component_id"]
    prints, _ = materialise(prints.select(*[f"`{c}`" for c in kept]), "fingerprints")
    comp = components(links(prints.filter("fp is not null"), budget)).select(F.col("node").alias("fp"), "component")
    rows = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rows.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rows.select(F.col("fp").alias("_fp"), F.col("component").alias("_c")).join(least, F.expr("_c <=> component")).select("_fp", "component_id")
    row = prints.select(F.struct(*[f"`{c}`" for c in kept]).alias("_row"), F.col("fp").alias("_key"))  # so no column clashes
    return row.join(named, F.expr("_key <=> _fp")).select("_row.*", "component_id")


def _marked(docs: DataFrame) -> DataFrame:
    """__tid beside the columns: with doc_id it tells rows of one doc_id, or of none, apart by their texts."""
    return docs.withColumn("__tid", F.xxhash64("text"))


def _keep_least(docs: DataFrame, rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``docs`` without the copies: ``rows`` are (doc_id, __tid, key), ``comp`` the components of those keys that have links."""
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__tid")  # null ids last
    per = rows.groupBy("key").agg(F.min(who).alias("least")).join(comp.select(F.col("node").alias("key"), "component"), "key", "left")
    per = per.withColumn("component", F.coalesce("component", "key"))
    named = per.select("key", "component").join(per.groupBy("component").agg(F.min("least").alias("least")), "component").select("key", "least")
    found = rows.join(named, "key")
    stays = "doc_id <=> least.doc_id and __tid = least.__tid"
    gone, _ = materialise(found.filter(f"not ({stays})").select(F.col("doc_id").alias("__gone_id"), F.col("__tid").alias("__gone_tid")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = docs.join(gone, F.expr("doc_id <=> __gone_id and xxhash64(text) = __gone_tid"), "left_anti")
    twice = found.filter(stays).groupBy("doc_id", "__tid").count().filter("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def drop_near_copies(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id, all its columns as they were.

    Rows are told apart by doc_id and text, so only the copies go where a doc_id repeats or is null; a null doc_id comes
    last, and of several texts of the smallest doc_id one stays. Rows that agree in both stay once. Documents without
    words carry fingerprint 0 and so are copies of each other.
    """
    prints, _ = materialise(with_fingerprint(_marked(docs), width=width, keep=("doc_id", "__tid")), "fingerprints")
    comp = components(links(prints, budget))
    return _keep_least(docs, prints.withColumnRenamed("fp", "key"), comp)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    h, base = shingles(buf, off, width, seed)
    sets = [np.unique(h[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a row of independent hashes of hashes."""
    r = np.random.default_rng([1, k])
    mask, odd, again = r.integers(0, 1 << 64, 3, np.uint64) | np.array([0, 1, 1], np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ mask) * odd
        h ^= h >> U(32)
        h *= again
    return h ^ (h >> U(29))


def set_prints(sets: np.ndarray, cut: np.ndarray, words: int) -> np.ndarray:
    """(texts, words) of 64 bits each: a bit is 1 if set in over half the k-th hashes of the text's set. No set may be empty.

    Eight bits are counted at once in the bytes of a number, over runs of at most 255 hashes, so the cost is a few operations a hash and 8 bits.
    """
    n = np.diff(cut)
    runs = -(-n // 255)
    head = np.r_[0, np.cumsum(runs)[:-1]]
    start = np.repeat(cut[:-1], runs) + 255 * (np.arange(runs.sum()) - np.repeat(head, runs))
    out = np.zeros((len(n), words), np.uint64)
    lane = U(0x0101010101010101)
    for k in range(words):
        h = _mixed(sets, k)
        bits = np.empty((len(n), 8, 8), bool)  # byte, bit in it
        for b in range(8):
            total = np.add.reduceat((h >> U(b)) & lane, start).view(np.uint8).reshape(-1, 8)
            bits[:, :, b] = 2 * np.add.reduceat(total, head, axis=0, dtype=np.int64) > n[:, None]
        out[:, k] = np.packbits(bits.reshape(len(n), 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def _with_prints(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(doc_id, __tid, key, prints) of ``_marked`` documents: key stands for the set of shingles; prints is empty for an empty set.

    prints has a fingerprint for every two tries, and one more to check candidates by.
    """
    keep, words = ["doc_id", "__tid"], TRIES // 2 + 1
    kept = docs.select(*keep, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_b"))

    def run(batches):
        for batch in batches:
            buf, off = buffer(batch.column(2))
            for lo, hi in _pieces(off):
                sets, cut = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width, seed)
                n = np.diff(cut)
                some = n > 0
                key = xxh64(sets.view(np.uint8), 8 * cut[:-1], 8 * n, seed)
                prints = set_prints(sets, np.r_[cut[:-1][some], len(sets)], words).view(np.int64)
                at = pa.array(np.r_[0, np.cumsum(np.where(some, words, 0))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:2]], pa.array(key.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(prints.ravel()))], [*keep, "key", "prints"])

    return kept.mapInArrow(lean(run), f"doc_id {dict(kept.dtypes)['doc_id']}, __tid long, key long, prints array<long>")


def _trie_keys(prints: np.ndarray, tries, blocks):
    """(turn, key with a block of the prefix on top, place) of each trie and block, from (nodes, words) fingerprints."""
    for t in tries:
        word = prints[:, t // 2].view(np.uint64)
        word = (word << U(32)) | (word >> U(32)) if t % 2 else word
        for i, (at, width) in enumerate(blocks):
            top, turn = word >> U(BITS - PREFIX), t * len(blocks) + i
            top = ((top << U(at)) | (top >> U(PREFIX - at))) & U((1 << PREFIX) - 1)
            key = (top << U(BITS - PREFIX)) | (word & U((1 << (BITS - PREFIX)) - 1))
            yield turn, key, (turn << _ROOT) + (key >> U(BITS - width)).astype(np.int64)


def _candidates(nodes: DataFrame, tries, stars: bool) -> DataFrame:
    """What any of ``tries`` brings together of ``nodes`` (key, prints, label, size of the label) with different labels.

    With ``stars`` (a, b), pairs of nodes: of what hangs together in a root, the node with the most partners, of the label with the
    most nodes, and the like node of each other label. Else (a, b, family): each node b near a larger component a (of two of one
    size, that with the larger label), once, however many of its members are near, and the family of both or null: pairs are never
    written out. ``nodes`` have family and many then, a larger component that holds their label's, and its nodes. Where a task finds so
    much inside a family that holding all its nodes against each other takes no more rows, it tells (family, family, family) in its place.
    """
    blocks, tries = _blocks(PREFIX, ERRORS), list(tries)
    more = ["label", "size"] if stars else ["label", "size", "family", "many"]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def prints_of(batch):
        n = batch.num_rows
        return batch.column("prints").flatten().to_numpy().reshape(n, -1)

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                places, n = np.unique(np.concatenate([p for _, _, p in _trie_keys(prints_of(batch), tries, blocks)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(n)], ["place", "n"])

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                prints, kept = prints_of(part), [part.column(c) for c in ("key", *more)]
                check = pa.array(np.ascontiguousarray(prints[:, -1]))
                for _, k, place in _trie_keys(prints, tries, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(k.view(np.int64)), check, *kept], ["place", "key", "check", "id", *more])

    def sifted(held, dense):
        """What a task has found, each once, without the families that are or become dense by it."""
        near = np.unique(np.concatenate(held, axis=1), axis=1)
        _, kind, told = np.unique(near[2], return_inverse=True, return_counts=True)
        full = (near[3] > 0) & (told[kind] > np.maximum(TOLD, near[3] * -(-near[3] // FAMILY) // tasks))
        new = np.unique(near[2][full])
        dense = np.union1d(dense, new)
        return near[:, (near[3] == 0) | ~np.isin(near[2], dense)], dense, new

    def sent(near):
        return pa.RecordBatch.from_arrays([pa.array(near[0]), pa.array(near[1]), pa.array(near[2], mask=near[3] == 0)], ["a", "b", "family"])

    def join(batches):
        held, size_held, limit, dense = [], 0, FRONTIER, np.zeros(0, np.int64)  # what this task has found; each goes out once, unless HELD is passed
        for turn, x in _segments(batches):
            width, keys, block = blocks[turn % len(blocks)][1], x["key"], _across(x)
            check, label, names, size = x["check"].view(np.uint64), x["label"], x["id"], x["size"]
            hang = label
            if not stars:  # dense families need nothing more: their nodes count as together
                family, many = x["family"], x["many"]
                hang = np.where(np.isin(family, dense), family, label)
            trees, node, degree = Trees(len(keys), hang), _nodes(keys, width), np.zeros(len(keys), np.int64)
            for pairs in traverse(keys, node, node.copy(), [(PREFIX, ERRORS), (BITS, TOTAL)], BITS - width, trees.together):
                i, j = pairs.T
                ok = (np.bitwise_count(check[i] ^ check[j]) <= CHECK) & (hang[i] != hang[j])
                i, j = pairs[ok if block is None else ok & (block[i] != block[j])].T
                if stars:
                    degree += np.bincount(np.r_[i, j], minlength=len(keys))
                    trees.join(np.stack([i, j], axis=1))
                elif len(i):
                    home, one = (size[i] > size[j]) | ((size[i] == size[j]) & (label[i] > label[j])), family[i] == family[j]
                    near = np.stack([np.where(home, label[i], label[j]), np.where(home, names[j], names[i]), np.where(one, family[i], 0), np.where(one, many[i], 0)])
                    held.append(np.unique(near, axis=1))
                    size_held += held[-1].shape[1]
                    if size_held > limit:
                        near, dense, new = sifted(held, dense)
                        if len(new):
                            on = np.flatnonzero(np.isin(family, new))
                            hang = hang.copy()
                            hang[on] = family[on]
                            _, first, of = np.unique(family[on], return_index=True, return_inverse=True)
                            trees.join(np.stack([on, on[first[of]]], axis=1))
                        held, size_held = [near], near.shape[1]
                        if size_held > HELD:
                            yield sent(near)
                            held, size_held = [], 0
                        limit = 2 * size_held + FRONTIER
            if stars and degree.any():
                yield _pairs(names, _stars(trees.root, label, degree))
        if held:
            near, dense, _ = sifted(held, dense)
            yield sent(near)
        if len(dense):
            yield sent(np.stack([dense, dense, dense, np.ones_like(dense)]))

    nodes = nodes.filter(F.size("prints") > 0)
    if nodes.count() > ROOT_ROWS:
        counts = nodes.select("prints").mapInArrow(lean(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    else:  # no root can be full
        counts = nodes.sparkSession.createDataFrame([], "place long, n long")
    dealt = _dealt(nodes.select("key", "prints", *more).mapInArrow(lean(rows), "place long, key long, check long, id long" + "".join(f", {c} long" for c in more)), counts, "id")
    return dealt.mapInArrow(lean(join), "a long, b long" if stars else "a long, b long, family long").distinct()


def _stars(root: np.ndarray, label: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Pairs (node, centre) of each tree: for each label but the centre's, its node with the most partners."""
    on = np.flatnonzero(degree)
    _, kind, many = np.unique(np.stack([root[on], label[on]]), axis=1, return_inverse=True, return_counts=True)
    order = np.lexsort((on, -degree[on], kind.ravel(), -many[kind.ravel()], root[on]))
    on, kind = on[order], kind.ravel()[order]
    first = np.r_[True, root[on][1:] != root[on][:-1]]
    centre = on[np.maximum.accumulate(np.where(first, np.arange(len(on)), 0))]
    lead = np.r_[True, kind[1:] != kind[:-1]] & (label[on] != label[centre])
    return np.stack([on[lead], centre[lead]], axis=1)


def _pairs(names: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    a, b = names[pairs[:, 0]], names[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _sets(docs: DataFrame, of: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(key, data): the shingle sets of ``of`` (least, key), 8 bytes each, from the texts of ``docs``."""
    of = of.select(F.col("least.doc_id").alias("__id"), F.col("least.__tid").alias("__t"), "key")
    of = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    kept = docs.select("doc_id", "text").join(of, F.expr("doc_id <=> __id and xxhash64(text) = __t")).select("key", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_b"))

    def run(batches):
        for batch in batches:
            buf, off = buffer(batch.column(1))
            for lo, hi in _pieces(off):
                sets, cut = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([sets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["key", "data"])

    return kept.mapInArrow(lean(run), "key long, data binary").dropDuplicates(["key"])


def _alike(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a Jaccard similarity of at least ``least`` hundredths, exactly."""
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("data").alias("db")), "b").join(sets.select(F.col("key").alias("a"), F.col("data").alias("da")), "a")

    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                z = np.sort(np.concatenate([p, q]), kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                ok.append(100 * same >= least * (len(z) - same))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, o in zip(a, ok) if o], pa.int64()), pa.array([i for i, o in zip(b, ok) if o], pa.int64())], ["a", "b"])

    return both.select("a", "b", "da", "db").mapInArrow(lean(run), "a long, b long")


def _near_members(near: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, width: int) -> DataFrame:
    """(a, b): of each (home, id) of ``near`` the member b of the component home that is most like a = id, if that is similar enough.

    Sets of shingles meet by component: its members in blocks of FAMILY, and the nodes near it in blocks too, each pair of
    blocks in a task, where every node is held against every member at once.
    """
    near, path = materialise(near.withColumnsRenamed({"a": "home", "b": "id"}), "near")
    homes = near.groupBy("home").agg(F.count("*").alias("k"))
    homes = homes.join(nodes.groupBy(F.col("label").alias("home")).agg(F.count("*").alias("m")), "home")
    blocks = lambda c: F.ceil(F.col(c) / FAMILY).cast("long")
    homes, sized = materialise(homes.select("home", blocks("k").alias("kb"), blocks("m").alias("mb")), "homes")
    own = F.pmod(F.xxhash64(F.lit(2), "id"), F.col("n"))
    rows = near.join(homes, "home").withColumnsRenamed({"kb": "n", "mb": "other"}).withColumn("member", F.lit(False))
    rows = rows.unionByName(nodes.select(F.col("label").alias("home"), F.col("key").alias("id")).join(homes, "home").withColumnsRenamed({"mb": "n", "kb": "other"}).withColumn("member", F.lit(True)))
    rows = rows.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    rows = rows.select("home", "id", "member", F.when(F.col("member"), F.col("own")).otherwise(F.col("x")).alias("i"), F.when(F.col("member"), F.col("x")).otherwise(F.col("own")).alias("j"))
    rows, cast = materialise(rows, "cast")
    ids = rows.select(F.col("id").alias("key")).distinct()
    sets, kept = materialise(_sets(docs, nodes.join(ids, "key", "left_semi").select("least", "key"), width), "sets")

    def run(batches):
        for _, x in _families(batches):
            member, size = x["member"], x["sizes"]
            of = np.flatnonzero(member)
            if not len(of) or member.all():
                continue
            a, b = [], []
            for k, shared in _shared(x, np.flatnonzero(~member), member):
                alike = 100 * shared[of] - least * (size[k] + size[of] - shared[of])
                best = int(np.argmax(alike))
                if alike[best] >= 0:
                    a.append(int(x["id"][k]))
                    b.append(int(x["id"][of[best]]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    small_batches(docs.sparkSession, 2 * FAMILY)
    dealt = rows.join(sets.withColumnRenamed("key", "id"), "id").select("home", "i", "j", "id", "member", "data").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    found, _ = materialise(dealt.mapInArrow(lean(run), "a long, b long"), "similar")
    small_batches(docs.sparkSession)
    delete(docs.sparkSession, path, sized, cast, kept)
    return found


def _within(families: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, width: int) -> DataFrame:
    """(a, b): labels of components of one of ``families`` (family) that have similar members; a forest of them for every pair of blocks.

    All nodes of a family are held against each other: they fall into blocks of FAMILY, and each pair of blocks is a task's.
    """
    families = F.broadcast(families) if families.count() <= BROADCAST_ROWS else families
    rows = nodes.join(families, "family").withColumn("n", F.ceil(F.col("many") / FAMILY).cast("long")).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "key"), F.col("n")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select(F.col("family").alias("home"), "key", F.col("label").alias("id"), (F.col("own") <= F.col("x")).alias("member"), F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    rows, cast = materialise(rows, "cast")
    sets, kept = materialise(_sets(docs, nodes.join(rows.select("key").distinct(), "key", "left_semi").select("least", "key"), width), "sets")

    def run(batches):
        for (_, i, j), x in _families(batches):
            names, at = np.unique(x["id"], return_inverse=True)
            if len(names) == 1:
                continue
            trees, member, size = Trees(len(names)), x["member"], x["sizes"]
            for k, shared in _shared(x, np.arange(len(size)) if i == j else np.flatnonzero(~member), member):
                on = at[member & (100 * shared >= least * (size[k] + size - shared))]
                trees.join(np.stack([on, np.full(len(on), at[k])], axis=1))
            if len(tree := trees.edges()):
                yield _pairs(names, tree)

    small_batches(docs.sparkSession, 2 * FAMILY)
    dealt = rows.join(sets, "key").select("home", "i", "j", "id", "member", "data").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    found, _ = materialise(dealt.mapInArrow(lean(run), "a long, b long"), "similar")
    small_batches(docs.sparkSession)
    delete(docs.sparkSession, cast, kept)
    return found


def _shared(x: dict, ask: np.ndarray, among: np.ndarray):
    """Yields each of ``ask`` and how many values its set shares with each set; zero for those that aren't ``among``."""
    mine = among[x["owner"]]
    pool, who = x["values"][mine], x["owner"][mine]
    order = np.argsort(pool, kind="stable")
    pool, who = pool[order], who[order]
    start = np.r_[0, np.cumsum(x["sizes"])]
    for k in ask:
        v = x["values"][start[k] : start[k + 1]]
        lo, hi = np.searchsorted(pool, v), np.searchsorted(pool, v, side="right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
        yield k, np.bincount(who[at], minlength=len(among))


def _families(batches):
    """Rows of one (home, i, j) after the other: id, member, and all sets one after the other, with their sizes and whose each value is."""

    def done(at, parts):
        x = {c: np.concatenate([p[c] for p in parts]) for c in ("id", "member", "sizes")}
        values = np.frombuffer(b"".join([d for p in parts for d in p["data"]]), np.uint64)
        return at, x | {"values": values, "owner": np.repeat(np.arange(len(x["id"])), x["sizes"])}

    at, held = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("home", "i", "j")], axis=1)
        if not len(key):
            continue
        cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
        ids, member, data = batch.column("id").to_numpy(), batch.column("member").to_numpy(zero_copy_only=False), batch.column("data").to_pylist()
        size = np.array([len(d) // 8 for d in data], np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if at != (here := tuple(key[lo].tolist())):
                if held:
                    yield done(at, held)
                at, held = here, []
            held.append({"id": ids[lo:hi], "member": member[lo:hi], "sizes": size[lo:hi], "data": data[lo:hi]})
    if held:
        yield done(at, held)


def drop_similar(docs: DataFrame, least: int = 80, width: int = 5) -> DataFrame:
    """One document of each component stays, as in ``drop_near_copies``; links are Jaccard similarities of at least ``least`` hundredths.

    Similarities are those of the sets of lower-cased shingles of ``width`` words and are verified exactly. Candidates come from the
    trie self-join of TRIES independent fingerprints of the sets: at a similarity of exactly 0.8 a bit differs with a
    chance of 0.15, and a pair is no candidate with one of about 0.02; the README has measured figures. Texts of one
    set are one node. STARS tries are joined first, in which what hangs together is held against one node; what hung together in any of
    them is a family. Then all tries are, and every node that is near a component it is not in is held against all of that component's
    members; in a family with very many such nodes, all are held against each other. Texts without words are one set. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    marked, _ = materialise(_with_prints(_marked(docs), width), "prints")
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__tid")).alias("least")
    nodes, _ = materialise(marked.groupBy("key").agg(who, F.first("prints").alias("prints")), "nodes")
    one = F.lit(1).cast("long")
    labelled, edges, met = nodes.withColumns({"label": F.col("key"), "size": one}), None, None

    def grouped(rows: DataFrame, of: DataFrame, name: str, size: str) -> DataFrame:
        """``rows`` with the component of each key and its nodes."""
        sizes = of.groupBy("component").agg(F.count("*").alias(size))
        of = of.join(sizes, "component").select(F.col("node").alias("key"), F.col("component").alias(name), size)
        return rows.join(of, "key", "left").withColumns({name: F.coalesce(name, "key"), size: F.coalesce(F.col(size), one)})

    for turn in range(STARS + 1):
        small_batches(spark, 20_000)  # numbers only
        found = _candidates(labelled, [turn] if turn < STARS else range(TRIES), turn < STARS)
        found, path = materialise(found, "candidates")
        small_batches(spark)
        if turn < STARS:
            ends = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            sets, kept = materialise(_sets(docs, nodes.join(ends, "key", "left_semi").select("least", "key"), width), "sets")
            links, _ = materialise(_alike(found, sets, least), "alike")
            delete(spark, kept)
            met = met.unionByName(found) if met else found
        else:
            dense = found.filter("a = b").select("family")
            near = found.filter("a <> b").join(F.broadcast(dense) if dense.count() <= BROADCAST_ROWS else dense, "family", "left_anti")
            links = _near_members(near.select("a", "b"), labelled, docs, least, width)
            if not dense.isEmpty():
                links = links.unionByName(_within(dense, labelled, docs, least, width))
            delete(spark, path)
        edges = edges.unionByName(links) if edges else links
        comp = components(edges)
        if turn < STARS:
            labelled = grouped(nodes, comp, "label", "size")
            if turn == STARS - 1:
                labelled = grouped(labelled, components(met), "family", "many")
            labelled, _ = materialise(labelled, "labelled")
    return _keep_least(docs, marked.select("doc_id", "__tid", "key"), comp)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda: cluster(with_fingerprint(table(spark, sf_dir, "documents"))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return settled(spark, out, "clusters")
