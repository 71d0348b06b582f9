"""Near-duplicate vectors by E8 lattice hashing.

A table projects unit vectors on 16 random orthonormal directions and decodes each half to its nearest point of the
E8 lattice; the two points name the vector's home cell. A vector is compared with the vectors at home in its own cell
and in the PROBES neighbouring cells whose walls are nearest. Every comparison is an exact cosine in double precision.

Vectors don't travel with their cells: a narrow row per vector and cell carries a signature of 64 signs, and only rows
that have a partner with a near signature in their cell fetch the vector.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, materialise, settled, small_batches, table
from .simhash import forest

TABLES = 6
PROBES = 3
#: Cell size for projections whose coordinates have a standard deviation of 1; measured recall is in the README.
SCALE = 2.4
THRESHOLD = 0.95
#: Vectors of a cell that one task compares with as many others; fuller cells are cut into pairs of blocks.
BLOCK = 2048
#: Standard deviations by which the signatures of a pair at the threshold may differ in more bits than on average.
SLACK = 5.5
#: Cells up to which their sizes are broadcast, 40 bytes each.
BROADCAST_CELLS = 1_000_000
#: Tables and lengths of vectors share a number: the length in the bits above these.
_TABLE = 6


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the directions to a cell's neighbours."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the nearest points of D8 and of D8 moved by halves."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        gap = y[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=64)
def directions(size: int, t: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([size, t]).normal(size=(size, 16)))[0]


def cells(unit: np.ndarray, t: int, probes: int = PROBES) -> np.ndarray:
    """Codes of each unit vector's home cell and of its ``probes`` nearest neighbours in table ``t``: (n, 1 + probes)."""
    n, dim = unit.shape
    size = max(16, -(-dim // 16) * 16)
    y = (unit @ directions(size, t)[:dim]) * (np.sqrt(size) / SCALE)
    points, walls = [], []
    for half in (y[:, :8], y[:, 8:]):
        c = decode_e8(half)
        points.append(c)
        walls.append(1.0 - (half - c) @ roots().T)  # in proportion to the distance of the wall towards each neighbour
    move = np.concatenate(walls, axis=1)
    near = np.argsort(move, axis=1, kind="stable")[:, :probes] if probes else np.zeros((n, 0), int)
    at = np.repeat(np.concatenate(points, axis=1)[:, None], 1 + probes, axis=1)
    for k in range(probes):
        which, root = near[:, k] // 240, roots()[near[:, k] % 240]
        for half in (0, 1):
            on = which == half
            at[on, k + 1, 8 * half : 8 * half + 8] += root[on]
    mixer = np.random.default_rng([dim, t, 1]).integers(1, 2**63, 17, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        code = ((at * 2).astype(np.int64).astype(np.uint64) * mixer[:16]).sum(axis=2, dtype=np.uint64) + mixer[16]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (code ^ (code >> np.uint64(32))).view(np.int64)


def units(column) -> np.ndarray:
    """Unit vectors in double precision of an Arrow list column whose lists are as long as each other."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(unit: np.ndarray) -> np.ndarray:
    """64 signs of random projections of each unit vector; two signs differ with a chance of angle / pi."""
    planes = np.random.default_rng([unit.shape[1], 64]).normal(size=(unit.shape[1], 64))
    return np.packbits(unit @ planes > 0, axis=1, bitorder="little").view("<i8").ravel()


def most_signs(threshold: float) -> int:
    """Bits in which signatures of vectors at the threshold differ, SLACK deviations above the average."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(64 * p + SLACK * np.sqrt(64 * p * (1 - p))) + 1


def _hash(tables: int, probes: int):
    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                unit, n = units(part.column(1)), part.num_rows
                sign = pa.array(signatures(unit))
                for t in range(tables):
                    code, place = cells(unit, t, probes), pa.array(np.full(n, (int(dim) << _TABLE) + t))
                    for k in range(code.shape[1]):
                        yield pa.RecordBatch.from_arrays([place, pa.array(np.ascontiguousarray(code[:, k])), pa.array(np.full(n, k == 0)), part.column(0), sign], ["t", "cell", "home", "uid", "sign"])

    return run


def near_signs(x: dict, most: int) -> np.ndarray:
    """Which rows, of whole cells one after the other, have a partner in their cell with a near signature; one of both is at home."""
    cut = np.flatnonzero(np.r_[True, (x["cell"][1:] != x["cell"][:-1]) | (x["t"][1:] != x["t"][:-1])])
    after = np.repeat(np.r_[cut[1:], len(x["cell"])], np.diff(np.r_[cut, len(x["cell"])])) - np.arange(len(x["cell"]))  # rows to the end of the cell
    alive, sign, home, uid, k = np.zeros(len(after), bool), x["sign"].view(np.uint64), x["home"], x["uid"], 1
    i = np.flatnonzero(after > 1)
    while len(i):
        near = (home[i] | home[i + k]) & (uid[i] != uid[i + k]) & (np.bitwise_count(sign[i] ^ sign[i + k]) <= most)
        alive[i[near]] = alive[i[near] + k] = True
        k += 1
        i = i[after[i] > k]
    return alive


def _prune(most: int):
    """Rows that have a partner, by ``near_signs``; those of cells with more than BLOCK rows all, as many, without being held."""

    def out(x, alive, many):
        if alive.any():
            yield pa.RecordBatch.from_arrays([*[pa.array(x[c][alive]) for c in ("t", "cell", "home", "uid")], pa.array(np.full(int(alive.sum()), many))], ["t", "cell", "home", "uid", "many"])

    def run(batches):
        names, held, large = ["t", "cell", "home", "uid", "sign"], None, None
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if large is not None:
                go = int(np.argmin(np.r_[(x["t"] == large[0]) & (x["cell"] == large[1]), False]))
                yield from out({c: v[:go] for c, v in x.items()}, np.ones(go, bool), True)
                if go == len(x["t"]):
                    continue
                x, large = {c: v[go:] for c, v in x.items()}, None
            x = {c: np.concatenate([held[c], x[c]]) for c in names} if held else x
            if not len(x["t"]):
                continue
            cut = np.flatnonzero(np.r_[True, (x["cell"][1:] != x["cell"][:-1]) | (x["t"][1:] != x["t"][:-1])])
            last = int(cut[-1])
            size = np.diff(np.r_[cut, len(x["t"])])
            whole = np.repeat(size > BLOCK, size)
            if len(x["t"]) - last > BLOCK:
                large, last = (x["t"][last], x["cell"][last]), len(x["t"])
            done = {c: v[:last] for c, v in x.items()}
            yield from out(done, whole[:last], True)
            few = {c: v[~whole[:last]] for c, v in done.items()}
            yield from out(few, near_signs(few, most), False)
            held = {c: v[last:] for c, v in x.items()} if last < len(x["t"]) else None
        if held:
            yield from out(held, near_signs(held, most), False)

    return run


class Codes:
    """Cell codes of the vectors that link, each worked out once in a task."""

    def __init__(self, tables: int, probes: int):
        self.tables, self.probes, self.known = tables, probes, {}

    def of(self, uid: np.ndarray, unit: np.ndarray) -> np.ndarray:
        new = [i for i, u in enumerate(uid.tolist()) if u not in self.known]
        if new:
            if len(self.known) > 50_000:
                self.known.clear()
                new = list(range(len(uid)))
            code = np.stack([cells(unit[new], t, self.probes) for t in range(self.tables)], axis=1)
            self.known.update(zip(uid[new].tolist(), code, strict=True))
        return np.stack([self.known[u] for u in uid.tolist()])


def _compare(rows: dict, t: int, codes: Codes, threshold: float):
    """Links of one cell, or of two blocks of it: (uid, weight of new links), and a forest of them."""
    unit, uid, weight, at_home = rows["unit"], rows["uid"], rows["weight"], rows["home"]
    home, query = np.flatnonzero(rows["target"]), np.flatnonzero(rows["query"])
    found, count = [], np.zeros(len(uid), np.int64)
    for lo in range(0, len(query), 1024):
        q = query[lo : lo + 1024]
        i, j = np.nonzero(unit[q] @ unit[home].T >= threshold)
        i, j = q[i], home[j]
        ok = (uid[i] != uid[j]) & (~at_home[i] | (uid[i] < uid[j]))  # two at home meet once
        i, j = i[ok], j[ok]
        if len(i):
            used, inverse = np.unique(np.r_[i, j], return_inverse=True)
            c = codes.of(uid[used], unit[used])
            for a in range(0, len(i), 1 << 16):
                x, y = c[inverse[: len(i)][a : a + (1 << 16)]], c[inverse[len(i) :][a : a + (1 << 16)]]
                met = np.zeros((len(x), 2), bool)  # in an earlier table; in this one by the other's probe
                for s in range(t + 1):
                    there = (x[:, s, 1:] == y[:, s, :1]).any(axis=1)
                    back = (y[:, s, 1:] == x[:, s, :1]).any(axis=1)
                    if s < t:
                        met[:, 0] |= there | back | (x[:, s, 0] == y[:, s, 0])
                    else:
                        met[:, 1] = there & back
                k, m = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                new = ~met[:, 0] & ~(met[:, 1] & (uid[k] > uid[m]))
                k, m = k[new], m[new]
                np.add.at(count, k, weight[m])
                np.add.at(count, m, weight[k])
                found.append(np.stack([k, m], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return None
    names, inverse = np.unique(uid, return_inverse=True)  # a row may stand for both sides
    tree = forest(inverse[pairs], len(names))
    n = np.bincount(inverse, weights=count, minlength=len(names)).astype(np.int64)
    on = np.flatnonzero(n)
    return names[on], n[on], names[tree[:, 0]], names[tree[:, 1]]


def _search(tables: int, probes: int, threshold: float):
    names = ["uid", "weight", "home", "target", "query"]

    def run(batches):
        codes, at, held = Codes(tables, probes), None, []

        def done():
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
            got = _compare(rows, at[0] & ((1 << _TABLE) - 1), codes, threshold) if rows["target"].any() and len(rows["uid"]) > 1 else None
            if got:
                uid, n, a, b = got
                none = lambda x: pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(n), none(uid)], ["uid", "n", "to"])
                yield pa.RecordBatch.from_arrays([pa.array(a), none(a), pa.array(b)], ["uid", "n", "to"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("t", "cell", "i", "j")], axis=1)
            if not len(key):
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            dims = np.flatnonzero(np.r_[True, key[1:, 0] >> _TABLE != key[:-1, 0] >> _TABLE, True])  # vectors of one length
            unit = [units(batch.column("v").slice(a, b - a)) for a, b in zip(dims[:-1], dims[1:], strict=True)]
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here, d = tuple(key[lo].tolist()), int(np.searchsorted(dims, lo, side="right")) - 1
                if here != at:
                    if held:
                        yield from done()
                    at, held = here, []
                held.append({c: v[lo:hi] for c, v in x.items()} | {"unit": unit[d][lo - dims[d] : hi - dims[d]]})
        if held:
            yield from done()

    return run


def _numbered(same: DataFrame) -> tuple[DataFrame, int]:
    """``same`` (v, any more) with uid, a 64-bit hash of v under the least seed with which no two agree, and that seed, nearly always the first."""
    seed = 0
    while True:
        out = same.withColumn("uid", _number(seed, F.col("v")))
        if out.groupBy("uid").count().filter("count > 1").isEmpty():
            return out, seed
        seed += 1


def _number(seed: int, v) -> Column:
    return F.xxhash64(F.lit(seed), v)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per row of ``vectors`` (vec_id, embedding; other columns ignored).

    Links join vectors of one length whose cosine is at least ``threshold`` and that share a cell by home or probe in any
    table; each pair counts once, in its first such table, and is never written out. Equal vectors
    are one vector of that weight, and link with each other. Null, zero and empty vectors, and those with null or
    non-finite components, link with nothing and are their own components. A null vec_id names no component:
    one of nulls only is null, and its rows have kept null. Cells with more than BLOCK vectors are cut into pairs
    of blocks, so that a common vector's neighbourhood is shared out. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding")).alias("v"))
    same = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    same, seed = _numbered(materialise(same, "vectors")[0])
    rows = rows.withColumn("uid", F.when(F.col("v").isNotNull(), _number(seed, F.col("v")))).drop("v")
    small_batches(spark, 20_000)  # narrow rows, and vectors of a few hundred bytes: bounded by bytes
    cell = same.select("uid", "v").mapInArrow(lean(_hash(tables, probes)), "t long, cell long, home boolean, uid long, sign long")
    dealt = cell.repartition("t", "cell").sortWithinPartitions("t", "cell")
    alive, _ = materialise(dealt.mapInArrow(lean(_prune(most_signs(threshold))), "t long, cell long, home boolean, uid long, many boolean"), "cells")
    full = alive.filter("many").groupBy("t", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    full = full.select("t", "cell", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("nq"), F.expr(f"cast(ceil(homes / {BLOCK}) as int)").alias("nh"))
    full, _ = materialise(full, "full")
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    dealt = alive.join(full, ["t", "cell"], "left")
    part = lambda n: F.pmod(F.xxhash64("uid", F.lit(1)), F.col(n)).cast("int")
    as_query = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), part("nq").alias("j"), F.lit(False).alias("target"), F.lit(True).alias("query")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda j: F.struct(part("nh").alias("i"), j.alias("j"), F.lit(True).alias("target"), F.lit(False).alias("query")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("target"), F.lit(True).alias("query")))
    roles = F.when(F.col("nq").isNull(), both).when(F.col("nh") == 0, F.slice(both, 1, 0)).when(F.col("home"), F.concat(as_query, as_home)).otherwise(as_query)
    dealt = dealt.withColumn("r", F.explode(roles)).select("t", "cell", "r.i", "r.j", "r.target", "r.query", "home", "uid")
    dealt = dealt.join(same.select("uid", "weight", "v"), "uid").repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j")
    found, _ = materialise(dealt.mapInArrow(lean(_search(tables, probes, threshold)), "uid long, n long, to long"), "links")
    small_batches(spark)
    counts = found.filter("n is not null").groupBy("uid").agg(F.sum("n").alias("n"))
    comp = components(found.filter("to is not null"), "uid", "to").select(F.col("node").alias("uid"), "component")
    named = same.select("uid", "weight", "least").join(comp, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(counts, "uid", "left").select("uid", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("uid is not null").select("vec_id", "uid").join(named, "uid").select("vec_id", "n_links", "component_id")
    alone = rows.filter("uid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: link_vectors(table(spark, sf_dir, "embeddings")), "linked")


OP1_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
), pairs as (
  select a.vec_id as a, b.vec_id as b from v a, v b
  where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select vec_id as a, vec_id as b from v
  union
  select r.a, p.b from reach r join pairs p on p.a = r.b
), comp as (select a as vec_id, min(b) as component_id from reach group by a)
select c.vec_id, (select count(*) from pairs p where p.a = c.vec_id) as n_links, c.component_id, c.vec_id = c.component_id as kept
from comp c
"""
