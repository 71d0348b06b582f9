"""Repeated passages by suffix sorting with a difference cover, distributed.

Equal WIDTH-byte strings have equal minimizers (the least hash of their SEED-byte parts), so runs of strings are
dealt out by minimizer and every group of equal strings meets in one place, with all its suffixes. There the difference
cover algorithm sorts them: names for the triples at two positions of three, recursion on the names, the third
positions by their first symbol and the rank after it, a merge, and a comparison of neighbours' first WIDTH bytes.
Symbols of the recursion cover 3, 9, 27, 81 bytes, so it ends once names tell WIDTH bytes apart.

Two rounds of pre-aggregation keep the exchange small. A string of WIDTH bytes holds its minimizer's SEED bytes and
either the LEFT bytes before or the RIGHT bytes after, so first only 64-bit hashes of those contexts travel, a
chunk's distinct ones once each, to find those that at least two documents hold. Then the strings around these go,
again once a chunk, with the smallest and largest doc_id they occur in, and answers come back to the chunk. So a passage
that any share of documents holds sends an entry a chunk, not an entry a document, and what a task holds at once is
a chunk, or a bucket of what all chunks send. Runs are only taken for one after their bytes have been compared, and
every run that two documents have, or that shares its minimizer, goes through the suffix order: hashes bring strings
together but decide nothing. Whole copies of a text are told by SHA-256 and length before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U, buffer, eights, load8, xxh64
from .common import delete, lean, materialise, reclaim, settled, table

WIDTH = 50
SEED = 16
LEFT = (WIDTH - SEED) // 2
RIGHT = WIDTH - SEED - LEFT + 1
#: Text that one map task aggregates before it sends, and that is hashed at once; text sorted at once.
CHUNK, PIECE, SORTED = 16 << 20, 256 << 10, 256 << 10
#: Size up to which a table is broadcast to texts, in bytes as packed; beyond, texts are shuffled to it.
BROADCAST = 48 << 20
#: Text for which there is a bucket, and a task that sorts it, at least.
BUCKET = 32 << 20
#: Documents of a chunk; an entry has 16 bits for one.
DOCS = 60_000
#: A position in a piece, in the low bits of a minimizer's hash; texts longer than LONG are cut into overlapping parts.
_BITS = 24
_PLACE, LONG = (1 << _BITS) - 1, 8 << 20
_A, _B, _C = (U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# --- the difference cover algorithm ---------------------------------------------------------------------------------


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key)
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """One sortable number of several non-negative ones; those too large for 63 bits are named first."""
    out = parts[0]
    for x in parts[1:]:
        bits = int(x.max(initial=0)).bit_length()
        if int(out.max(initial=0)).bit_length() + bits > 63:
            out = _names(out)[0]
        out = (out << bits) | x
    return out


def suffix_order(s: np.ndarray, depth: int, unit: int = 1) -> np.ndarray:
    """Positions of ``s`` (positive numbers) so that suffixes equal in ``depth`` bytes are neighbours; a symbol is ``unit`` bytes.

    The order is that of the suffixes up to ``depth`` at least, ties beyond it any way.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.r_[s, 0, 0, 0]
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a stop between the two kinds, where the text's end makes none
    two = np.arange(2, n, 3)
    sample = np.r_[one, two]
    names, distinct = _names(_packed([t[sample], t[sample + 1], t[sample + 2]]))
    m = len(sample)
    if distinct == m or 3 * unit >= depth:
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_order(names, depth, 3 * unit)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, m + 1)
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_packed([t[zero], rank[zero + 1]]))]
    chosen = sample[order]
    chosen = chosen[chosen < n]
    ones, twos = one[one < n], two
    # how many samples stand before each of the third kind: one symbol and a rank decide, or two and a rank
    split = len(zero)
    k1 = _packed([np.r_[t[zero], t[ones]], np.r_[rank[zero + 1], rank[ones + 1]]])
    k2 = _packed([np.r_[t[zero], t[twos]], np.r_[t[zero + 1], t[twos + 1]], np.r_[rank[zero + 2], rank[twos + 2]]])
    before = np.searchsorted(np.sort(k1[split:]), k1[:split]) + np.searchsorted(np.sort(k2[split:]), k2[:split])
    at = np.maximum.accumulate(before) + np.arange(split)
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, chosen
    return out


def equal_windows(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group) of all windows: ``count`` of them from each ``start``; equal ones share a group, numbered upward."""
    n = int(start[-1] + count[-1] + WIDTH - 1) if len(start) else 0
    order = suffix_order(text[:n].astype(np.int64) + 1, WIDTH)
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, start, 1)
    np.add.at(valid, start + count, -1)
    order = order[np.cumsum(valid)[:-1][order] > 0]
    win = eights(np.r_[text, np.zeros(8, np.uint8)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    live = np.arange(1, len(order))
    for k in (0, 8, 16, 24, 32, 40, WIDTH - 8):
        differ = load8(win, order[live] + k) != load8(win, order[live - 1] + k)
        new[live[differ]] = True
        live = live[~differ]
    return order, np.cumsum(new) - 1


# --- runs of strings by minimizer -----------------------------------------------------------------------------------


class Runs:
    """The runs of WIDTH-byte strings that share one minimizer, the leftmost of equal ones; none crosses texts.

    first, count: its strings; at: where the minimizer stands; m: the minimizer's hash, mixed; doc: the text.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf) - WIDTH + 1
        if n <= 0:
            self.first = self.count = self.at = self.doc = np.zeros(0, np.int64)
            self.m = np.zeros(0, np.uint64)
            return
        if len(buf) > _PLACE:
            raise ValueError("pieces must be shorter")
        buf = np.ascontiguousarray(buf)
        words = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,)).copy()
        with np.errstate(over="ignore"):
            h = words * _A
            h ^= h >> U(32)
            low = h[:-8] * _B
            low += h[8:]
            low ^= low >> U(29)
            low *= _C
            low ^= low >> U(32)
        placed = (low & ~U(_PLACE)) | np.arange(len(low), dtype=np.uint64)
        reach = WIDTH - SEED + 1
        m, k = placed, 1
        while 2 * k <= reach:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        m = np.minimum(m[:n], m[reach - k : reach - k + n]) if reach > k else m[:n]
        begins = np.zeros(n, bool)
        begins[0] = True
        np.not_equal(m[1:], m[:-1], out=begins[1:])
        begins[off[(off > 0) & (off < n)]] = True
        dead = np.maximum(off[1:] - WIDTH + 1, off[:-1])
        begins[dead[(dead < n) & (dead >= 0)]] = True
        first = np.flatnonzero(begins)
        count = np.diff(np.r_[first, n])
        doc = np.searchsorted(off, first, side="right") - 1
        live = first + WIDTH <= off[doc + 1]
        first, count, doc = first[live], count[live], doc[live]
        self.first, self.count, self.doc, self.words = first, count, doc, words
        self.at = (m[first] & U(_PLACE)).astype(np.int64)
        self.m = _mixed(low[self.at])

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the bytes to the left of and to the right of each minimizer, it included, and which runs have strings that hold them."""
        q, last = self.at, self.first + self.count - 1
        has_left = self.first <= q - LEFT
        has_right = last > q - LEFT
        left, right = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for out, on, begin, size, salt in ((left, has_left, q - LEFT, LEFT + SEED, U(1)), (right, has_right, q, SEED + RIGHT - 1, U(2))):
            at, h = begin[on], np.full(int(on.sum()), salt, np.uint64)
            for k in [*range(0, size - 8, 8), size - 8]:
                h = _mixed(h ^ self.words[at + k])
            out[on] = h
        return left, right, has_left, has_right

    def cut(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Keeps the strings on the sides that are wanted; which runs are left."""
        edge = self.at - LEFT + 1  # strings from here on hold the right context, those before the left
        end = self.first + self.count
        begin = np.where(left, self.first, np.maximum(self.first, edge))
        end = np.where(right, end, np.minimum(end, edge))
        self.first, self.count = begin, end - begin
        return (self.count > 0) & (left | right)


def _mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v * _B
        v ^= v >> U(31)
        v *= _A
    return v ^ (v >> U(28))


def _pieces(off: np.ndarray):
    """(first text, last text, first byte, end byte): about PIECE bytes; a text longer than LONG comes in parts that overlap by a string less a byte."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1)
        a, b = int(off[lo]), int(off[hi])
        while b - a > LONG:
            yield lo, hi, a, a + LONG
            a += LONG - WIDTH + 1
        yield lo, hi, a, b
        lo = hi


def _runs_of(buf: np.ndarray, off: np.ndarray):
    """(first text, first byte, bytes, Runs) of each piece."""
    for lo, hi, a, b in _pieces(off):
        bounds = np.clip(off[lo : hi + 1], a, b) - a
        yield lo, a, buf[a:b], Runs(buf[a:b], bounds)


def _by_bucket(m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (m & U(0xFFFF)).astype(np.int64) * n >> 16
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _kinds(m: np.ndarray, key: np.ndarray, base: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of runs by minimizer and hash, and where in it another run begins; those of one hash are compared byte by byte."""
    order = np.lexsort((key, m))
    a, b = order[:-1], order[1:]
    same = (m[a] == m[b]) & (key[a] == key[b]) & (size[a] == size[b])
    alike = np.flatnonzero(same)
    ends = np.cumsum(size[a[alike]])
    lo = 0
    while lo < len(alike):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORTED, side="right")))
        i = alike[lo:hi]
        n = size[a[i]]
        start = np.r_[0, np.cumsum(n)[:-1]]
        k = np.arange(n.sum()) - np.repeat(start, n)
        same[i] = ~np.logical_or.reduceat(text[k + np.repeat(base[a[i]], n)] != text[k + np.repeat(base[b[i]], n)], start)
        lo = hi
    return order, np.r_[True, ~same]


def _grouped(batches, keys: int):
    """(key, rows) of sorted rows, over batches; a row is the columns after the first ``keys``."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


# --- first round: contexts that several documents share -------------------------------------------------------------

#: Entries for a bucket (kind 0), or answers for a group of documents (kind 1).
_SEND = "kind int, place int, data binary, rids binary"
_LIST = "rid long, data binary"


def _short(h: np.ndarray) -> np.ndarray:
    """A context's short form; a chance match of two only costs work."""
    return ((h >> U(16)) & U(0xFFFF)).astype(np.uint16)


def _answers(rid: np.ndarray, h: np.ndarray, groups: int):
    """Packed by group of documents: the documents, and the short forms of contexts that they share with others."""
    if len(rid):
        order, cut = _by_bucket(_mixed(rid.view(np.uint64)), groups)
        short = _short(h)
        parts = [(g, order[cut[g] : cut[g + 1]]) for g in range(groups) if cut[g + 1] > cut[g]]
        yield _record(_SEND, [(1, g, short[i].tobytes(), rid[i].tobytes()) for g, i in parts])


def _slices(batches, rows: int = 2000):
    """The same rows in batches of bounded length, whatever the session's setting."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _send_contexts(buckets: int):
    """A chunk's distinct contexts, an entry each: 48 bits and the document that has it, or that several have."""

    def flush(entries, rids):
        rid, e = np.concatenate(rids), np.concatenate(entries)
        entries.clear()
        e.sort()
        if not len(e):
            return
        e = e[np.r_[True, e[1:] != e[:-1]]]
        h, doc = e & ~U(0xFFFF), (e & U(0xFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.diff(np.r_[new, len(h)])
        several = np.repeat(many > 1, many)
        entry = h[new] | np.where(many > 1, 0xFFFF, doc[new]).astype(np.uint64)
        known, shared = rid[doc[several]], h[several]
        del e, h, doc, several, new, many
        # documents that share within the chunk know it at once
        yield from _answers(known, shared, buckets)
        del known, shared
        cut = np.searchsorted(entry, np.array([b * (1 << 64) // buckets for b in range(buckets)], np.uint64))
        rows, size = [], 0
        for b, part in enumerate(np.split(entry, cut[1:])):
            if len(part):
                d = (part & U(0xFFFF)).astype(np.int64)
                one = d != 0xFFFF
                used, d[one] = np.unique(d[one], return_inverse=True)
                rows.append((0, b, ((part & ~U(0xFFFF)) | d.astype(np.uint64)).tobytes(), rid[used].tobytes()))
                size += part.nbytes
            if rows and (b == buckets - 1 or size > 4 << 20):
                yield _record(_SEND, rows)
                rows, size = [], 0

    def run(batches):
        entries, rids, size, n = [], [], 0, 0
        for batch in _slices(batches):
            if n + batch.num_rows > DOCS:
                yield from flush(entries, rids)
                entries, rids, size, n = [], [], 0, 0
            buf, off = buffer(batch.column(1))
            rids.append(batch.column(0).to_numpy())
            for lo, _, _, r in _runs_of(buf, off):
                left, right, has_left, has_right = r.contexts()
                doc = (r.doc + lo + n).astype(np.uint64)
                entries += [(left[has_left] & ~U(0xFFFF)) | doc[has_left], (right[has_right] & ~U(0xFFFF)) | doc[has_right]]
            n, size = n + batch.num_rows, size + len(buf)
            if size > CHUNK:
                yield from flush(entries, rids)
                entries, rids, size, n = [], [], 0, 0
        if entries:
            yield from flush(entries, rids)

    return run


def _find_shared(groups: int):
    """Answers from entries: contexts with more than one entry in a bucket are shared by documents of several chunks."""

    def run(batches):
        for (kind, place), rows in _grouped(batches, 2):
            if kind:
                yield _record(_SEND, [(kind, place, *row) for row in rows])
                continue
            entry = [np.frombuffer(d, np.uint64) for d, _ in rows]
            e, ids = np.concatenate(entry), np.concatenate([np.frombuffer(r, np.int64) for _, r in rows])
            base = np.repeat(np.r_[0, np.cumsum([len(r) // 8 for _, r in rows])[:-1]], [*map(len, entry)])
            order = np.argsort(e & ~U(0xFFFF), kind="stable")
            e, base = e[order], base[order]
            h, d = e & ~U(0xFFFF), (e & U(0xFFFF)).astype(np.int64)
            many = np.diff(np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]))
            tell = (np.repeat(many, many) > 1) & (d != 0xFFFF)
            yield from _answers(ids[base[tell] + d[tell]], h[tell], groups)

    return run


def _lists(batches):
    """A row per document with the short forms of the contexts it shares, each once."""
    for _, rows in _grouped(batches, 1):
        rid = np.concatenate([np.frombuffer(r, np.int64) for _, r in rows])
        short = np.concatenate([np.frombuffer(d, np.uint16) for d, _ in rows])
        order = np.lexsort((short, rid))
        rid, short = rid[order], short[order]
        one = np.r_[True, (rid[1:] != rid[:-1]) | (short[1:] != short[:-1])]
        rid, short = rid[one], short[one]
        cut = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
        off = (np.r_[cut, len(rid)] * 2).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(short.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(rid[cut]), data], ["rid", "data"])


def _fit(df: DataFrame, packed: str) -> DataFrame:
    """``df`` marked for broadcast if the column ``packed`` and 16 bytes a row are within BROADCAST."""
    size = df.agg(F.sum(F.octet_length(packed) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST else df


# --- second round: the runs around shared contexts ------------------------------------------------------------------

#: Of a chunk and bucket (kind 0): its distinct runs, each with smallest and largest doc_id, and who has them where.
#: Of a chunk (kind 1): its documents, as rid and doc_id. To a chunk and bucket (kind 2): what goes, by run.
_ROWS = "chunk long, bucket int, kind int, runs binary, text binary, who binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, behind that length."""
    return b"".join([len(arrays[0]).to_bytes(8, "little"), *(x.tobytes() for x in arrays)])


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_RUN = (np.uint64, np.uint64, np.int64, np.int64, np.uint8)  # minimizer, hash of the bytes, smallest and largest doc_id, strings
_WHO = (np.uint32, np.uint32, np.uint32)  # run, document, offset
_GO = (np.uint32, np.uint8, np.uint8, np.int64)  # run, first and last-exclusive string, smallest doc_id that has them


def _send_strings(buckets: int):
    def flush(chunk, held, rids, docs):
        import zstandard

        m, key, doc, at, count = (np.concatenate([h[i] for h in held]) for i in range(5))
        size = count + WIDTH - 1
        text, base = np.concatenate([h[5] for h in held]), np.r_[0, np.cumsum(size)]
        ids = np.concatenate(docs)
        order, first = _kinds(m, key, base, size, text)
        new = np.flatnonzero(first)
        low, high = np.minimum.reduceat(ids[doc[order]], new), np.maximum.reduceat(ids[doc[order]], new)
        one, ends = order[new], np.r_[new, len(order)]
        squeeze = zstandard.ZstdCompressor(level=1)
        yield _record(_ROWS, [(chunk, -1, 1, None, None, _pack(np.concatenate(rids), ids))])
        into, cut = _by_bucket(m[one], buckets)
        for b in range(buckets):
            i = np.sort(into[cut[b] : cut[b + 1]])
            if len(i):
                k, n = one[i], size[one[i]]
                take = np.arange(n.sum()) + np.repeat(base[k] - np.r_[0, np.cumsum(n)[:-1]], n)
                many = ends[i + 1] - ends[i]
                who = order[np.arange(many.sum()) + np.repeat(ends[i] - np.r_[0, np.cumsum(many)[:-1]], many)]
                runs = _pack(m[k], key[k], low[i], high[i], count[k].astype(np.uint8))
                owners = _pack(np.repeat(np.arange(len(i)), many).astype(np.uint32), doc[who].astype(np.uint32), at[who].astype(np.uint32))
                yield _record(_ROWS, [(chunk, b, 0, runs, squeeze.compress(text[take].tobytes()), owners)])

    def run(batches):
        from pyspark import TaskContext

        chunk, held, rids, docs, total, n = TaskContext.get().partitionId() << 32, [], [], [], 0, 0
        for batch in _slices(batches):
            buf, off = buffer(batch.column(2))
            listed, cuts = buffer(batch.column(3))
            have = (np.repeat(np.arange(batch.num_rows), np.diff(cuts) // 2).astype(np.uint64) << U(16)) | np.frombuffer(listed.tobytes(), np.uint16).astype(np.uint64)
            have = np.r_[np.sort(have), ~U(0)]
            for lo, a, part, r in _runs_of(buf, off):
                left, right, has_left, has_right = r.contexts()
                row = (r.doc + lo).astype(np.uint64) << U(16)
                listed_at = lambda h, row=row: have[np.searchsorted(have, row | _short(h))] == (row | _short(h))
                on = r.cut(has_left & listed_at(left), has_right & listed_at(right))
                first, count, row = r.first[on], r.count[on], r.doc[on] + lo
                if len(first):
                    size = count + WIDTH - 1
                    take = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
                    held.append((r.m[on], xxh64(part, first, size, 7), row + n, first + a - off[row], count, part[take]))
                    total += int(size.sum())
            rids.append(batch.column(0).to_numpy())
            docs.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if total > CHUNK // 2:
                yield from flush(chunk, held, rids, docs)
                chunk, held, rids, docs, total, n = chunk + 1, [], [], [], 0, 0
        if held:
            yield from flush(chunk, held, rids, docs)

    return run


def _sort_strings(batches):
    """Answers to each chunk: which strings of its runs also begin in a smaller doc_id than its largest that has them."""
    import zstandard

    for (bucket,), rows in _grouped(batches, 1):
        parts = [_unpack(r, *_RUN) for _, r, _ in rows]
        m, key, low, high, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
        text = np.frombuffer(b"".join([zstandard.ZstdDecompressor().decompress(t) for _, _, t in rows]), np.uint8)
        count = count.astype(np.int64)
        base = np.r_[0, np.cumsum(count + WIDTH - 1)]
        order, first = _kinds(m, key, base, count + WIDTH - 1, text)
        new = np.flatnonzero(first)
        kind = np.empty(len(m), np.int64)
        kind[order] = np.cumsum(first) - 1
        one = order[new]
        least = _least(m[one], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new), count[one], base[one], text)
        owner, begin, end, doc = least
        cut = np.searchsorted(owner, np.arange(len(one) + 1))
        at = 0
        for (chunk, _, _), p in zip(rows, parts, strict=True):
            k = kind[at : at + len(p[0])]
            at += len(k)
            many = cut[k + 1] - cut[k]
            i = np.arange(many.sum()) + np.repeat(cut[k] - np.r_[0, np.cumsum(many)[:-1]], many)
            mine = np.repeat(np.arange(len(k)), many)
            on = doc[i] < p[3][mine]
            i, mine = i[on], mine[on]
            if len(i):
                go = _pack(mine.astype(np.uint32), begin[i].astype(np.uint8), end[i].astype(np.uint8), doc[i])
                yield _record(_ROWS, [(chunk, bucket, 2, None, None, go)])


def _least(m, low, high, count, base, text):
    """(run, first string, last-exclusive string, smallest doc_id) of stretches that some larger doc_id has too; runs sorted by m.

    Runs of one minimizer are sorted together, about SORTED bytes at a time. Only a run of one document that is alone
    with its minimizer is left out: a chance match of short forms brought it here.
    """
    group = np.r_[np.flatnonzero(np.r_[True, m[1:] != m[:-1]]), len(m)]
    alone = np.repeat(np.diff(group) == 1, np.diff(group))
    out = [np.zeros((4, 0), np.int64)]
    left = np.flatnonzero(~alone | (low < high))
    size = count[left] + WIDTH - 1
    ends = np.cumsum(size)
    starts = np.flatnonzero(np.r_[True, m[left][1:] != m[left][:-1]]) if len(left) else left
    lo = 0
    while lo < len(left):
        reach = np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SORTED)
        hi = int(np.searchsorted(starts, max(lo + 1, reach)))
        hi = int(starts[hi]) if hi < len(starts) else len(left)
        i, n = left[lo:hi], size[lo:hi]
        start = np.r_[0, np.cumsum(n)[:-1]]
        part = text[np.arange(n.sum()) + np.repeat(base[i] - start, n)]
        where, equal = equal_windows(part, start, count[i])
        run = np.searchsorted(start, where, side="right") - 1
        first = np.flatnonzero(np.r_[True, equal[1:] != equal[:-1]])
        least = np.empty(len(part), np.int64)
        least[where] = np.minimum.reduceat(low[i][run], first)[equal]
        run = np.repeat(np.arange(len(i)), count[i])
        index = np.arange(len(run)) - np.repeat(np.r_[0, np.cumsum(count[i])[:-1]], count[i])  # string of its run
        value = least[start[run] + index]
        new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (value[1:] != value[:-1])])
        last = np.r_[new[1:], len(run)] - 1
        new, last = (x[value[new] < high[i][run[new]]] for x in (new, last))
        out.append(np.stack([i[run[new]], index[new], index[last] + 1, value[new]]))
        lo = hi
    run, begin, end, doc = np.concatenate(out, axis=1)
    order = np.lexsort((begin, run))
    return run[order], begin[order], end[order], doc[order]


def _spans(batches):
    """A row per document of a chunk that loses bytes: its runs of bytes that go, sorted and joined where they touch."""
    for _, rows in _grouped(batches, 1):
        who, go = {}, {}
        for bucket, kind, data in rows:
            if kind == 1:
                rid, ids = _unpack(data, np.int64, np.int64)
            else:
                (go if kind else who)[bucket] = data
        doc, lo, hi = [], [], []
        for bucket, data in go.items():
            run, begin, end, least = _unpack(data, *_GO)
            owner, d, at = _unpack(who[bucket], *_WHO)
            a, b = np.searchsorted(owner, run), np.searchsorted(owner, run, side="right")
            i = np.arange((b - a).sum()) + np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a)
            j = np.repeat(np.arange(len(run)), b - a)
            on = least[j] < ids[d[i]]
            i, j = i[on], j[on]
            doc.append(d[i].astype(np.int64))
            lo.append(at[i].astype(np.int64) + begin[j])
            hi.append(at[i].astype(np.int64) + end[j] - 1 + WIDTH)
        if not doc:
            continue
        doc, lo, hi = map(np.concatenate, (doc, lo, hi))
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order], hi[order]
        far = doc << 40  # offsets of different documents can't touch
        top = np.maximum.accumulate(far + hi)
        new = np.flatnonzero(np.r_[True, (far + lo)[1:] > top[:-1]])
        span = np.stack([lo[new], top[np.r_[new[1:], len(lo)] - 1] - far[new]], axis=1)
        cut = np.flatnonzero(np.r_[True, doc[new][1:] != doc[new][:-1]])
        off = (np.r_[cut, len(new)] * 16).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(span.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(rid[doc[new][cut]]), data], ["rid", "spans"])


def _whole(batches):
    for batch in batches:
        n = batch.column(1).to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array([0, x]).tobytes() for x in n], pa.binary())], ["rid", "spans"])


def _sha():
    return F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)


def _number(seed: int, sha):
    """A row's number: a 64-bit hash of doc_id and text, of which ``_seed`` makes sure that no two rows differ and agree."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), sha)


def _seed(keys: DataFrame) -> int:
    """The least seed with which different rows of ``keys`` (doc_id, doc, sha) have different numbers; nearly always the first."""
    seed = 0
    while True:
        rows = keys.select(_number(seed, F.col("sha")).alias("rid"), "doc", "sha")
        ends = rows.groupBy("rid").agg(*[f(c).alias(f"{c}{i}") for c in ("doc", "sha") for i, f in enumerate((F.min, F.max))])
        if ends.filter("doc0 <> doc1 or sha0 <> sha1").isEmpty():
            return seed
        seed += 1


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", _number(seed, _sha()).alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.encode(text, "UTF-8").alias("b"))


def copies(keys: DataFrame, seed: int) -> DataFrame:
    """(rid, n_bytes) of documents whose whole text a smaller doc_id has, by SHA-256 and length."""
    least = keys.groupBy("sha", "n_bytes").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = keys.join(least, ["sha", "n_bytes"]).filter("doc > least")
    return materialise(rows.select(_number(seed, F.col("sha")).alias("rid"), "n_bytes").distinct(), "copies")[0]


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rid, spans) and the seed of rid: per document that has any, its byte runs that strings of WIDTH bytes cover which also start in a smaller doc_id.

    spans is packed: pairs of 64-bit first and last-exclusive offsets, sorted and disjoint. A text that a smaller doc_id has
    as a whole goes as a whole, and takes no part in the search. Buckets follow the bytes where these ask for more than the
    session's shuffle partitions.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    keys, p0 = materialise(docs.select("doc_id", doc, _sha().alias("sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "keys")
    seed = _seed(keys)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (keys.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET)
    copied = copies(keys, seed)
    rows = _rows(docs.select("doc_id", "text"), seed).select("rid", "doc", "b")
    known = copied.select("rid")
    fresh = rows.select("rid", "b").join(F.broadcast(known) if known.count() * 16 <= BROADCAST else known, "rid", "left_anti")
    told = fresh.mapInArrow(lean(_send_contexts(n)), _SEND).repartition(n, "kind", "place").sortWithinPartitions("kind", "place").mapInArrow(lean(_find_shared(n)), _SEND)
    lists = told.select("place", "data", "rids").repartition(n, "place").sortWithinPartitions("place").mapInArrow(lean(_lists), _LIST)
    lists, p1 = materialise(lists, "shared")
    reclaim(spark)
    strings, p2 = materialise(rows.join(_fit(lists, "data"), "rid").select("rid", "doc", "b", "data").mapInArrow(lean(_send_strings(n)), _ROWS), "strings")
    reclaim(spark)
    sent = strings.filter("kind = 0").select("bucket", "chunk", "runs", "text").repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = sent.mapInArrow(lean(_sort_strings), _ROWS)
    back = strings.unionByName(answers).select("chunk", "bucket", "kind", "who").repartition(n, "chunk").sortWithinPartitions("chunk")
    spans = back.mapInArrow(lean(_spans), "rid long, spans binary")
    whole = copied.filter(F.col("n_bytes") >= WIDTH).mapInArrow(lean(_whole), "rid long, spans binary")
    spans, _ = materialise(spans.unionByName(whole).groupBy("rid").agg(F.first("spans").alias("spans")), "spans")  # rows that repeat agree
    delete(spark, p0, p1, p2)
    reclaim(spark)
    return spans, seed


def _apply(keep: int, text: bool):
    """Cuts the spans out of each text. With ``text``, runs shrink to whole characters and the rest is a string."""
    import hashlib

    def run(batches):
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(keep), batch.column(keep + 1), strict=True):
                b = raw.as_py()
                at = np.frombuffer(spans.as_py() or b"", np.int64).reshape(-1, 2).tolist()
                if text:
                    at = [(a, c) for a, c in ((_inward(b, a, 1), _inward(b, c, -1)) for a, c in at) if a < c]
                parts, last = [], 0
                for a, c in at:
                    parts.append(b[last:a])
                    last = c
                left = b"".join([*parts, b[last:]])
                out.append(left.decode() if text else (len(b), len(b) - len(left), len(at), hashlib.sha256(left).hexdigest(), left))
            if text:
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(out, pa.string())], [*batch.schema.names[:keep], "__kept"])
            elif out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *cols], [*batch.schema.names[:keep], *_NEW])

    return run


_NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]


def _inward(b: bytes, at: int, step: int) -> int:
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at += step
    return at


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes) per row of ``docs`` (doc_id, text; others ignored).

    A text is its UTF-8 bytes, null as none. Rows of one doc_id don't remove from each other; a null doc_id counts as
    larger than all others. Empty tables give no rows.
    """
    spans, seed = repeated_spans(docs)
    rows = _rows(docs.select("doc_id", "text"), seed).join(_fit(spans, "spans"), "rid", "left").select("doc_id", "b", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(lean(_apply(1, False)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeats cut from ``text``, whole characters at a time; null texts stay null, other columns as they are.

    Ids, nulls and empty tables are as in ``drop_repeats``; other columns may have any name.
    """
    from pyspark.sql import types as T

    spans, seed = repeated_spans(docs)
    spans = spans.select(F.col("rid").alias("_r"), "spans")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), _number(seed, _sha()).alias("_rid"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text"))  # so no column clashes
    rows = rows.join(_fit(spans, "spans"), F.expr("_rid = _r"), "left").select("row", "_text", "spans")
    done = rows.mapInArrow(lean(_apply(1, True)), T.StructType([rows.schema["row"], T.StructField("__kept", T.StringType())]))
    left = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("__kept"))
    return done.select(*[left.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda: drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return settled(spark, out, "cut")


OP7_SQL = f"""
with docs as (select doc_id, h, length(h) // 2 as n from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents)),
parts as (select doc_id, k, substr(h, 2 * k + 1, 2 * ({WIDTH} + 199)) as s, least(200, n - {WIDTH} + 1 - k) as c from (select *, unnest(range(0, n - {WIDTH} + 1, 200)) as k from docs)),
strings as (select doc_id, k + i as p, md5_number(substr(s, 2 * i + 1, 2 * {WIDTH})) as w from (select doc_id, k, s, unnest(range(0, c)) as i from parts)),
firsts as (select w, min(doc_id) as f from strings group by w having count(*) > 1),
hits as (select doc_id, p from strings join firsts using (w) where f < doc_id),
marked as (select *, case when p <= lag(p) over (partition by doc_id order by p) + {WIDTH} then 0 else 1 end as begins from hits),
runs as (select doc_id, min(p) as a, max(p) + {WIDTH} as b from (select *, sum(begins) over (partition by doc_id order by p) as g from marked) group by doc_id, g),
kept as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from runs),
cut as (
  select k.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as left_
  from kept k join docs d on d.doc_id = k.doc_id group by k.doc_id
)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_, h))) as kept_sha256
from docs d left join cut c on c.doc_id = d.doc_id
"""
