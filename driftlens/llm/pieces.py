"""SentencePiece models: sampled segmentations by forward filtering and backward sampling, and lossless decoding.

A text, with the dummy space before it, falls into runs that no piece of the model crosses; the lattice of a run is
filtered once for all its occurrences in a batch, and each occurrence samples backwards through it with uniforms
that depend on seed, row key and position alone: reruns, other batches and other clusters give the same pieces.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U, buffer, xxh64
from .common import lean, small_batches, table
from .tokens import TOKENIZERS

MODEL = "piece_bpe_32k.model"
#: Bytes of text whose lattices are worked on at once.
CHUNK = 2 << 20
#: Rows of a batch: enough for runs to repeat in it.
ROWS = 1200
_STOP = 255  # no UTF-8 text holds this byte


class Pieces:
    """A model's pieces as a byte trie in a hash table; ``▁`` stands as a space, so a ``▁`` of a text is spelt in bytes."""

    def __init__(self, path: str, weights: str = "zipf"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces, so it can't spell every text")
        self.byte_id = np.array([byte[b] for b in range(256)], np.int32)
        spelt = {i: sp.id_to_piece(i).replace("▁", " ").encode() for i in plain}
        if any(b" " in x.lstrip(b" ") for x in spelt.values()):
            raise ValueError("a piece spans words")
        self.bytes = [b""] * n
        for i, x in [*spelt.items(), *((i, bytes([b])) for b, i in byte.items())]:
            self.bytes[i] = x
        # BPE models have ranks in place of scores; Zipf's law makes weights of them
        first = min(plain)
        self.weight = np.array([-np.log(max(i - first, 0) + 2.0) if weights == "zipf" else sp.get_score(i) for i in range(n)])
        self.byte_weight = float(self.weight[plain].min()) - 1.0
        joint = {b for x in spelt.values() if len(x.decode()) > 1 for b in x}
        self.alone = np.array([b < 128 and b not in joint for b in range(256)])
        self.length = np.array([*map(len, self.bytes)], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)]
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._grow(spelt)

    def _grow(self, spelt: dict[int, bytes]) -> None:
        nodes, ends = {b"": 0}, [-1]
        keys = []
        for i, x in spelt.items():
            for k in range(1, len(x) + 1):
                if x[:k] not in nodes:
                    nodes[x[:k]] = len(nodes)
                    ends.append(-1)
                    keys.append((nodes[x[: k - 1]] << 8 | x[k - 1], nodes[x[:k]]))
            ends[nodes[x]] = i
        self.ends = np.array(ends, np.int32)
        key, to = np.array(keys, np.int64).T
        bits = int(len(key) * 4).bit_length()
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slots, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]], self.to[at[put]] = key[put], to[put]
            left = left[self.slots[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's next node, or -1."""
        key = node.astype(np.int64) << 8 | byte
        at, out = self._slot(key), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            seen = self.slots[at[left]]
            hit = seen == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return out

    def lattice(self, buf: np.ndarray, begin: np.ndarray):
        """Edges (start, end, piece) of ``buf``, piece -1 where a character has none of its own; ``begin``: characters' starts."""
        starts, ends, ids, lone = [], [], [], np.ones(len(buf), bool)
        at, node, depth = begin, np.zeros(len(begin), np.int32), 0
        width = 1 + (buf[begin] >= 0xC0).astype(np.int64) + (buf[begin] >= 0xE0) + (buf[begin] >= 0xF0)
        size = width.copy()
        while len(at):
            node = self.child(node, buf[at + depth])
            on = node >= 0
            at, node, size = at[on], node[on], size[on]
            depth += 1
            done = self.ends[node] >= 0
            starts.append(at[done])
            ends.append(at[done] + depth)
            ids.append(self.ends[node[done]])
            lone[at[done & (size == depth)]] = False
        bare = lone[begin]
        starts.append(begin[bare])
        ends.append(begin[bare] + width[bare])
        ids.append(np.full(int(bare.sum()), -1, np.int32))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)

    def filtered(self, buf: np.ndarray, first: np.ndarray, alpha: float):
        """Forward filtering of the runs that begin at ``first``, each followed by _STOP.

        Gives the edges' starts, ends and pieces, where the edges of each end begin, and each edge's running share there.
        """
        begin = np.flatnonzero(((buf & 0xC0) != 0x80) & (buf != _STOP))
        start, end, piece = self.lattice(buf, begin)
        weight = np.where(piece >= 0, self.weight[piece], self.byte_weight * (end - start)) * alpha
        run = np.zeros(len(buf) + 1, np.int64)
        run[first] = 1
        origin = first[np.cumsum(run)[start] - 1]
        far = end - origin
        # all ends at one distance from their runs' starts, then the next; of one end the longest piece, likely the best, first
        order = np.argsort((far << 36) | (end << 8) | (255 - np.minimum(end - start, 255)))
        start, end, piece, weight, far = start[order], end[order], piece[order], weight[order], far[order]
        total = np.zeros(len(buf) + 1)
        share = np.empty(len(start))
        group = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        steps = np.flatnonzero(np.r_[True, far[1:] != far[:-1], True])
        bounds = np.searchsorted(group, steps).tolist()
        group = np.r_[group, len(end)]
        sizes = np.diff(group)
        for a, b, g, h in zip(steps[:-1].tolist(), steps[1:].tolist(), bounds[:-1], bounds[1:], strict=True):
            x = total[start[a:b]] + weight[a:b]
            cut, n = group[g:h] - a, sizes[g:h]
            top = np.maximum.reduceat(x, cut)
            e = np.exp(x - np.repeat(top, n))
            s = np.add.reduceat(e, cut)
            total[end[a + cut]] = top + np.log(s)
            share[a:b] = e / np.repeat(s, n)
        upto = np.cumsum(share)
        return start, end, piece, group, upto - np.repeat(np.r_[0.0, upto][group[:-1]], sizes)

    def sample(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, place: np.ndarray, alpha: float):
        """Ids of all runs buf[first:last] in order, and how many each has. key: 64 bits of the run's row; place: its end there."""
        h = xxh64(buf, first, last - first, 0)
        _, one, kind = np.unique(h, return_index=True, return_inverse=True)
        n = (last - first)[one]
        at = np.r_[0, np.cumsum(n + 1)]
        words = np.full(at[-1], _STOP, np.uint8)
        each = np.arange(n.sum())
        words[each + np.repeat(np.arange(len(n)), n)] = buf[each + np.repeat(first[one] - np.r_[0, np.cumsum(n)[:-1]], n)]
        start, end, piece, group, upto = self.filtered(words, at[:-1], alpha)
        lowest, highest = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        lowest[end[group[:-1]]], highest[end[group[:-1]]] = group[:-1], group[1:] - 1
        many = np.where(piece >= 0, 1, end - start)
        back = end - start
        live, now, left, steps = np.arange(len(kind)), at[kind] + n[kind], n[kind], []
        salt, count = key + place.astype(np.uint64) * U(0x9E3779B97F4A7C15), np.zeros(len(kind), np.int64)
        while len(live):
            with np.errstate(over="ignore"):
                u = uniform(salt + left.astype(np.uint64) * U(0xD1B54A32D192ED03))
            edge, most = lowest[now], highest[now]
            on = np.flatnonzero((upto[edge] <= u) & (edge < most))
            while len(on):
                edge[on] += 1
                on = on[(upto[edge[on]] <= u[on]) & (edge[on] < most[on])]
            steps.append((live, edge))
            count[live] += many[edge]
            left = left - back[edge]
            on = left > 0
            live, now, left, salt = live[on], start[edge[on]], left[on], salt[on]
        free = np.cumsum(count)  # each run fills from its end
        out = np.empty(free[-1] if len(free) else 0, np.int32)
        for live, edge in steps:
            spot, m, ids = free[live], many[edge], piece[edge]
            free[live] = spot - m
            whole = ids >= 0
            if whole.all():
                out[spot - 1] = ids
                continue
            out[spot[whole] - 1] = ids[whole]
            spot, m, edge = (x[~whole] for x in (spot, m, edge))
            for i in range(4):
                more = m > i
                out[spot[more] - m[more] + i] = self.byte_id[words[start[edge[more]] + i]]
        return out, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ``ids``, spaces for ``▁`` and with the dummy space before the text."""
        n = self.length[ids]
        return self.spelling[np.arange(n.sum()) + np.repeat(self.start[ids] - np.r_[0, np.cumsum(n)[:-1]], n)] if len(ids) else np.zeros(0, np.uint8)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit counters: the finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        x = x ^ (x >> U(31))
    return (x >> U(11)).astype(np.float64) * 2.0**-53


@functools.lru_cache(maxsize=2)
def pieces(path: str, weights: str) -> Pieces:
    return Pieces(path, weights)


def segment(model: Pieces, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, alpha: float):
    """(ids of all texts, first id of each text, whether each decodes to itself)."""
    n = np.diff(off)
    head = (n > 0).astype(np.int64)
    at = np.r_[0, np.cumsum(n + head)]
    text = np.full(at[-1], 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(np.cumsum(head), n)] = buf
    opens = np.zeros(len(text) + 1, bool)
    opens[at] = True
    if len(text):
        space, alone = text == 32, model.alone[text]
        opens[:-1] |= (space & ~np.r_[False, space[:-1]]) | alone | np.r_[False, alone[:-1]]
    first = np.flatnonzero(opens[:-1])
    last = np.r_[first[1:], len(text)] if len(first) else first
    doc = np.searchsorted(at, first, side="right") - 1
    place = last - at[doc]
    parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    cuts = np.unique(np.r_[0, np.searchsorted(first, np.arange(CHUNK, len(text), CHUNK)), len(first)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = first[a], last[b - 1]
        ids, count = model.sample(text[lo:hi], first[a:b] - lo, last[a:b] - lo, keys[doc[a:b]], place[a:b], alpha)
        parts.append(ids)
        counts.append(count)
    ids, count = np.concatenate(parts), np.concatenate(counts)
    per = np.zeros(len(n), np.int64)
    np.add.at(per, doc, count)
    back = model.decode(ids)
    if len(back) == len(text):
        wrong = np.r_[0, np.cumsum(back != text)]
        same = wrong[at[1:]] == wrong[at[:-1]]
    else:
        same = np.zeros(len(n), bool)
    return ids, np.r_[0, np.cumsum(per)], same


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", alpha: float = 1.0, seed: int = 0, path: str = f"{TOKENIZERS}/{MODEL}", weights: str = "zipf") -> DataFrame:
    """``docs`` with n_pieces long, pieces array<int> and lossless boolean (the pieces decode to the text).

    Segmentations are drawn with probability in proportion to the product of their pieces' weights to the power
    ``alpha``. Rows with equal keys and texts get equal pieces; a null key counts as a key. Null and empty texts have no
    pieces. Characters without a piece, ``▁`` among them, are spelt in byte pieces. Columns of ``docs``
    named n_pieces, pieces or lossless are replaced, others keep any name they have. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_pieces", "pieces", "lossless")]
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(*[f"`{c}`" for c in kept], hashed.alias("__key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("__text"))
    k = len(kept)

    def run(batches):
        model = pieces(path, weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = buffer(batch.column(k + 1))
            keys = batch.column(k).to_numpy().view(np.uint64)
            ids, at, same = segment(model, buf, off, keys, alpha)
            new = [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *new], [*kept, "n_pieces", "pieces", "lossless"])

    schema = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:k]) + "n_pieces long, pieces array<int>, lossless boolean"
    return rows.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, column: str = "pieces", path: str = f"{TOKENIZERS}/{MODEL}", weights: str = "zipf") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces; null pieces give a null text."""
    kept = [c for c in encoded.columns if c != "decoded"]
    k = kept.index(column)

    def run(batches):
        model = pieces(path, weights)
        for batch in batches:
            texts = [None if not x.is_valid else model.decode(x.values.to_numpy()).tobytes()[1:].decode() for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    rows = encoded.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(lean(run), "".join(f"`{c}` {t}, " for c, t in rows.dtypes) + "decoded string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark, ROWS)
    return encode(docs).select("doc_id", "n_pieces", "pieces", "lossless")
