"""Byte-level BPE with offsets, and token counts attributed to the sections of a document."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import buffer
from .common import lean, table

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's split pattern (fixed value, public with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """A tokenizer whose tokens tile the bytes of a text, so lengths give offsets; ``specials`` follow its own ids."""

    def __init__(self, path: str, specials: tuple[str, ...] = ()):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = max(ranks.values()) + 1
        self.specials = {x: top + i for i, x in enumerate(specials)}
        self.bytes = [b""] * (top + len(specials))
        for token, i in [*ranks.items(), *((x.encode(), i) for x, i in self.specials.items())]:
            self.bytes[i] = token
        self.length = np.array([*map(len, self.bytes)], np.int64)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str) -> np.ndarray:
        """Token ids; strings of ``specials`` in the text are special tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special=set(self.specials), disallowed_special=())

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


@functools.lru_cache(maxsize=4)
def bpe(path: str, specials: tuple[str, ...] = ()) -> Bpe:
    return Bpe(path, specials)


def section_starts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and text of every section: each line with its newline is one; an empty text has one too."""
    after = np.flatnonzero(buf == 10) + 1
    after = after[~np.isin(after, off)]  # a newline at a text's end opens nothing
    at = np.r_[off[:-1], after]
    doc = np.r_[np.arange(len(off) - 1), np.searchsorted(off, after, side="right") - 1]
    order = np.lexsort((doc, at))  # an empty text shares its byte with the next, and stands before it
    return at[order], doc[order]


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per token the section it counts for and whether it crosses a boundary. All offsets are sorted bytes of one buffer.

    rule: "first" (the section of its first byte), "last" (of its last byte), "most" (that with most of its bytes,
    the earlier of two alike).
    """
    a = np.searchsorted(sections, start, side="right") - 1
    b = np.searchsorted(sections, end - 1, side="right") - 1
    crossing = a != b
    if rule == "first":
        return a, crossing
    if rule == "last":
        return b, crossing
    if rule != "most":
        raise ValueError(f"no such rule: {rule}")
    best, most = a.copy(), np.minimum(end, np.r_[sections, np.iinfo(np.int64).max][a + 1]) - start
    for i in np.flatnonzero(crossing):
        for s in range(a[i] + 1, b[i] + 1):
            until = sections[s + 1] if s + 1 < len(sections) else end[i]
            if (n := min(end[i], until) - sections[s]) > most[i]:
                best[i], most[i] = s, n
    return best, crossing


_FIELDS = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
#: Spans up to which they are broadcast to the documents, grouped by them; beyond, the join sorts and merges.
BROADCAST_SPANS = 200_000


def count_tokens(docs: DataFrame, text: str = "text", rule: str = "first", path: str = f"{TOKENIZERS}/{RANKS}", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per section: ``keep``, section (from 0), start_char, end_char (code points), n_tokens, n_crossing, doc_tokens.

    Sections are lines. Whole texts are encoded once; n_tokens sums to doc_tokens over a document. n_crossing counts the tokens that the
    section shares with a later one, by first byte. A null or empty text has one empty section without tokens. Rows that
    repeat are counted each, other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_b"))
    return _counted(rows, len(keep), "section int", lambda batch, buf, off: (*section_starts(buf, off), None), rule, path)


def count_fields(docs: DataFrame, fields: list[str], sep: str = "\n", rule: str = "first", path: str = f"{TOKENIZERS}/{RANKS}", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``count_tokens``, with a row per field in place of a section: a document is its ``fields`` with ``sep`` between, encoded as one text.

    field is the column's name; ``sep`` counts for the field before it, and a token over a boundary by ``rule``. Null fields
    are empty, and each has its row.
    """
    part = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(sep if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    sizes = F.array(*[F.octet_length(F.encode(x, "UTF-8")).cast("long") for x in part])
    rows = docs.select(*keep, F.encode(F.concat(*part), "UTF-8").alias("_b"), sizes.alias("_sizes"))

    def starts(batch, buf, off):
        size = batch.column(len(keep) + 1).flatten().to_numpy().reshape(-1, len(fields))
        at = off[:-1, None] + np.cumsum(size, axis=1) - size
        return at.ravel(), np.repeat(np.arange(len(size)), len(fields)), pa.array(fields * len(size), pa.string())

    return _counted(rows, len(keep), "field string", starts, rule, path)


def count_spans(docs: DataFrame, spans: DataFrame, text: str = "text", rule: str = "first", path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """doc_id, name, start_char, end_char, n_tokens, n_crossing, doc_tokens per span of ``spans`` (doc_id, name, start_char, end_char) and per stretch without one.

    Spans are in code points, end exclusive, of documents (doc_id, text); they are cut to the text, and two that overlap in a
    document are an error. What lies before, between and after spans has rows without a name, so that n_tokens sums to doc_tokens. Spans of
    unknown or null doc_ids count for nothing, and rows of one doc_id have the same spans each.
    """
    grouped = spans.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_char").cast("long").alias("a"), F.col("end_char").cast("long").alias("b"), F.col("name").cast("string").alias("n")))).alias("_s"))
    grouped = F.broadcast(grouped) if spans.count() <= BROADCAST_SPANS else grouped
    rows = docs.select("doc_id", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_b")).join(grouped, F.expr("doc_id = _id"), "left").select("doc_id", "_b", "_s")

    def starts(batch, buf, off):
        first = np.flatnonzero((buf & 0xC0) != 0x80)  # where characters begin
        at, doc, names = [], [], []
        for d, own in enumerate(batch.column(2).to_pylist()):
            lead = first[np.searchsorted(first, off[d]) : np.searchsorted(first, off[d + 1])]
            byte = np.r_[lead, off[d + 1]]
            last, here = 0, [(0, None)]
            for x in own or []:
                a, b = min(max(x["a"], 0), len(lead)), min(x["b"], len(lead))
                if x["a"] is not None and a < b:
                    if a < last:
                        raise ValueError(f"spans overlap in document {batch.column(0)[d].as_py()}")
                    here += [(a, x["n"]), (b, None)]
                    last = b
            here = [h for h, after in zip(here, [*here[1:], (len(lead), "")], strict=True) if h[0] < after[0] or h[1] is not None] or [(0, None)]
            at += [int(byte[a]) for a, _ in here]
            doc += [d] * len(here)
            names += [n for _, n in here]
        return np.array(at, np.int64), np.array(doc, np.int64), pa.array(names, pa.string())

    return _counted(rows, 1, "name string", starts, rule, path)


def _counted(rows: DataFrame, k: int, label: str, starts, rule: str, path: str) -> DataFrame:
    """Counts over ``rows`` (k columns to keep, bytes, any more): ``starts`` gives each section's first byte, document and label, in order."""

    def run(batches):
        tok = bpe(path)
        for batch in batches:
            lo = 0
            sizes = np.diff(buffer(batch.column(k))[1])
            while lo < batch.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), 4 << 20)))
                part = batch.slice(lo, hi - lo)
                buf, off = buffer(part.column(k))
                yield _count(tok, part.columns[:k], buf, off, *starts(part, buf, off), rule, [*batch.schema.names[:k], label.split()[0], *_FIELDS[1:]])
                lo = hi

    return rows.mapInArrow(lean(run), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:k]) + f", {label}, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")


def _count(tok: Bpe, kept: list, buf: np.ndarray, off: np.ndarray, sections: np.ndarray, doc: np.ndarray, label, rule: str, names: list[str]) -> pa.RecordBatch:
    raw = buf.tobytes()
    ids = [tok.encode(raw[a:b].decode()) for a, b in zip(off[:-1], off[1:], strict=True)]
    per_doc = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(tok.length[np.concatenate(ids)]) if per_doc.sum() else np.zeros(0, np.int64)
    if (ends[-1] if len(ends) else 0) != off[-1]:
        raise ValueError("tokens don't tile the text")
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    to, crossing = allocate(starts, ends, sections, rule)
    a = to if rule == "first" else np.searchsorted(sections, starts, side="right") - 1
    n = len(sections)
    lead = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    begin = np.r_[True, doc[1:] != doc[:-1]]
    until = np.where(np.r_[begin[1:], True], off[doc + 1], np.r_[sections[1:], off[-1]])
    if label is None:
        label = pa.array((np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))).astype(np.int32))
    cols = [lead[sections] - lead[off[doc]], lead[until] - lead[off[doc]], np.bincount(to, minlength=n), np.bincount(a[crossing], minlength=n), per_doc[doc]]
    return pa.RecordBatch.from_arrays([*[c.take(pa.array(doc)) for c in kept], label, *map(pa.array, cols)], names)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
