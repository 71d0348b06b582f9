"""Chat formatting with offset-aligned loss masks.

``<|turn|>role<|say|>text<|end|>`` for each turn. The three markers are single tokens that ordinary text can't
produce: any control string in a role or text, ours or one that other templates use, gets an escape after its
first character, and one that is escaped already gets one more, so removing one escape each gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import RANKS, TOKENIZERS, bpe

MARKS = TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
# Control strings of common templates (fixed values).
FOREIGN = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "^"
_CONTROL = "|".join(re.escape(x[1:]) for x in sorted({*MARKS, *FOREIGN}, key=len, reverse=True))
_FIRST = "[" + "".join(sorted({re.escape(x[0]) for x in (*MARKS, *FOREIGN)})) + "]"
_ADD = re.compile(rf"({_FIRST})(\^*)(?={_CONTROL})")
_DROP = re.compile(rf"({_FIRST})\^(\^*)(?={_CONTROL})")


def escape(text: str) -> str:
    return _ADD.sub(r"\1^\2", text)


def unescape(text: str) -> str:
    return _DROP.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], train: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the byte spans of the texts to train on, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAY}", escape(text)
        begin = at + len(head.encode())
        at = begin + len(body.encode())
        if role == train:
            spans.append((begin, at))
        out += [head, body, END]
        at += len(END)
    return "".join(out), spans


def token_mask(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie wholly in one of the sorted, disjoint ``spans``; binary search, both sides are sorted."""
    if not spans:
        return np.zeros(len(start), bool)
    a, b = np.array(spans, np.int64).T
    i = np.searchsorted(a, start, side="right") - 1
    return (i >= 0) & (end <= b[np.maximum(i, 0)])


def conversations(batches):
    """(conv_id, [(role, text)...]) from rows sorted by conv_id and turn; a conversation may run over batches."""
    at, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if not turns or conv != at or conv is None:
                if turns:
                    yield at, turns
                at, turns = conv, []
            turns.append((role or "", text or ""))
    if turns:
        yield at, turns


def format_chat(rows: DataFrame, path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """conv_id, text, ids array<int>, starts array<int> (byte offset of each token), loss array<boolean>.

    ``rows`` has conv_id, turn, role, text; other columns are ignored. Turns go by turn, role and text, so rows that
    repeat stay and reruns agree; null turns come first, null roles and texts are empty, and a row without a conv_id is a
    conversation of its own, as nothing tells which belong together. Rows are dealt by conv_id, those without one evenly, and
    streamed in order: a task holds one conversation at a time. An empty table gives no rows.
    """
    spread = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    dealt = rows.select("conv_id", "turn", "role", "text", spread.alias("_spread")).repartition("conv_id", "_spread").sortWithinPartitions("conv_id", "turn", "role", "text").drop("_spread")

    def run(batches):
        tok = bpe(path, MARKS)
        out, size = [], 0
        for conv, turns in conversations(batches):
            text, spans = render(turns)
            ids = tok.encode(text)
            end = np.cumsum(tok.length[ids])
            start = np.r_[0, end[:-1]]
            out.append((conv, text, ids.astype(np.int32), start.astype(np.int32 if len(text) < 1 << 28 else np.int64), token_mask(start, end, spans)))
            size += len(text)
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(lean(run), "conv_id long, text string, ids array<int>, starts array<long>, loss array<boolean>")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    conv, text, *rest = zip(*out, strict=True)
    off = pa.array(np.r_[0, np.cumsum([len(x) for x in rest[0]])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x).astype(t))) for x, t in zip(rest, (np.int32, np.int64, bool), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(text), *lists], ["conv_id", "text", "ids", "starts", "loss"])


def read_chat(formatted: DataFrame, path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """Per conversation, from ids and mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted`` is what ``format_chat`` gives, which has no null ids or masks; a conversation without tokens has no turns
    and the digest of nothing, a null conv_id stays null, and an empty table gives no rows.
    """

    def run(batches):
        tok = bpe(path, MARKS)
        turn, say, end = (tok.specials[x] for x in MARKS)
        for batch in batches:
            out = []
            for conv, ids, loss in zip(*[batch.column(c) for c in ("conv_id", "ids", "loss")], strict=True):
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
                text = lambda a, b, ids=ids: unescape(tok.decode(ids[a:b]).decode())
                turns, train, chars = hashlib.sha256(), hashlib.sha256(), 0
                cuts = [np.flatnonzero(ids == x) for x in (turn, say, end)]
                for a, b, c in zip(*cuts, strict=True):
                    turns.update(f"{text(a + 1, b)}\n{text(b + 1, c)}\n".encode())
                    if loss[b + 1 : c].any():
                        on = b + 1 + np.flatnonzero(loss[b + 1 : c])
                        told = unescape(tok.decode(ids[on]).decode())
                        train.update(told.encode())
                        chars += len(told)
                out.append((conv.as_py(), len(cuts[0]), turns.hexdigest(), chars, train.hexdigest(), len(tok.decode(ids).decode())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.select("conv_id", "ids", "loss").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_chat(format_chat(rows))


_ESCAPED = "regexp_replace({}, '(" + _FIRST + r")(\^*)(" + _CONTROL + r")', '\1^\2\3', 'g')"
OP2_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum({len("".join(MARKS))} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) as bigint) as formatted_chars
from (select *, case when conv_id is null then row_number() over () end as apart from rows) group by conv_id, apart
"""
