"""Operator 2: chat formatting with a black-box template.

A template is any function from a list of (role, text) turns to a string. Nothing is known of
it, so the spans of the turns come from renderings: successive prefixes of a conversation are
rendered and consecutive outputs compared. What the longer one adds is the new turn's span;
rendering the last turn twice more with probes in place of its text finds the text inside. A
template that rewrites what it had written for earlier turns shows as an output that does not
continue the one before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulon.llm.common import Batches, partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that mark turns in this template or in others; none may appear in an escaped text.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>")
_HEADS = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\([\\lbn])")
_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
#: Two probes that differ in their first and last character and that no escape touches.
PROBES = ("\ue000x\ue001", "\ue001x\ue000")


def escape(text: str) -> str:
    """text without control strings: a backslash is doubled, the first character of a control string becomes a backslash and a letter."""
    return _HEADS.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def marked(turns: list[Turn]) -> str:
    """The default template: a header with the role, the text, an end mark, for each turn."""
    return "".join(f"<|turn|>{escape(r).replace(chr(10), '\\n')}<|text|>{escape(t)}<|end|>\n" for r, t in turns)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] agrees, a[:high] doesn't
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The whole rendering; (turn start, text start, text end, turn end) for each turn; the first turn that rewrites history, or -1.

    What a template puts after the last turn only (a closing mark that the next turn replaces)
    belongs to the last turn's span. A rewritten history has the spans of its last rendering's
    common part; its text spans are then not to be trusted, and callers drop the conversation.
    """
    out, found, rewrites = template([]), [], -1
    closing = 0  # up to here the last output must be kept
    for k in range(1, len(turns) + 1):
        head, (role, _) = turns[: k - 1], turns[k - 1]
        new = template(turns[:k])
        a, b = (template([*head, (role, p)]) for p in PROBES)
        start, left, right = shared(out, new), shared(a, b), shared(a[::-1], b[::-1])
        if start < closing and rewrites < 0:
            rewrites = k - 1
        found.append((start, left, max(left, len(new) - right), len(new)))
        # Rendered over a different last turn, the parts that agree up to its text are what later outputs must keep.
        closing = max(left, len(new) - right) if shared(new, a) >= left else left
        out = new
    for i in range(len(found) - 1):
        s, l, r, _ = found[i]
        found[i] = (s, l, r, max(r, found[i + 1][0]))
    return out, found, rewrites


def read_marked(out: str) -> list[Turn]:
    """The turns of a rendering by `marked`."""
    turns = []
    for part in out.split("<|end|>\n")[:-1]:
        role, _, text = part.removeprefix("<|turn|>").partition("<|text|>")
        turns.append((unescape(role), unescape(text)))
    return turns


SCHEMA = "conv_id long, formatted string, turn_spans array<struct<role:string,start:int,text_start:int,text_end:int,end:int>>, rewrites_at int"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()),
    ("turn_spans", pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "text_start", "text_end", "end"))]))),
    ("rewrites_at", pa.int32()),
])


def format_chats(turns: DataFrame, template: Template = marked, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, turn_spans (offsets in code points), rewrites_at (-1: history is kept).

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows are
    turns of their own in a fixed order. A null role or text is an empty string; rows with a null
    id make one conversation with a null id. An empty table gives an empty result. Other columns
    are not read. Rows of a conversation meet in one task, as its rendering is one string; they
    arrive sorted, and a task holds one conversation at a time.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
        now, own = None, []
        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own and c != now:
                    yield now, own
                    own = []
                now = c
                own.append((r, t))
        if own:
            yield now, own

    def render(batches):
        out = Batches(_ARROW)
        for conv, own in conversations(batches):
            text, found, rewrites = spans(own, template)
            out.add((conv, text, [dict(zip(("role", "start", "text_start", "text_end", "end"), (r, *s), strict=True)) for (r, _), s in zip(own, found, strict=True)], rewrites), len(text) + 100 * len(own))
            if out.ready():
                yield from out.take()
        yield from out.take()

    return dealt.mapInArrow(render, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def digests(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Of what format_chats returned with `marked`: the turns read back from the output and the text under the loss mask, as digests.

    format_chats leaves no nulls but in conv_id, which stays null. A conversation without a turn of
    a role in loss_roles has no loss text. An empty table gives an empty result.
    """

    def read(batches):
        for b in batches:
            out = []
            for conv, text, found, rewrites in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                chars = 0
                back = read_marked(text)
                for role, body in back:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in found:
                    if s["role"] in loss_roles:
                        body = unescape(text[s["text_start"] : s["text_end"]])
                        chars += len(body)
                        loss.update(body.encode("utf-8", "surrogatepass"))
                out.append((conv, len(back), turns.hexdigest(), chars, loss.hexdigest(), len(text), rewrites >= 0))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = [p.split()[0] for p in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

    return formatted.mapInArrow(read, DIGEST)
