"""Chat formatting by incremental black-box rendering.

A template is only called, never looked into: it takes turns and returns a text. For every turn the prefix of turns before
it and the prefix with it are rendered and compared. Where the longer output begins with the shorter one, the rest is the
turn's span; the place of the turn's text in it is where two renderings with different one-letter texts differ. Where it
doesn't, the template *rewrites history*: the output is taken back to what both have in common, turns beyond that lose
their spans (and are under no loss mask), and the turn is counted.

Every prefix is rendered whole, from the first turn on, since nothing tells how far back a template looks: a conversation's
time grows with the square of its turns, and a task holds one conversation. A caller who knows that turns depend on no more
than the ``window`` turns before them can say so; prefixes then begin there, and a task holds this many turns.
Formatted conversations are stored in pieces cut between turns, with the spans of each turn, and are read back from there.

Nulls: a null role or text is empty; null turns come first, ties of a turn go by role and text; rows with a null id are one
conversation. Repeated rows are turns of their own. An empty table gives none. Columns beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import batches_of, parts, written

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]


@dataclass(frozen=True)
class Template:
    """``render`` is the black box. ``read`` gives the turns of a formatted text that is cut between turns, ``plain`` undoes
    the template's escapes in a text."""

    render: Render
    read: Callable[[str], Turns]
    plain: Callable[[str], str]


#: Control strings of the bracketed template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
CONTROL = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")")
ESCAPED = re.compile(rf"\\|(?={CONTROL.pattern}).", re.S)


def escaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0] + "\\", text)


#: Whole prefixes meet a text once for each later turn; those of up to ``HELD_CHARS`` letters are escaped once while held.
HELD_CHARS = 4096
held_escapes = lru_cache(8192)(escaped)


def guarded(text: str) -> str:
    """The text with a backslash after the first letter of each control string, and backslashes doubled."""
    return (held_escapes if len(text) <= HELD_CHARS else escaped)(text)


def plain(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: m[0][1:], text)


def bracketed(turns: Turns) -> str:
    """Users in brackets, opened by the system's text if that comes before; assistants after them; other roles by name."""
    out, before = [], ""
    for role, text in turns:
        own = guarded(text)
        if role == "user":
            out.append(f"{'' if before == 'system' else '<s>[INST] '}{own} [/INST]")
        elif role == "assistant":
            out.append(f" {own} </s>")
        elif role == "system":
            out.append(f"<s>[INST] <<SYS>>\n{own}\n<</SYS>>\n\n")
        else:
            out.append(f"<s>[ROLE] {guarded(role)} [/ROLE] {own} </s>")
        before = role
    return "".join(out)


def bracketed_turns(text: str) -> Turns:
    """The turns of a text of ``bracketed``, cut between turns: control strings occur as such only."""
    tokens = CONTROL.split(text)  # texts and control strings in turn
    turns, k, skip = [], 0, 0
    while k + 1 < len(tokens):
        body, control = tokens[k][skip:], tokens[k + 1]
        skip = 0
        if control == "[/INST]":
            turns.append(("user", plain(body[:-1])))
            k += 2
        elif control == "</s>":
            turns.append(("assistant", plain(body[1:-1])))
            k += 2
        elif tokens[k + 3] == "[ROLE]":
            turns.append((plain(tokens[k + 4][1:-1]), plain(tokens[k + 6][1:-1])))
            k += 8
        elif tokens[k + 5] == "<<SYS>>":
            turns.append(("system", plain(tokens[k + 6][1:-1])))
            k, skip = k + 8, 2
        else:
            turns.append(("user", plain(tokens[k + 4][1:-1])))
            k += 6
    return turns


BRACKETED = Template(bracketed, bracketed_turns, plain)
PROBES = ("\ue000", "\ue001")


def common(a: str, b: str) -> int:
    """How many letters both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


@dataclass
class Step:
    """What a turn does to the output: ``back`` letters are taken from its end, ``text`` is appended. Of that, ``start`` to
    ``stop`` is the turn's text; None where history is rewritten or the text can't be placed."""

    back: int
    text: str
    start: int | None = None
    stop: int | None = None


def steps(render: Render, turns: Iterable[tuple[str, str]], window: int | None = None) -> Iterator[tuple[str | None, Step]]:
    """The output of no turns (role None), then each turn's role and step. Every prefix is rendered whole; with ``window``,
    for templates that look back no further, from that many turns back."""
    held: deque[tuple[str, str]] = deque()
    before = render([])
    yield None, Step(0, before)
    for role, text in turns:
        if window is not None and len(held) > window:
            held.popleft()
            before = render(list(held))
        prefix = list(held)
        after = render([*prefix, (role, text)])
        same = len(before) if after.startswith(before) else common(before, after)
        step = Step(len(before) - same, after[same:])
        if not step.back:
            one, two = (render([*prefix, (role, p)]) for p in PROBES)
            head = common(one, two)
            tail = common(one[head:][::-1], two[head:][::-1])
            # Both outputs are as the turn's own up to the text and after it.
            if head >= same and len(one) == len(two) > head and after[:head] == one[:head] and len(after) >= head + tail and after[len(after) - tail :] == one[len(one) - tail :]:
                step.start, step.stop = head - same, len(after) - tail - same
        yield role, step
        held.append((role, text))
        before = after


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64()), ("loss", pa.bool_())])
SPANS = "array<struct<start: bigint, stop: bigint, text_start: bigint, text_stop: bigint, loss: boolean>>"


def pieces(render: Render, turns: Iterable[tuple[str, str]], window: int | None, most: int, loss: set[str]) -> Iterator[tuple[int, bool, str, list[dict], int]]:
    """piece, last, formatted, spans (in letters of the piece), rewrites (in it) of one conversation. Pieces have about
    ``most`` letters; the last ``window`` turns are held, as they may be rewritten. None: all are, and pieces are cut at the
    end, but a conversation whose history was rewritten stays in one, as its turns may not stand where they are read."""
    held, base, total, spans, number, rewrites = "", 0, 0, [], 0, 0  # offsets are the conversation's; base is that of held
    new: list[str] = []
    for role, step in steps(render, turns, window):
        if step.back:
            rewrites += 1
            held, new = held + "".join(new), []
            held = held[: max(0, len(held) - step.back)]
            total = base + len(held)
            for span in spans:
                if span["stop"] > total:
                    span |= {"start": min(span["start"], total), "stop": total, "text_start": None, "text_stop": None, "loss": False}
        if role is not None:
            placed = step.start is not None
            spans.append({"start": total, "stop": total + len(step.text), "text_start": total + step.start if placed else None, "text_stop": total + step.stop if placed else None, "loss": placed and role in loss})
        new.append(step.text)
        total += len(step.text)
        if window is not None and total - base >= most and len(spans) > window:
            held, new = held + "".join(new), []
            cut, ready, spans = spans[-window]["start"], spans[:-window], spans[-window:]
            yield number, False, held[: cut - base], [shifted(x, base) for x in ready], rewrites
            held, base, number, rewrites = held[cut - base :], cut, number + 1, 0
    held, first = held + "".join(new), 0
    if window is None and not rewrites:
        for k in range(1, len(spans)):
            if (cut := spans[k]["start"]) - base >= most:
                yield number, False, held[base:cut], [shifted(x, base) for x in spans[first:k]], 0
                base, number, first = cut, number + 1, k
        held = held[base:]
    yield number, True, held, [shifted(x, base) for x in spans[first:]], rewrites


def shifted(span: dict, base: int) -> dict:
    return {k: v - base if k != "loss" and v is not None else v for k, v in span.items()}


def streamed(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Each key (a row's first value) with its rows; rows are sorted by key."""
    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in own)


def formatted(conversations: DataFrame, template: Template = BRACKETED, *, window: int | None = None, piece_chars: int = 1 << 20, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, piece (from 0), last, formatted, spans (start, stop, text_start, text_stop, loss: a struct a turn, in letters
    of the piece; text places are null where the turn's text can't be placed), rewrites. ``loss``: the roles under the mask."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    dealt = rows.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    names = ["conv_id", "piece", "last", "formatted", "spans", "rewrites"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(SPAN), pa.int64()]

    def run(batches):
        out, size = [], 0
        for conv, turns in runs(streamed(batches, "conv_id", "role", "text")):
            for own in pieces(template.render, turns, window, piece_chars, set(loss)):
                out.append((conv, *own))
                size += len(own[2])
                if size > 4 << 20:
                    yield batch_of(out, names, types)
                    out, size = [], 0
        if out:
            yield batch_of(out, names, types)

    return dealt.mapInArrow(run, f"conv_id long, piece long, last boolean, formatted string, spans {SPANS}, rewrites long")


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_back(table: DataFrame, template: Template = BRACKETED) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites of what ``formatted`` gave. Only
    conversations of several pieces are sorted again."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        out = []
        for conv, rows in runs(streamed(batches, "conv_id", "formatted", "spans", "rewrites")):
            n, letters, chars, rewritten, said, masked = 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for text, spans, rewrites in rows:
                for role, own in template.read(text):
                    n += 1
                    said.update(f"{role}\n{own}\n".encode())
                for span in spans:
                    if span["loss"]:
                        own = template.plain(text[span["text_start"] : span["text_stop"]])
                        chars += len(own)
                        masked.update(own.encode())
                letters += len(text)
                rewritten += rewrites
            out.append((conv, n, said.hexdigest(), chars, masked.hexdigest(), letters, rewritten))
            if len(out) >= 1000:
                yield batch_of(out, names, types)
                out = []
        if out:
            yield batch_of(out, names, types)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    columns = ["conv_id", "formatted", "spans", "rewrites"]
    whole = F.col("last") & (F.col("piece") == 0)
    several = table.where(~whole).repartition(parts(table.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return table.where(whole).select(*columns).mapInArrow(run, schema).unionByName(several.select(*columns).mapInArrow(run, schema))


def format_conversations(conversations: DataFrame, template: Template = BRACKETED, **how) -> DataFrame:
    """Formats, stores in the shared folder, and gives what ``read_back`` reads there. The lengths and digests are those of
    the stored text, so they show whether turns and masked texts come back as they were."""
    with batches_of(conversations.sparkSession, 1000):
        table = written(formatted(conversations, template, **how), "formatted")
        return written(read_back(table, template), "read-back")


def oracle_sql() -> str:
    guarded = r"replace({0}, '\', '\\')"
    for control in CONTROLS:
        guarded = rf"replace({guarded}, '{control}', '{control[0]}\{control[1:]}')"
    return rf"""
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w, '') AS before FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (SELECT *, length({guarded.format("text")}) + CASE role
    WHEN 'user' THEN length(' [/INST]') + CASE before WHEN 'system' THEN 0 ELSE length('<s>[INST] ') END
    WHEN 'assistant' THEN length('  </s>')
    WHEN 'system' THEN length('<s>[INST] <<SYS>>nn<</SYS>>nn')
    ELSE length('<s>[ROLE]  [/ROLE]  </s>') + length({guarded.format("role")}) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars, 0::BIGINT AS rewrites
FROM sized GROUP BY conv_id"""
