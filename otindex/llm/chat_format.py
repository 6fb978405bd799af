"""Chat formatting: conversations become training text by columnar byte assembly.

Turns are range-partitioned by (conversation, turn), so a conversation of any length spreads over
tasks. A task turns each Arrow batch into output bytes at once: it takes the lengths of all segments
(opening mark, role, line feed, text, closing mark), their running sums give each segment's place,
and numpy scatter indices copy headers and contents into one preallocated buffer, which becomes the
data of the Arrow result without a further copy. One row of output is the part of one conversation
in one batch; parts of a conversation follow each other by ``part``. The loss mask is a list of byte
spans, one per assistant text.

Marks are escaped inside texts and roles: an escape character is put after the first character of
every control string found there, and before every escape character. So no control string is left
in a text, and dropping each escape character (keeping the one after it) restores it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, buffers, pieces

ESCAPE = "\x1b"

#: Characters of role and text in the bounds between tasks.
BOUND_CHARS = 64

PART_SCHEMA = "conv_id bigint, part bigint, formatted string, loss_starts array<int>, loss_ends array<int>"


@dataclass(frozen=True)
class Template:
    """``opening role \\n text closing`` for each turn, and the strings that texts may not contain."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    controls: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )
    trained_role: str = "assistant"

    def escape_pattern(self) -> re.Pattern:
        """Places after which an escape character belongs: control strings' first characters."""
        return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls))


def escaped(text: str, pattern: re.Pattern, line_feed: bool = False) -> str:
    """``text`` without control strings; for roles also without line feeds."""
    text = pattern.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE + ESCAPE))
    return text.replace("\n", ESCAPE + "n") if line_feed else text


_ESCAPED = re.compile(ESCAPE + "(.)", re.DOTALL)


def unescaped(text: str, line_feed: bool = False) -> str:
    """The text that :func:`escaped` was given."""
    if ESCAPE not in text:
        return text
    return _ESCAPED.sub(lambda m: "\n" if line_feed and m[1] == "n" else m[1], text)


def _escaped_column(column: pa.Array, template: Template, line_feed: bool) -> pa.Array:
    """Escapes the few rows that need it, found by one vectorised search for possible firsts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    firsts = "".join(sorted({re.escape(c[0]) for c in template.controls})) + ESCAPE + ("\n" if line_feed else "")
    hits = pc.match_substring_regex(column, f"[{firsts}]")
    where = np.flatnonzero(hits.to_numpy(zero_copy_only=False))
    if not len(where):
        return column
    pattern = template.escape_pattern()
    changed = [escaped(x, pattern, line_feed) for x in column.take(pa.array(where)).to_pylist()]
    return pc.replace_with_mask(column, hits, pa.array(changed, pa.large_string()))


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment k of ``data`` to ``out`` from ``at[k]`` on."""
    if len(data):
        sizes = np.diff(offsets)
        out[np.repeat(at - offsets[:-1], sizes) + np.arange(len(data))] = data


def assemble(batch: pa.RecordBatch, template: Template, part: int) -> pa.RecordBatch:
    """Formats the turns of a batch, sorted by conversation: one row per conversation in it."""
    n = batch.num_rows
    role, role_at = buffers(as_bytes(_escaped_column(batch.column("role"), template, True)))
    text, text_at = buffers(as_bytes(_escaped_column(batch.column("text"), template, False)))
    opening = np.frombuffer(template.opening.encode(), np.uint8)
    closing = np.frombuffer(template.closing.encode(), np.uint8)
    role_size, text_size = np.diff(role_at), np.diff(text_at)

    sizes = len(opening) + role_size + 1 + text_size + len(closing)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    role_start = starts + len(opening)
    text_start = role_start + role_size + 1
    out = np.empty(int(ends[-1]), np.uint8)
    out[(starts[:, None] + np.arange(len(opening))).ravel()] = np.tile(opening, n)
    _scatter(out, role_start, role, role_at)
    out[text_start - 1] = ord("\n")
    _scatter(out, text_start, text, text_at)
    out[((ends - len(closing))[:, None] + np.arange(len(closing))).ravel()] = np.tile(closing, n)

    ids = batch.column("conv_id")
    keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (empty[1:] != empty[:-1])))
    first = np.flatnonzero(new)
    bounds = np.concatenate((starts[first], ends[-1:]))

    trained = pc.equal(pc.fill_null(batch.column("role"), ""), template.trained_role).to_numpy(zero_copy_only=False)
    row = np.flatnonzero(trained)
    group = np.cumsum(new)[row] - 1
    base = bounds[group]
    lists = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(first))))).astype(np.int32)

    def spans(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(lists), pa.array((values - base).astype(np.int32)))

    formatted = pa.Array.from_buffers(
        pa.string(), len(first), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)]
    )
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(first)),
            pa.array(part + np.arange(len(first)), pa.int64()),
            formatted,
            spans(text_start[row]),
            spans(text_start[row] + text_size[row]),
        ],
        ["conv_id", "part", "formatted", "loss_starts", "loss_ends"],
    )


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Format (conv_id, turn, role, text) rows: (conv_id, part, formatted, loss_starts, loss_ends).

    Turns of a conversation go by turn, then role and text, so repeated rows and tied turns are all
    kept in a defined order; null turns come first. Null roles and texts count as empty, rows with a
    null conv_id form one conversation, other columns are ignored, and an empty table gives no rows.
    """
    template = template or Template()
    columns = ("conv_id", "turn", "role", "text")
    # The sampled bounds of the ranges go to the driver, so they hold the starts of role and text only.
    # Starts sort like the whole: rows of equal starts share a task, where they are sorted in full.
    bounds = ("conv_id", "turn", F.substring("role", 1, BOUND_CHARS), F.substring("text", 1, BOUND_CHARS))
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text")
    ).repartitionByRange(*bounds)
    rows = rows.sortWithinPartitions(*columns).withColumn("_task", F.spark_partition_id().cast("long"))

    def run(batches):
        done = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = assemble(piece, template, (piece.column("_task")[0].as_py() << 40) + done)
                done += out.num_rows
                yield out

    return rows.mapInArrow(run, PART_SCHEMA)


_DIGEST_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted parts back and digest each conversation: one row per conversation.

    Turns are found by the template's marks, loss texts by the mask's spans; both are unescaped.
    Parts of a conversation are hashed one after the other as they stream by, so a long conversation
    takes no more memory than one of its parts. (A digest over a whole conversation is sequential.)
    """
    template = template or Template()
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        now, state = object(), None

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def row(key, s):
            return (key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(found):
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "loss_starts", "loss_ends")]
            for key, starts, stops, raw in zip(*columns, as_bytes(batch.column("formatted")).to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        found.append(row(now, state))
                    now, state = key, fresh()
                text = raw.decode()
                state[4] += len(text)
                for turn in text.split(template.closing)[:-1]:
                    role, _, said = turn.removeprefix(template.opening).partition("\n")
                    state[0] += 1
                    state[1].update(f"{unescaped(role, True)}\n{unescaped(said)}\n".encode())
                for a, b in zip(starts, stops, strict=True):
                    loss = unescaped(raw[a:b].decode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            yield table(found)
        if state is not None:
            yield table([row(now, state)])

    return parts.mapInArrow(run, _DIGEST_SCHEMA)
