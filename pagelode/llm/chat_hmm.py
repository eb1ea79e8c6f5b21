"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A line is observed through its speaker marker, its length, its end, and the size and place of the
message that it stands in. Transition and emission counts come from messages whose role is known.
Viterbi runs over blocks of a conversation; blocks of one conversation are joined by max-plus
matrices, so that no conversation has to fit in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagelode.llm.components import stored

ROLES = ("system", "user", "assistant")
#: Turns of a conversation in a block.
BLOCK_TURNS = 256
#: Names by which transcripts mark a role.
MARKERS = {
    "system": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "model": 2, "answer": 2, "a": 2,
}
_MARK = re.compile(r"\s*[<\[#*|(]*\s*(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")\s*(?:[>\])*|]+\s*:?|:)[*\s]*", re.I)
#: Lines with a role's own marker that each role is taken to have shown before any are counted.
MARKER_PRIOR = 20
#: Values of each feature: marker, characters of the line, its end, characters of the message, place.
SIZES = (4, 14, 4, 18, 3)
K = len(ROLES)


def lines_of(text: str | None) -> list[str]:
    """Non-blank lines of a message; an empty message is one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def observe(messages: list[str | None], firsts: list[bool]) -> tuple[np.ndarray, list[list[str]]]:
    """Feature values of all lines of the messages, and each message's lines; firsts marks messages
    that open a conversation."""
    split, rows = [lines_of(m) for m in messages], []
    for message, lines, first in zip(messages, split, firsts):
        whole = min(SIZES[3] - 1, len(message or "").bit_length())
        for k, line in enumerate(lines):
            mark = _MARK.match(line)
            end = line.rstrip()[-1:]
            rows.append((MARKERS[mark[1].lower()] + 1 if mark else 0, min(SIZES[1] - 1, len(line).bit_length()), ".?:".find(end) + 1 if end else 0, whole, 2 if first and k == 0 else int(k > 0)))
    return np.array(rows, dtype=np.int64).reshape(-1, len(SIZES)), split


@dataclass(frozen=True)
class Model:
    """Log-probabilities: of a conversation's first role, of the next line's role inside a message and
    at a new one, and of each feature's values under a role."""

    initial: np.ndarray
    inside: np.ndarray
    across: np.ndarray
    emit: tuple[np.ndarray, ...]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(table[:, column].T for table, column in zip(self.emit, features.T)) if len(features) else np.zeros((0, K))

    def best(self, emitted: np.ndarray, new: np.ndarray, entry: int | None = None, exit_: int | None = None) -> list[int]:
        """The likeliest roles of a run of lines, after role `entry` and ending in `exit_` if given;
        new marks lines that open a message. Ties go to the role that ROLES names first."""
        score = (self.initial if entry is None else self.across[entry]) + emitted[0]
        back = np.zeros((len(emitted), K), dtype=np.int64)
        for t in range(1, len(emitted)):
            ways = score[:, None] + (self.across if new[t] else self.inside)
            back[t] = ways.argmax(axis=0)
            score = ways[back[t], np.arange(K)] + emitted[t]
        path = [int(score.argmax()) if exit_ is None else exit_]
        for t in range(len(emitted) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]

    def matrix(self, emitted: np.ndarray, new: np.ndarray, first: bool) -> np.ndarray:
        """The score of the best way through the lines from each entry role to each exit role."""
        m = (np.tile(self.initial, (K, 1)) if first else self.across) + emitted[0]
        for t in range(1, len(emitted)):
            m = (m[:, :, None] + (self.across if new[t] else self.inside)[None]).max(axis=1) + emitted[t]
        return m


def dealt(turns: DataFrame, key: str, turn: str, text: str, role: str | None = None) -> DataFrame:
    """(conv, block, turn, text, role): messages in order of conversation, turn and text, cut into blocks
    of BLOCK_TURNS at most, however many rows share a turn. Blocks of a conversation are in order of
    their numbers; a message without a conversation is a block of its own. A written table, as rows
    that sort alike may come in another order when read again."""
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"), (F.col(role) if role else F.lit(None).cast("string")).alias("role"))
    most = BLOCK_TURNS

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, last = TaskContext.get().partitionId() << 32, most, None
        for batch in batches:
            blocks = []
            for conv in batch.column("conv").to_pylist():
                if conv is None or conv != last or filled == most:
                    block, filled, last = block + 1, 0, conv
                filled += 1
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    order = ("conv", "turn", "text")
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order, "role").mapInArrow(number, T.StructType([T.StructField("block", T.LongType()), *rows.schema.fields])))


def _together(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "text", "role")


def _extents(blocks: DataFrame) -> DataFrame:
    """(conv, start, stop): the first and last block of each conversation."""
    return blocks.where("conv is not null").groupBy("conv").agg(F.min("block").alias("start"), F.max("block").alias("stop"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The messages of each block, from a stream that holds blocks one after another."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and (row["conv"], row["block"]) != (run[0]["conv"], run[0]["block"]):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _seen(run: list[dict], first: bool) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    features, split = observe([r["text"] for r in run], [first and k == 0 for k in range(len(run))])
    new = np.concatenate([np.arange(len(x)) == 0 for x in split])
    return features, new, split


def fit(turns: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Model:
    """Counts over all messages with a role of ROLES, smoothed by one; steps between blocks of a
    conversation, one in BLOCK_TURNS, are not counted. No such messages give even chances."""
    shapes = [(K,), (K, K), (K, K), *[(K, n) for n in SIZES]]
    ends = np.cumsum([0, *map(np.prod, shapes)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1], dtype=np.int64)
        views = [total[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes)]
        for run in _runs(batches):
            first = run[0]["conv"] is None or run[0]["block"] == run[0]["start"]
            features, new, split = _seen(run, first)
            roles = np.repeat([ROLES.index(r["role"]) for r in run], [len(x) for x in split])
            views[0][roles[0]] += first
            np.add.at(views[1], (roles[:-1][~new[1:]], roles[1:][~new[1:]]), 1)
            np.add.at(views[2], (roles[:-1][new[1:]], roles[1:][new[1:]]), 1)
            for table, column in zip(views[3:], features.T):
                np.add.at(table, (roles, column), 1)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], ["slot", "n"])

    known = dealt(turns.where(F.col(role).isin(*ROLES)), key, turn, text, role)
    known = _together(known.join(stored(_extents(known)), "conv", "left"))
    total = np.ones(ends[-1])
    marks = total[ends[3] : ends[4]].reshape(K, SIZES[0])
    marks[:, 1:] = 0.1
    marks[np.arange(K), np.arange(K) + 1] = MARKER_PRIOR
    for r in known.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[r.slot] += r.n
    logs = [np.log(x / x.sum(axis=-1, keepdims=True)) for x in (total[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes))]
    return Model(logs[0], logs[1], logs[2], tuple(logs[3:]))


def _borders(rows: DataFrame, model: Model, spanning: DataFrame) -> DataFrame:
    """(conv, block, entry, exit): roles before and at the end of each block of the conversations that
    have several, on the likeliest way through all of them."""
    kind = rows.schema["conv"]
    schema = pa.schema([("conv", to_arrow_type(kind.dataType)), ("block", pa.int64()), ("m", pa.list_(pa.float64()))])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            first = run[0]["block"] == run[0]["start"]
            features, new, _ = _seen(run, first)
            m = model.matrix(model.emissions(features), new, first).ravel().tolist()
            yield pa.RecordBatch.from_pylist([{"conv": run[0]["conv"], "block": run[0]["block"], "m": m}], schema)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        score, backs = None, []
        for m in table.column("m").to_pylist():
            m = np.array(m).reshape(K, K)
            ways = m if score is None else score[:, None] + m
            backs.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state, entry, out = int(score.argmax()), [], []
        for back in reversed(backs):
            out.append(state)
            state = int(back[state])
            entry.append(state)
        return pa.table([table.column("conv"), table.column("block"), pa.array(entry[::-1], pa.int32()), pa.array(out[::-1], pa.int32())], names=["conv", "block", "entry", "exit"])

    own = _together(rows.join(spanning, "conv"))
    steps = own.mapInArrow(through, T.StructType([kind, rows.schema["block"], T.StructField("m", T.ArrayType(T.DoubleType()))]))
    return steps.groupBy("conv").applyInArrow(chain, T.StructType([kind, rows.schema["block"], T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType())]))


def format_chats(turns: DataFrame, model: Model, key: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(key, turn, part, role, content, rendered): the canonical turns of every message of turns. Lines
    of one role in a row make a turn; markers go.

    Messages are ordered by turn and text; null turns come first; a message without a conversation is
    one of its own; null and empty messages give an empty turn; repeated rows each give their turns, as
    lines of one conversation; very long messages are read whole; an empty table gives an empty one;
    other columns of any name, roles among them, are not looked at. One task sees 9 numbers of each
    block of a conversation, and the messages of one block."""
    blocks = dealt(turns, key, turn, text)
    spanning = stored(_extents(blocks).where("start < stop").drop("stop"))
    rows = blocks.withColumns({"entry": F.lit(None).cast("int"), "exit": F.lit(None).cast("int")})
    if not spanning.isEmpty():
        borders = stored(_borders(blocks, model, spanning)).join(spanning, "conv")
        borders = stored(borders.withColumn("entry", F.when(F.col("block") > F.col("start"), F.col("entry"))).drop("start"))
        rows = blocks.join(borders, ["conv", "block"], "left")
    out = T.StructType([turns.schema[key], turns.schema[turn], T.StructField("part", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("role", "content", "rendered")]])

    kinds = [to_arrow_type(f.dataType) for f in out]

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def flush():
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], out.names)

        for run in _runs(batches):
            entry = run[0]["entry"]
            features, new, split = _seen(run, entry is None)
            roles = iter(model.best(model.emissions(features), new, entry, run[0]["exit"]))
            for row, lines in zip(run, split):
                parts: list[tuple[int, list[str]]] = []
                for line in lines:
                    r = next(roles)
                    bare = _MARK.sub("", line, count=1) if _MARK.match(line) else line
                    if not parts or parts[-1][0] != r:
                        parts.append((r, []))
                    parts[-1][1].append(bare.strip())
                for k, (r, own) in enumerate(parts):
                    content = "\n".join(own)
                    done.append((row["conv"], row["turn"], k, ROLES[r], content, f"<|im_start|>{ROLES[r]}\n{content}<|im_end|>"))
            if len(done) > 5_000:
                yield flush()
                done.clear()
        if done:
            yield flush()

    return _together(rows).select("conv", "block", "turn", "text", "entry", "exit").mapInArrow(run_, out)
