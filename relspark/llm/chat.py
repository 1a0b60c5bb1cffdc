"""Chat formatting: a hidden Markov model reads the roles of a transcript's lines, Viterbi decodes them, turns are rendered canonically.

States are the roles, each as the first line of a turn or as a later one. A line is observed through a few features: the role that its
speaker marker names (if any), whether it is empty, and whether the line before it was empty. Transitions and emissions are fixed
probabilities, stated below. A long transcript is decoded in blocks of lines: each block is first reduced to the best score from each
state to each state; these max-plus products compose, so a part of many blocks is one small matrix too. A transcript's parts fix the
states at their edges, a part's blocks those at theirs, and each block is then decoded by itself: the path is that of one decoding from
end to end, and no transcript is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import staged

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # role * 2 + (0: first line of a turn, 1: later line)
LINES, PIECE, PIECES, UNMARKED = 512, 256, 64, 8  # lines of a block, turns of a piece, pieces of a part, turns to one without a marker
SCALE, NEVER = 1e9, -(10**17)

# Speaker markers.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "customer", "prompter", "q", "you"],
    "assistant": ["assistant", "ai", "bot", "gpt", "answer", "agent", "model", "a"],
}
MARKER = re.compile(
    r"^\s*(?:<\|(?P<tag>\w+)\|>|\[(?P<square>\w+)\]|#{1,4}\s*(?P<hash>\w+)\s*:?\s*$|\*\*(?P<bold>\w+)\s*:?\*\*\s*:?|(?P<plain>\w+)\s*:)\s*", re.I
)
_role = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}

#: P(state | state before): a turn's later lines follow it; after a turn the other side speaks, seldom the same side again.
_next = np.array([[0.02, 0.93, 0.05], [0.02, 0.08, 0.90], [0.02, 0.90, 0.08]])
START = np.array([0.30, 1e-9, 0.65, 1e-9, 0.05, 1e-9])
STEP = np.zeros((STATES, STATES))
for _r in range(3):
    for _f in range(2):
        for _s in range(3):
            STEP[2 * _r + _f, 2 * _s] = 0.3 * _next[_r, _s]
            STEP[2 * _r + _f, 2 * _s + 1] = 0.7 if _s == _r else 1e-9


def _whole(p: np.ndarray) -> np.ndarray:
    """Log probabilities as whole numbers, so that sums do not depend on their order."""
    return np.round(np.log(p) * SCALE).astype(np.int64)


START, STEP = _whole(START), _whole(STEP)


def _emissions() -> np.ndarray:
    """log P(features | state) by marker (0 none, 1 + role, 4 unknown), empty line and line after an empty one."""
    out = np.zeros((5, 2, 2, STATES))
    for r in range(3):
        first = np.array([0.2, *(0.775 if m == r else 0.01 for m in range(3)), 0.005])
        later = np.array([0.955, *(0.01,) * 3, 0.015])
        for blank in range(2):
            for after in range(2):
                # Turns mostly begin after an empty line; so do some later paragraphs, which is for the lines around to decide.
                out[:, blank, after, 2 * r] = first * (0.02 if blank else 0.98) * (0.95 if after else 0.05)
                out[:, blank, after, 2 * r + 1] = later * (0.25 if blank else 0.75) * (0.2 if after else 0.8)
    return _whole(out)


EMIT = _emissions()


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1 + role, 4 unknown; where the line's own text begins)."""
    if not (m := MARKER.match(line)):
        return 0, 0
    role = _role.get(next(g for g in m.groups() if g is not None).lower())
    return (4, 0) if role is None else (role + 1, m.end())


def observe(lines: list[str], after: bool = False, first: int = 0) -> np.ndarray:
    """Log emissions of each line in each state; after: an empty line came before the first, which has the number `first`.

    Equally likely paths are told apart by a far smaller term set by line number and state, the same however lines are blocked.
    """
    out = np.empty((len(lines), STATES), np.int64)
    for i, line in enumerate(lines):
        blank = not line.strip()
        out[i] = EMIT[marker(line)[0], int(blank), int(after)]
        after = blank
    place = (np.uint64(first * STATES & 0xFFFFFFFFFFFFFFFF) + np.arange(len(lines) * STATES, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out + (place >> np.uint64(54)).astype(np.int64).reshape(len(lines), STATES)


def product(e: np.ndarray) -> np.ndarray:
    """Best scores from the state before a block to the state at its end."""
    m = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    for row in e:
        m = (m[:, :, None] + STEP[None]).max(1) + row
    return m


def decode(e: np.ndarray, entry: np.ndarray, last: int | None = None) -> list[int]:
    """Viterbi path of a block. entry: log scores of its first line's states before emission; last: the state it must end in."""
    score, back = entry + e[0], np.zeros((len(e), STATES), np.int64)
    for i in range(1, len(e)):
        s = score[:, None] + STEP
        back[i] = s.argmax(0)
        score = s.max(0) + e[i]
    path = [int(score.argmax()) if last is None else last]
    for i in range(len(e) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def _blocks(rows: DataFrame) -> DataFrame:
    """key, id, seq, l (lines) -> key, id, seq, block, first (line number), lines, after (an empty line came before): LINES lines each."""
    blocks = rows.select("key", "id", "seq", "l", F.explode(F.expr(f"sequence(0, cast((size(l) - 1) div {LINES} as int))")).alias("block"))
    # A piece ends with an empty line, so the first line of the next one comes after one.
    before = F.when(F.col("block") > 0, ~F.get("l", F.col("block") * LINES - 1).rlike(r"(?U)\S")).otherwise(F.col("seq") > 0)
    at = F.col("block") * LINES
    first = F.shiftleft("seq", 32) + at
    return blocks.select("key", "id", "seq", "block", first.alias("first"), F.slice("l", at + 1, LINES).alias("lines"), before.alias("after"))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of blocks; that of a transcript's first block starts from the start scores (each row the same)."""
    for b in batches:
        out = []
        for first, lines, after in zip(*(b.column(c).to_pylist() for c in ("first", "lines", "after")), strict=True):
            e = observe(lines, after, first)
            if first:
                m = product(e)
            else:
                score = START + e[0]
                for row in e[1:]:
                    score = (score[:, None] + STEP).max(0) + row
                m = np.tile(score, (STATES, 1))
            out.append(m.ravel().tolist())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "part", "seq", "block")), pa.array(out, pa.list_(pa.int64()))], names=["key", "part", "seq", "block", "m"])


def _composed(table: pa.Table) -> pa.Table:
    """One product for the blocks of a part of a transcript."""
    t = table.sort_by([("seq", "ascending"), ("block", "ascending")])
    whole = None
    for m in t.column("m").to_pylist():
        m = np.array(m).reshape(STATES, STATES)
        whole = m if whole is None else (whole[:, :, None] + m[None]).max(1)
    return pa.table({"key": t.column("key")[:1], "part": t.column("part")[:1], "m": pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))})


def _path(mats: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """States at the ends of a chain of blocks; enter: the state before it (-1: none, the first product starts by itself)."""
    score, back = mats[0][max(enter, 0)], []
    for m in mats[1:]:
        s = score[:, None] + m
        back.append(s.argmax(0))
        score = s.max(0)
    path = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _edges(table: pa.Table, order: list[str], enter: int, leave: int | None) -> pa.Table:
    t = table.sort_by([(c, "ascending") for c in order])
    path = _path([np.array(m).reshape(STATES, STATES) for m in t.column("m").to_pylist()], enter, leave)
    return pa.table({c: t.column(c) for c in ["key", *order]} | {"enter": pa.array([enter, *path[:-1]], pa.int32()), "leave": pa.array(path, pa.int32())})


def _over_parts(table: pa.Table) -> pa.Table:
    """States at the edges of a transcript's parts, one small matrix a part."""
    return _edges(table, ["part"], -1, None)


def _over_blocks(table: pa.Table) -> pa.Table:
    """States at the edges of a part's blocks, between the states that were found for the part's own edges."""
    ends = {c: table.column(c)[0].as_py() for c in ("enter", "leave")}
    return _edges(table.drop_columns(["enter", "leave"]), ["seq", "block"], **ends)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with enter and leave -> pieces of turns: key, id, seq, block, piece, fresh (it begins a turn), role, lines."""
    for b in batches:
        rows = []
        for i, (first, lines, after, enter, leave) in enumerate(zip(*(b.column(c).to_pylist() for c in ("first", "lines", "after", "enter", "leave")), strict=True)):
            entry = START if enter is None or enter < 0 else STEP[enter]
            path = decode(observe(lines, after, first), entry, leave)
            piece = -1
            for state, line in zip(path, lines, strict=True):
                if state % 2 == 0 or piece < 0:
                    piece += 1
                    rows.append([i, piece, state % 2 == 0, ROLES[state // 2], []])
                kind, at = marker(line)
                rows[-1][4].append(line[at:] if state % 2 == 0 and kind in (1, 2, 3) else line)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string())]
        at = pa.array(cols[0], pa.int64())
        held = ["key", "id", "seq", "block"]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in held), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=[*held, "piece", "fresh", "role", "lines"])


def _text(lines: Column) -> Column:
    """Lines as one text, without empty lines (blanks and tabs at most) at its edges."""
    def trimmed(l: Column) -> Column:
        full = F.transform(l, lambda x: F.ltrim(x, F.lit(" \t")) != "")

        def cut(f: Column) -> Column:
            begin = F.array_position(f, True).cast("int")
            size = F.size(f) - F.array_position(F.reverse(f), True).cast("int") + 2 - begin
            return F.when(begin > 0, F.array_join(F.slice(l, F.greatest(begin, F.lit(1)), F.greatest(size, F.lit(0))), "\n")).otherwise("")

        return F.transform(F.array(full), cut)[0]

    return F.transform(F.array(lines), trimmed)[0]


def parse(df: DataFrame, id_col: str = "conv_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """id, turn, role, text: the turns of each transcript, roles recovered, markers removed, empty lines at a turn's edges dropped.

    Each row is a transcript of its own, whatever its id. With order_col the rows of one id are pieces of one transcript, numbered 0 up
    there without a gap, each ending with an empty line; turns may run over pieces, and a transcript of any length is never gathered in
    one task. A null or empty transcript has one empty turn, of the role a transcript most likely starts with. An unmarked text is one
    turn. Other columns are not looked at; an empty table has no rows.
    """
    text = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\r?\n")
    key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")) if order_col else F.monotonically_increasing_id().cast("string")
    rows = df.select(key.alias("key"), F.col(id_col).alias("id"), (F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")).alias("seq"), text.alias("l"))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"key string, id {kind}, seq long, block int, piece int, fresh boolean, role string, lines array<string>"
    # Transcripts of one block are decoded as they come, each of their turns whole; only longer ones are chained.
    long_ = F.size("l") > LINES
    if order_col:
        many = staged(rows.where(long_ | (F.col("seq") > 0)).select("key").distinct(), "chat-long")
        short, rows = rows.join(many, "key", "left_anti"), rows.join(many, "key", "left_semi")
    else:
        short, rows = rows.where(~long_), rows.where(long_)
    short = _blocks(short).withColumns({"enter": F.lit(-1), "leave": F.lit(None).cast("int")}).mapInArrow(_decoded, made)
    short = short.select("id", F.col("piece").cast("long").alias("turn"), "role", _text(F.col("lines")).alias("text"))
    part = F.col("seq") / PIECES if order_col else F.col("block") / (PIECES * PIECES)
    blocks = staged(_blocks(rows).withColumn("part", F.floor(part)), "chat-blocks")
    # Block products are composed to one for each part; states are fixed at the edges of parts, then of blocks, then of lines.
    products = staged(blocks.mapInArrow(_reduced, "key string, part long, seq long, block int, m array<long>"), "chat-products")
    parts = products.groupBy("key", "part").applyInArrow(_composed, "key string, part long, m array<long>")
    parts = parts.groupBy("key").applyInArrow(_over_parts, "key string, part long, enter int, leave int")
    edges = products.join(parts, ["key", "part"]).groupBy("key", "part").applyInArrow(_over_blocks, "key string, seq long, block int, enter int, leave int")
    pieces = staged(blocks.join(edges, ["key", "seq", "block"]).mapInArrow(_decoded, made).withColumn("part", F.floor(part)), "chat-pieces")
    # Turns are numbered by the turns that earlier parts, earlier blocks of the part and earlier pieces of the block begin.
    begun = pieces.groupBy("key", "part", "seq", "block").agg(F.sum(F.col("fresh").cast("long")).alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = begun.groupBy("key", "part").agg(F.sum("n").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(earlier("key").orderBy("part")), F.lit(0)).alias("base"))
    base = begun.join(base, ["key", "part"]).select("key", "seq", "block", (F.col("base") + F.coalesce(F.sum("n").over(earlier("key", "part").orderBy("seq", "block")), F.lit(0))).alias("base"))
    own = F.sum(F.col("fresh").cast("long")).over(Window.partitionBy("key", "seq", "block").orderBy("piece"))
    turns = pieces.withColumn("own", own).join(base, ["key", "seq", "block"]).withColumn("turn", F.col("base") + F.col("own") - 1)
    # A turn can run over blocks; its pieces are put together again in order.
    whole = turns.groupBy("key", "turn").agg(F.first("id").alias("id"), F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("seq", "block", "piece", "lines"))).alias("p"))
    return short.unionByName(whole.select("id", "turn", "role", _text(F.flatten(F.transform("p", lambda x: x["lines"]))).alias("text")))


def render(turns: DataFrame) -> DataFrame:
    """Adds the canonical form of each turn: <|role|>, its text, <|end|>, a line each."""
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


#: Styles in which a transcript of the conversations table is written down before it is parsed: markers by role; None: no marker.
STYLES = [
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "[SYSTEM] ", "user": "Q: ", "assistant": "A: "},
    {"system": "**Context:** ", "user": "**Customer:** ", "assistant": "**Agent:** "},
]


def transcripts(conversations: DataFrame, piece: int = PIECE, unmarked: int = UNMARKED) -> DataFrame:
    """conv_id, seq, text: conversations written down as raw transcripts, in a style set by their id, in pieces of at most `piece` turns.

    Turns are taken in order of number (null: 0), role and text, and every repeated row is a turn. Every `unmarked`-th turn, neither
    first nor last of a piece, is written without a marker, as careless transcripts are. Null roles are written as user, null texts as
    empty, roles without a marker in the style as user. A null conv_id is a conversation like any other. No conversation is gathered in
    one task, only its pieces are. Other columns are not looked at; an empty table has no rows.
    """
    df = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = ranked(df, ["conv_id"], ["turn", "role", "text"], "place")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.element_at(F.create_map(*[x for i, s in enumerate(STYLES) for r, m in s.items() for x in (F.lit(f"{i}{r}"), F.lit(m))]), F.concat(style.cast("string"), "role"))
    df = df.select("conv_id", F.floor(F.col("place") / piece).alias("seq"), "place", F.coalesce(mark, F.lit("User: ")).alias("mark"), "text")
    rows = df.groupBy("conv_id", "seq").agg(F.sort_array(F.collect_list(F.struct("place", "mark", "text"))).alias("t"))

    def said(x: Column, i: Column) -> Column:
        bare = (F.pmod(x["place"] + F.xxhash64("conv_id"), F.lit(unmarked)) == 0) & (i > 0) & (i + 1 < F.size("t")) if unmarked else F.lit(False)
        return F.concat(F.when(bare, "").otherwise(x["mark"]), x["text"])

    return rows.select("conv_id", "seq", F.concat(F.array_join(F.transform("t", said), "\n\n"), F.lit("\n")).alias("text"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered: the conversations table through raw transcripts and back to canonical turns, roles recovered.

    Nulls, ties, repeated rows and empty tables are as for transcripts() and parse().
    """
    turns = render(parse(staged(transcripts(conversations), "chat-raw"), "conv_id", "text", "seq"))
    return turns.select(F.col("id").alias("conv_id"), "turn", "role", "rendered")
