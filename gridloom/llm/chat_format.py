"""Chat formatting: transcripts to canonical turns, with roles recovered by a hidden Markov model.

A transcript is the rows of one conversation in order; every row's text is read line by line. The
hidden state of a line is its role. A line shows a symbol: the speaker marker it begins with, if
any, whether it opens a row, its length, and whether it asks or holds code. Start, transition and
symbol probabilities are counted over all rows whose role is known, with add-one smoothing; the first
and the following turns of a conversation are so by their order, whatever their numbers are.

Conversations may be of any length, so none is gathered. Rows are ranged and sorted by
conversation and turn into partitions. Of a conversation that crosses partitions, each partition
first yields its best scores from state to state (a small max-plus matrix); the driver chains
those, at most two a partition, and a second pass decodes every partition with the scores that
enter and leave it, which gives the Viterbi path of the whole conversation.

Cases: null and empty texts are one empty line; null conversation ids are one conversation, null
turns come first, and rows of equal turn stay in the order of their text; repeated rows are turns
of their own; without known roles all probabilities are even and markers alone decide; an empty
table stays empty; columns beyond the named ones are carried along unless they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.operators.scans import numbered

from .common import other_columns, quoted, shared_dir

ROLES = ["system", "user", "assistant"]
# How transcripts name the three roles.
_NAMES = {
    "system": "system context instructions",
    "user": "user human question q customer prompter you me",
    "assistant": "assistant ai bot answer a agent model gpt chatgpt response",
}
_ROLE_OF = {n: k for k, r in enumerate(ROLES) for n in _NAMES[r].split()}
_MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*|>\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:\|>|\]\s*:?|\*\*\s*:?|:\s*(?:\*\*)?|$)\s*", re.IGNORECASE)
_END = re.compile(r"\s*<\|(?:im_)?end\|?>?\s*$", re.IGNORECASE)
_CODE = re.compile(r"```|^\s{4}\S|[{};]\s*$|^\s*(?:def|class|import|return)\b")
#: Symbols: marker (none or role) x opens a row x length (5) x question x code.
PER_MARKER = 2 * 5 * 2 * 2
SYMBOLS = 4 * PER_MARKER
#: How much more probable a marker is under the role that it names.
MARKER_ODDS = 200.0


def symbol(line: str, opens: bool) -> int:
    m = _MARKER.match(line)
    marker = 1 + _ROLE_OF[m[1].lower()] if m else 0
    size = sum(len(line) > n for n in (20, 80, 240, 800))
    return (((marker * 2 + opens) * 5 + size) * 2 + ("?" in line[-3:])) * 2 + (_CODE.search(line) is not None)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Hmm:
    """Log probabilities: first row's role, role after role at a new row, and symbols by role."""

    def __init__(self, first: np.ndarray, turn: np.ndarray, emit: np.ndarray):
        self.first, self.turn, self.emit = first, turn, emit

    def emission(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores by line and role, and which lines begin with a marker."""
        symbols = np.array([symbol(x, k == 0) for k, x in enumerate(lines_of(text))])
        return self.emit[symbols], symbols // PER_MARKER > 0

    def step(self, opens: bool, marked: bool) -> np.ndarray:
        """Scores from role to role between two lines: a role only changes at a row or a marker."""
        if opens:
            return self.turn
        return np.where(np.eye(3, dtype=bool), -0.7 if marked else 0.0, -1.4 if marked else -30.0)


def counted(df: DataFrame, conv_col: str, turn_col: str, text_col: str, role_col: str) -> Hmm:
    """The model counted from rows whose role is one of ``ROLES``."""
    known = df.where(quoted(role_col).isin(ROLES))
    role = F.array_position(F.array(*map(F.lit, ROLES)), quoted(role_col)).cast("int") - 1

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, SYMBOLS), np.int64)
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, line in enumerate(lines_of(text)):
                    sums[r, symbol(line, k == 0)] += 1
        r, s = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(sums[r, s])], names=["r", "s", "n"])

    seen = np.zeros((3, SYMBOLS))
    rows = known.select(role.alias("r"), quoted(text_col).cast("string").alias("t")).mapInArrow(symbols, "r bigint, s bigint, n bigint")
    for row in rows.groupBy("r", "s").agg(F.sum("n").alias("n")).collect():
        seen[row["r"], row["s"]] += row["n"]
    # Neighbouring turns meet by their ranks, whatever their numbers are; no conversation is sorted in one place.
    ends = known.select(quoted(conv_col).cast("string").alias("c"), quoted(turn_col).alias("k"), role.alias("r"))
    ranked = numbered(ends, ["c", "k", "r"])
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.struct("c").alias("b"), F.col("r").alias("q"))
    same = F.struct("c") == F.col("b")
    pairs = ranked.join(before, "rank", "left").select("r", F.when(same, F.col("q")).alias("q"))
    first, turn = np.ones(3), np.ones((3, 3))
    for x in pairs.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n")).collect():
        if x["q"] is None:
            first[x["r"]] += x["n"]
        else:
            turn[x["q"], x["r"]] += x["n"]
    return Hmm(np.log(first / first.sum()), np.log(turn / turn.sum(axis=1, keepdims=True)), np.log(emissions(seen)).T)


def emissions(seen: np.ndarray) -> np.ndarray:
    """Probabilities of symbols by role from their counts: whether a line has a marker, which one, and what else it shows.

    Markers are too few to be counted by name: a role's own one is ``MARKER_ODDS`` times as probable as another. What a line shows
    beside it is counted apart for lines with and without one. Each role's probabilities sum to one.
    """
    plain = seen[:, :PER_MARKER]
    marked = seen[:, PER_MARKER:].reshape(3, 3, PER_MARKER).sum(axis=1)
    has = (marked.sum(axis=1) + 1) / (seen.sum(axis=1) + 2)
    shows = lambda x: (x + 1) / (x + 1).sum(axis=1, keepdims=True)
    named = (1 + (MARKER_ODDS - 1) * np.eye(3)) / (MARKER_ODDS + 2)
    out = [(1 - has)[:, None] * shows(plain)]
    out += [(has * named[:, m])[:, None] * shows(marked) for m in range(3)]
    return np.hstack(out)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _transfer(model: Hmm, texts: list[str | None]) -> np.ndarray:
    """Best scores to the role of the last line, from each role before the first row; the fourth row: from none."""
    out: np.ndarray | None = None
    for text in texts:
        emit, marked = model.emission(text)
        for k in range(len(emit)):
            if out is None:
                out = np.vstack([model.turn, model.first]) + emit[k]
            else:
                out = _times(out, model.step(k == 0, bool(marked[k])) + emit[k])
    return out


def _decode(model: Hmm, texts: list[str | None], enter: np.ndarray | None, leave: np.ndarray) -> list[list[int]]:
    """Roles of every line, given the scores of the role before (None: none) and of what follows."""
    best, back, sizes = enter, [], []
    for text in texts:
        emit, marked = model.emission(text)
        sizes.append(len(emit))
        for k in range(len(emit)):
            if best is None:
                best = model.first + emit[k]
                back.append(np.zeros(3, int))
            else:
                reach = best[:, None] + model.step(k == 0, bool(marked[k]))
                back.append(reach.argmax(axis=0))
                best = reach.max(axis=0) + emit[k]
    state = int((best + leave).argmax())
    path = []
    for pointers in reversed(back):
        path.append(state)
        state = int(pointers[state])
    path.reverse()
    out, at = [], 0
    for n in sizes:
        out.append(path[at : at + n])
        at += n
    return out


def render(text: str | None, roles: list[int]) -> str:
    """Canonical turns of one row: a header for every run of lines of one role, without markers."""
    out, was = [], None
    for line, role in zip(lines_of(text), roles):
        m = _MARKER.match(line)
        if m and _ROLE_OF[m[1].lower()] == role:
            line = line[m.end() :]
            was = None
        line = _END.sub("", line)
        if role != was:
            out.append(f"<|{ROLES[role]}|>")
            was = role
        out.append(line)
    return "\n".join(out) + "\n<|end|>\n"


def _segments(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[tuple[pa.RecordBatch, int, int]]]:
    """Runs of rows of one conversation, as pieces (batch, from, to)."""
    held: list[tuple[pa.RecordBatch, int, int]] = []
    last: object = None
    for batch in batches:
        ids = batch.column(at).to_pylist()
        start = 0
        for k, c in enumerate(ids):
            if (held or k > start) and c != last:
                if k > start:
                    held.append((batch, start, k))
                yield held
                held, start = [], k
            last = c
        if len(ids) > start:
            held.append((batch, start, len(ids)))
    if held:
        yield held


def format_chats(df: DataFrame, model: Hmm | None = None, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Add ``role_found`` (of a row's first line), ``n_turns`` and ``rendered`` to every row.

    ``role_col`` is only counted from, never a feature of a row's own decoding.
    """
    model = model or counted(df, conv_col, turn_col, text_col, role_col)
    added = [T.StructField("role_found", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("rendered", T.StringType())]
    rest = other_columns(df, ["__conv", "__text", *(f.name for f in added)])
    slim = df.select(*[quoted(c) for c in rest], quoted(conv_col).cast("string").alias("__conv"), quoted(text_col).cast("string").alias("__text"))
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    order = [F.col("__conv"), quoted(turn_col), F.col("__text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    conv, text = len(rest), len(rest) + 1
    texts_of = lambda pieces: [t for b, x, y in pieces for t in b.column(text).slice(x, y - x).to_pylist()]
    id_of = lambda pieces: pieces[0][0].column(conv)[pieces[0][1]].as_py()

    def ends(index_and_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept: list[tuple] = []
        for k, pieces in enumerate(_segments(index_and_batches, conv)):
            kept[1:] = [(k, id_of(pieces), pieces)]
        rows = [(TaskContext.get().partitionId(), k, c, _transfer(model, texts_of(p)).ravel().tolist()) for k, c, p in kept]
        names = ["pid", "k", "conv", "m"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(4)], names=names)

    found = sorted(ranged.mapInArrow(ends, "pid bigint, k bigint, conv string, m array<double>").collect(), key=lambda r: (r["pid"], r["k"]))
    matrices = [np.array(r["m"]).reshape(4, 3) for r in found]
    enter: dict[int, np.ndarray] = {}
    leave: dict[int, np.ndarray] = {}
    for x in range(1, len(found)):
        a, b = found[x - 1], found[x]
        if a["pid"] != b["pid"] and a["conv"] == b["conv"]:
            begun = enter.get(a["pid"]) if a["k"] == 0 else None
            enter[b["pid"]] = matrices[x - 1][3] if begun is None else (begun[:, None] + matrices[x - 1][:3]).max(axis=0)
    for x in range(len(found) - 2, -1, -1):
        a, b = found[x], found[x + 1]
        if a["pid"] != b["pid"] and a["conv"] == b["conv"]:
            after = leave.get(b["pid"], np.zeros(3)) if (x + 2 >= len(found) or found[x + 2]["pid"] != b["pid"]) else np.zeros(3)
            leave[a["pid"]] = (matrices[x + 1][:3] + after).max(axis=1)
    schema = T.StructType([*slim.schema.fields[: len(rest)], *added])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        waiting, first = None, True
        for pieces in _segments(batches, conv):
            if waiting is not None:
                yield from write(waiting, enter.get(pid) if first else None, np.zeros(3))
                first = False
            waiting = pieces
        if waiting is not None:
            yield from write(waiting, enter.get(pid) if first else None, leave.get(pid, np.zeros(3)))

    def write(pieces: list, before: np.ndarray | None, after: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = texts_of(pieces)
        roles = _decode(model, texts, before, after)
        at = 0
        for batch, x, y in pieces:
            mine, own = roles[at : at + y - x], texts[at : at + y - x]
            at += y - x
            made = [[ROLES[r[0]] for r in mine], [1 + sum(a != b for a, b in zip(r, r[1:])) for r in mine], [render(t, r) for t, r in zip(own, mine)]]
            columns = [batch.column(i).slice(x, y - x).cast(arrow.field(i).type) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, arrow.field(len(rest) + i).type) for i, v in enumerate(made))], schema=arrow)

    return ranged.mapInArrow(decode, schema)

