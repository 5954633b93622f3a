"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

The words of all normalised items (lower-cased ASCII, words of letters, digits and non-ASCII
characters) are broadcast, and every Python worker builds their automaton once. Tasks stream the
words of each document through it and track the longest match that ends at every word: a match
of 13 words ends a window, and shorter items, which are one window each, are found on the suffix
links.

The benchmark is cut into shards of at most ``SHARD_WORDS`` words (an item of more is a shard of
its own), each with its own automaton. A stage streams documents through the automata of up to
``GROUP`` shards without a shuffle; where there are more, its result, with the hit spans so far,
is written to the shared folder for the next stage, and its broadcasts are dropped. So neither a
task nor the driver holds more than ``GROUP`` shards, however large the benchmark.

Cases: a null or empty text has no words and no hits; null or empty items have no windows;
repeated items count by their id once each; null item ids are left out of the list of ids; an
empty benchmark or table gives no hits; clashing input columns are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CHUNK_ROWS, materialize, other_columns, quoted

WINDOW = 13
#: A document is contaminated if this many times its hit words are no fewer than its words.
COVERAGE = 20
#: Item words of one automaton; a state takes about 300 bytes in Python.
SHARD_WORDS = 100_000
#: Shards whose automata a task holds at once.
GROUP = 4

_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class SuffixAutomaton:
    """Every factor of a set of word sequences, with the items whose windows a state ends."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        ends: list[list[tuple[int, int]]] = []
        for item, seq in items:
            last, path = 0, []
            for c in seq:
                last = self._extend(last, c)
                path.append(last)
            ends.append([(s, item) for s in path])
        #: Long items by the state that holds a window of theirs; short ones by (state, length).
        self.long: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for (item, seq), path in zip(items, ends):
            if len(seq) >= window:
                for s, _ in path[window - 1 :]:
                    self.long.setdefault(self._up(s, window), set()).add(item)
            elif seq:
                s = self._up(path[-1][0], len(seq))
                self.short.setdefault(s, {}).setdefault(len(seq), set()).add(item)
        #: The nearest state at or above each one that ends a short item, -1 if none.
        self.near = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.near[s] = s if s in self.short else (self.near[self.link[s]] if self.link[s] >= 0 else -1)
        self.least = min([len(q) for _, q in items if q], default=0)
        self.least = min(self.least, window)

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.len[known] == self.len[last] + 1:
                return known
            return self._split(last, known, c)
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _up(self, state: int, length: int) -> int:
        """The state on the suffix links that holds the suffix of this length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of occurring windows, in order of their ends, and the items found."""
        spans, found = [], set()
        state = size = 0
        nxt, link, length, window, near = self.next, self.link, self.len, self.window, self.near
        for at, c in enumerate(seq, 1):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                top = self._up(state, window)
                items = self.long.get(top)
                if items:
                    spans.append((at - window, at))
                    found |= items
            s = near[state]
            while s >= 0:
                for k, items in self.short[s].items():
                    if k <= size:
                        spans.append((at - k, at))
                        found |= items
                s = near[link[s]] if link[s] >= 0 else -1
        return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(words: list[bytes], vocabulary: dict[bytes, int], automaton: SuffixAutomaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged hit spans of a document and the items found.

    Only runs of known words that are as long as the shortest window can hold a match; others
    would leave the automaton in its start state and are not streamed.
    """
    least = automaton.least
    if not least or len(words) < least:
        return [], set()
    get = vocabulary.get
    ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
    spans, found = [], set()
    for a, b in edge.reshape(-1, 2).tolist():
        if b - a >= least:
            part, items = automaton.scan(ids[a:b].tolist())
            spans += [(a + x, a + y) for x, y in part]
            found |= items
    return _merged(spans), found


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items by shards of bounded size; the driver holds one shard at a time."""
    shard: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(quoted(item_col).cast("string").alias("i"), quoted(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        if shard and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row["i"], words))
        size += len(words)
    if shard:
        yield shard


#: Automata that this worker has built, with their items' names and vocabularies, by shard.
_BUILT: dict[str, tuple[list[str | None], dict[bytes, int], SuffixAutomaton]] = {}


def _built(key: str, box) -> tuple[list[str | None], dict[bytes, int], SuffixAutomaton]:
    if key not in _BUILT:
        while len(_BUILT) >= GROUP:
            _BUILT.pop(next(iter(_BUILT)))
        names, words, items = box.value
        _BUILT[key] = names, {w: k for k, w in enumerate(words)}, SuffixAutomaton([(i, seq.tolist()) for i, seq in items])
    return _BUILT[key]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (word positions) and ``item_ids`` (sorted) to every document."""
    added = ["n_words", "hit_spans", "item_ids"]
    kept = other_columns(docs, [*added, "__text"], keep)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    now = docs.select(*[quoted(c) for c in kept], quoted(text_col).cast("string").alias("__text"), F.lit(None).cast("bigint").alias("n_words"), F.array().cast(_SPANS).alias("hit_spans"), F.array().cast("array<string>").alias("item_ids"))
    schema = T.StructType([*now.schema.fields[: len(kept) + 1], *fields])
    arrow = to_arrow_schema(schema)
    context = docs.sparkSession.sparkContext

    def passing(shards: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = [_built(key, box) for key, box in shards]
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    part = batch.slice(at, CHUNK_ROWS)
                    counts, spans, items = [], [], []
                    old_spans, old_items = part.column(len(kept) + 2).to_pylist(), part.column(len(kept) + 3).to_pylist()
                    for text, was, had in zip(part.column(len(kept)).to_pylist(), old_spans, old_items):
                        words = words_of(text)
                        every, known = [(x["start"], x["end"]) for x in was], set(had)
                        for names, vocabulary, automaton in automata:
                            new, found = hits(words, vocabulary, automaton)
                            every += new
                            known |= {names[k] for k in found if names[k] is not None}
                        counts.append(len(words))
                        spans.append([{"start": a, "end": b} for a, b in _merged(every)])
                        items.append(sorted(known))
                    made = [pa.array(x, type=arrow.field(len(kept) + 1 + i).type) for i, x in enumerate((counts, spans, items))]
                    columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept) + 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *made], schema=arrow)

        return run

    group: list = []
    for shard in _shards(benchmark, item_col, item_text_col, shard_words):
        if len(group) == GROUP:
            now = materialize(now.mapInArrow(passing(group), schema), "decontaminated")
            for _, box in group:
                box.destroy()
            group = []
        names = sorted({i for i, _ in shard}, key=lambda i: (i is None, i or ""))
        index = {n: k for k, n in enumerate(names)}
        vocabulary: dict[bytes, int] = {}
        items = [(index[i], np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)) for i, words in shard]
        group.append((uuid.uuid4().hex, context.broadcast((names, list(vocabulary), items))))
    return now.mapInArrow(passing(group), schema)


def verdicts(scanned: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to scanned documents."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    out = scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("bigint"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what lies between them."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0])))).reshape(-1, 2)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : edge[a, 0]])
        at = int(edge[b - 1, 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars", coverage: int = COVERAGE) -> DataFrame:
    """Documents over the coverage limit go; matched windows are cut out of the others.

    The columns are those of ``docs``; ``chars_col``, if present, is counted anew for cut texts.
    """
    inner = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("__row"), quoted(text_col).cast("string").alias("__own"))
    found = verdicts(scan(inner, benchmark, "__own", keep=["__row", "__own"]), coverage).where("NOT contaminated")

    found = found.select("__row", F.col("__own").alias("__cut"), "hit_spans")
    schema = T.StructType(found.schema.fields[:2])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = [cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(texts, arrow.field(1).type)], schema=arrow)

    found = found.mapInArrow(cut, schema)
    columns = []
    for c in docs.columns:
        own = F.col("__row").getField(c)
        if c == text_col:
            own = F.col("__cut").cast(docs.schema[c].dataType)
        elif c == chars_col:
            own = F.when(F.col("__cut") == F.col("__row").getField(text_col).cast("string"), own).otherwise(F.length("__cut").cast(docs.schema[c].dataType))
        columns.append(own.alias(c))
    return found.select(*columns)
