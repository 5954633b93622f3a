"""Near-duplicates by SimHash fingerprints within a Hamming distance.

Fingerprints of 64 bits come from four-word shingles. All pairs of fingerprints within the
distance are covered by the generalised pigeonhole principle: the bits are dealt into
partitions, correlated bits together, every partition gets its own threshold, chosen by dynamic
programming on candidate counts estimated from a sample, and thresholds that sum to
``distance - partitions + 1`` (-1: the partition is not probed) guarantee that a linked pair
agrees within the threshold on some partition. Every row is probed, candidates are verified, and
links are contracted to components. Joins on a bucket, node, component or fingerprint that many
rows share leave these rows where they are (``join_spread``).

Exact copies share a fingerprint, so only distinct fingerprints are probed: a group of copies is
one row. Members of a bucket are not paired with each other in the plan: a bucket is cut into
blocks of bounded size, each task verifies one pair of blocks and returns a spanning forest of
its links, which has the components that all its links have.

Cases: a null or empty text has fingerprint zero, linked like any other; fewer than four words
make one shingle; a repeated row gets the same result as its twin; null ids are ignored as
representatives (a component of null ids only has a null component); an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, map_texts, materialize, quoted

BITS = 64
SHINGLE = 4
SEED = 42
#: Fingerprints sampled to estimate correlations and candidate counts.
SAMPLE = 4096
#: Members of a bucket that one side of a verifying task holds at most (in expectation).
BLOCK = 2048
#: Members of a group whose pairs are compared at once with those of other groups of its size.
TINY = 64
#: Comparisons of two fingerprints that one probe, which is written, shuffled and sorted, is worth.
PROBE_COST = 64
#: Word shingles hashed at once.
HASHED = 65536

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHED):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + HASHED], stops[at : at + HASHED])]
        rows = np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer, to every row."""

    def compute(texts: list[str | None]) -> dict[str, list]:
        return {"fp": [_signed(fingerprint(t)) for t in texts]}

    return map_texts(df, text_col, compute, [T.StructField("fp", T.LongType())], keep)


# --- the plan: partitions and thresholds --------------------------------------------------


def deal_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into ``parts`` groups of about equal size, correlated bits together.

    Each group grows from the free bit of the highest entropy by the free bit that correlates
    most with the group so far.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    corr = np.abs(centred.T @ centred) / max(1, len(sample))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = max(free, key=lambda b: (spread[b], -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def choose_plan(sample: np.ndarray, rows: int, distance: int, most_probes: int = 2048) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of least estimated cost for ``rows`` distinct fingerprints.

    For every number of partitions, the cost of a partition at a threshold is its probes a row,
    each at ``PROBE_COST``, plus the candidates that the sample's own pairs suggest, which keeps
    probes, and with them the shuffle, few until buckets are large; the thresholds are allocated by
    dynamic programming over partitions and what remains of the sum.
    """
    rng = np.random.default_rng(7)
    left = sample[rng.integers(0, len(sample), 20_000)]
    right = sample[rng.integers(0, len(sample), 20_000)]
    left, right = left[left != right], right[left != right]
    best: tuple[float, list] = (math.inf, [])
    for parts in range(1, distance + 2):
        groups = deal_bits(sample, parts)
        total = distance - parts + 1
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.bitwise_count((left ^ right) & mask)
            row = {-1: 0.0}
            for t in range(0, distance + 1):
                probes = _ball(len(g), t)
                if probes > most_probes:
                    break
                share = max((near <= t).mean() if len(near) else 0.0, probes / 2.0 ** len(g))
                row[t] = PROBE_COST * probes + rows * share
            costs.append(row)
        # table: what is left of the sum -> (cost, thresholds so far)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in table.items():
                for t, c in row.items():
                    key = spent + t
                    if key not in nxt or cost + c < nxt[key][0]:
                        nxt[key] = (cost + c, [*ts, t])
            table = nxt
        if total in table and table[total][0] < best[0]:
            best = (table[total][0], [(g, t) for g, t in zip(groups, table[total][1]) if t >= 0])
    return best[1]


def _gather(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group``, packed into the low end."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]


# --- links -----------------------------------------------------------------------------------


def _forest(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one, given twice)."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    out = []
    for i, x in zip(at_left.tolist(), left):
        for j in at_right[np.bitwise_count(right ^ x) <= distance].tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within ``distance``.

    Probing is asymmetric: a row stands once in its own bucket of a partition and, as a probe,
    in the buckets whose key is within the threshold.
    """
    n = distinct.count()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    if n < 2:
        return distinct.sparkSession.createDataFrame([], schema)
    fraction = min(1.0, SAMPLE / n)
    mark = F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30)) < int(fraction * (1 << 30))
    sample = np.array([r["fp"] for r in distinct.where(mark).collect()], dtype=np.int64).view(np.uint64)
    if len(sample) < 2:
        sample = np.array([r["fp"] for r in distinct.limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    plan = choose_plan(sample, n, distance)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "key", "fp", "probe"]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (group, t) in enumerate(plan):
                own = _gather(fps, group)
                for k, flip in enumerate(_flips(len(group), t)):
                    made = [np.full(len(fps), p, np.int32), (own ^ np.uint64(flip)).view(np.int64), fps.view(np.int64), np.full(len(fps), k > 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=names)

    placed = materialize(distinct.select("fp").mapInArrow(probe, "part int, key bigint, fp bigint, probe boolean"), "probes")
    # A bucket in which nothing is at home has only probes, which meet elsewhere: it is dropped with the lonely ones.
    sizes = placed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("probe")).cast("int")).alias("own"))
    sizes = materialize(sizes.where("n > 1 AND own > 0").select("part", "key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
    met = join_spread(placed, sizes, ["part", "key"], "n", placed.count())
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("part", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp", "probe")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                now, stop = held, len(held[0])
            else:
                now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                if not len(now[0]):
                    continue
                # The last group may go on in the next batch.
                last = np.logical_and.reduce([c == c[-1] for c in now[:4]])
                stop = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            held = [c[stop:] for c in now]
            if stop:
                found = _links_of_groups([c[:stop] for c in now], distance)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))], names=["a", "b"])

    keys = ["part", "key", "i", "j"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(verify, schema).where("a <> b").distinct()


def _links_of_groups(rows: list[np.ndarray], distance: int) -> np.ndarray:
    """Links within the groups of equal (part, key, i, j), which are contiguous.

    Groups of up to ``TINY`` members are compared all at once, by their size; larger ones, which
    hold at most about two blocks, give a spanning forest.
    """
    part, key, i, j, mine, fp, probe = rows
    fp = fp.view(np.uint64)
    change = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.concatenate(([0], np.flatnonzero(change) + 1))
    sizes = np.diff(np.append(starts, len(fp)))
    out = [np.zeros((0, 2), np.uint64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= TINY)]).tolist():
        groups = starts[sizes == size]
        left, right = np.triu_indices(size, 1)
        for at in range(0, len(groups), 1 + 1_000_000 // len(left)):
            members = fp[groups[at : at + 1 + 1_000_000 // len(left), None] + np.arange(size)]
            a, b = members[:, left], members[:, right]
            near = np.bitwise_count(a ^ b) <= distance
            out.append(np.stack([a[near], b[near]], axis=1))
    for at, size in zip(starts[sizes > TINY].tolist(), sizes[sizes > TINY].tolist()):
        own, first, home = fp[at : at + size], mine[at : at + size] == i[at], ~probe[at : at + size]
        if i[at] == j[at]:
            found = _forest(own[home], own, distance)
        else:
            found = _forest(own[first & home], own[~first], distance) + _forest(own[~first & home], own[first], distance)
        out.append(np.array(found, np.uint64).reshape(-1, 2))
    return np.concatenate(out)


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every linked fingerprint, the root being the least one of its component.

    Rounds of two contractions, each written to the shared folder: every node's larger
    neighbours, and then its smaller ones, are tied to the least one it knows. Rounds grow with
    the logarithm of the longest chain.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialize(least.select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = join_spread(both.where("v > u"), least, ["u"], "n", 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        tied = join_spread(large, least, ["u"], "n", large.count())
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u <> v").distinct(), "small")
        # Edges are distinct, so two tables of one size are equal if one has no edge of its own.
        was, size = size, nxt.count()
        done = was == size and nxt.join(now, ["u", "v"], "left_anti").isEmpty()
        now = nxt
        if done:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 4) -> DataFrame:
    """Every row's id with its ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least id that can be reached over links, the row's own included.
    """
    slim = docs.select(*{c: quoted(c) for c in (id_col, text_col)}.values())
    prints = materialize(fingerprints(slim, text_col, [id_col]), "fingerprints")
    known = _roots(prints, id_col, distance)
    best = known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    best = materialize(best, "components")
    mapped = join_spread(known.select("fp", "rows", "root"), best, ["root"], "prints", known.count()).select("fp", "rows", "component_id")
    mapped = materialize(mapped, "mapped")
    found = join_spread(prints, mapped, ["fp"], "rows", prints.count())
    return found.select(quoted(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, id_col: str, distance: int) -> DataFrame:
    """(fp, least_id, rows, root) of every distinct fingerprint, the root naming its component."""
    least = materialize(prints.groupBy("fp").agg(F.min(quoted(id_col)).alias("least_id"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = components(links(least.select("fp"), distance))
    known = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(known, "roots")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 4) -> DataFrame:
    """One row of every component, the one of the least id, with its own columns.

    Rows are told apart by id and a hash of the text of 128 bits, so that rows of one id and
    different texts stay or go each with its own component; rows that share both are one row.
    A row with a null id only stays if its component has no other ids.
    """
    text = quoted(text_col).cast("string")
    hashes = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}
    slim = docs.select(*{c: quoted(c) for c in (id_col, text_col)}.values(), *[h.alias(c) for c, h in hashes.items()])
    prints = materialize(fingerprints(slim, text_col, [id_col, *hashes]), "fingerprints")
    known = _roots(prints, id_col, distance)
    row = F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("__id"), *hashes)
    first = prints.groupBy("fp").agg(F.min(row).alias("row"))
    first = first.join(known.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    keep = materialize(first.select("row.__id", *[F.col(f"row.{c}").alias(f"{c}k") for c in hashes]), "kept")
    rows = docs.withColumns(hashes)
    same = (F.col("__h1") == F.col("__h1k")) & (F.col("__h2") == F.col("__h2k"))
    left = rows.join(keep, (quoted(id_col) == F.col("__id")) & same, "left_semi")
    twins = prints.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("__id"), *[F.col(c).alias(f"{c}k") for c in hashes]).count().where("count > 1").drop("count")
    if not twins.isEmpty():
        again = (quoted(id_col) == F.col("__id")) & same
        left = left.join(twins, again, "left_anti").unionByName(left.join(twins, again, "left_semi").dropDuplicates([id_col, *hashes]))
    if not prints.where(quoted(id_col).isNull()).isEmpty():
        nameless = rows.where(quoted(id_col).isNull()).dropDuplicates([*hashes])
        left = left.unionByName(nameless.join(keep.where("__id IS NULL"), same, "left_semi"))
    return left.drop(*hashes)
