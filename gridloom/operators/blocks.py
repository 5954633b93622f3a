"""Large matrices in square blocks: products, Cholesky, LU, triangular systems, refinement, exponential and root.

A ``Blocked`` is a table (p, q, x) of dense blocks, row-major, of ``block`` x ``block`` cells but for the last ones. Blocks that
are absent are zero. Matrices of any order are factorised panel by panel: a step factors one block column, and the
rest of the matrix meets it in two joins, by block row and by block column. Every step leaves one written table,
so that a lost executor costs the tasks it ran. What every task is told is one diagonal block; no cell reaches the driver.

LU does not move rows. Each panel's pivots are found by a tournament: every block names as many rows as the
panel is wide, and names meet by ``FAN_IN`` until one set remains. Rows that became pivots leave their blocks, the
others stay where they are, and the order of the pivots is a table. Where a pivot is zero, the rest of its column
is zero too, and so are its multipliers: singular matrices are factorised as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize
from gridloom.operators.matrix import Matrix

#: Rows and columns of a block, and of the largest one that ``side`` chooses.
BLOCK, MOST_BLOCK = 256, 1024
#: Rows and columns of a product that one task adds up.
TILE = 4096
#: Parts along a side of a product whose blocks meet in pairs.
PARTS = 64
#: Sets of pivot rows that meet in one task.
FAN_IN = 8

_SCHEMA = "p bigint, q bigint, x array<double>"
#: Runs of cells along rows.
RUNS = "i bigint, j bigint, x array<double>"


def side(order: int) -> int:
    """The block for factors of a square matrix: every panel writes what remains anew, so that larger matrices have wider ones."""
    block = BLOCK
    while block < MOST_BLOCK and order > 4 * block:
        block *= 2
    return block


def _array(column: pa.ListArray, row: int, width: int, dtype: type = float) -> np.ndarray:
    """The block in one row of a column."""
    return np.asarray(column[row].values.to_numpy(zero_copy_only=False), dtype=dtype).reshape(-1, width) if width else np.zeros((0, 0))


def _row(schema: Sequence[str], *values) -> pa.RecordBatch:
    """One row; arrays become lists."""
    made = [pa.array([v.ravel()], pa.list_(pa.from_numpy_dtype(v.dtype))) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values]
    return pa.RecordBatch.from_arrays(made, names=list(schema))


def _cells(p: int, q: int, x: np.ndarray, block: int) -> pa.RecordBatch:
    """The cells (i, j, v) of one block."""
    i, j = np.indices(x.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel() + p * block), pa.array(j.ravel() + q * block), pa.array(x.ravel())], names=["i", "j", "v"])


#: Rows of a task's first block whose cells are told one by one, see ``_lines``.
FIRST = 256


def _lines(p: int, q: int, x: np.ndarray, block: int, first: bool) -> Iterator[pa.RecordBatch]:
    """(i, j, x): the cells of one block as runs along rows, from (i, j) on, which ``spread`` makes cells.

    Parquet writers decide by a file's first values whether a dictionary pays. Rounded products repeat, but not yet among a few thousand
    rows, so that the cells of a task's first rows come one by one, the middle values first.
    """

    def runs(i: np.ndarray, j: np.ndarray, offsets: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v))], names=["i", "j", "x"])

    ahead = x[: FIRST if first else 0]
    if ahead.size:
        order = np.argsort(np.abs(ahead - np.median(ahead)), axis=None, kind="stable")
        i, j = np.divmod(order, x.shape[1])
        yield runs(i + p * block, j + q * block, np.arange(len(order) + 1), ahead.ravel()[order])
    rest = x[len(ahead) :]
    if rest.size:
        yield runs(np.arange(len(ahead), len(x)) + p * block, np.full(len(rest), q * block), np.arange(len(rest) + 1) * x.shape[1], rest.ravel())


def spread(runs: DataFrame) -> DataFrame:
    """The cells of runs along rows."""
    return runs.select("i", "j", F.posexplode("x").alias("at", "v")).select("i", (F.col("j") + F.col("at")).alias("j"), "v")


def _value(x: pa.Scalar):
    if not x.is_valid:
        return None
    return x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x.as_py()


def each(df: DataFrame, columns: Sequence[str], f: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``f(p, q, …)`` of the values in ``columns`` for every row: integers, and columns of lists with their row's place."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for made in f(*[_value(c[k]) for c in batch.columns]):
                    yield _row(names, *made)

    return df.select(*columns).mapInArrow(run, schema)


@dataclass(frozen=True)
class Blocked:
    df: DataFrame
    m: int
    n: int
    block: int = BLOCK

    # --- to and from cells ---

    @classmethod
    def of(cls, a: Matrix, block: int = BLOCK) -> Blocked:
        """From cells, or from rows where they are at hand; a block's cells meet in one task. Absent cells are zero."""
        m, n = a.shape
        if a.untransposed is not None and a.untransposed.packed is not None and m <= block:
            return cls.of(a.untransposed, block).T()
        if a.packed is not None and n <= block:
            rows = a.packed.groupBy(F.floor(F.col("i") / block).cast("bigint").alias("p")).agg(F.collect_list(F.struct((F.col("i") % block).cast("int").alias("r"), "r")).alias("x"))

            def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        own, p = batch.column(1)[k].values, batch.column(0)[k].as_py()
                        lists = own.field(1)
                        if set(lists.value_lengths().to_pylist()) != {n}:
                            raise ValueError("rows of another length than the matrix is wide")
                        out = np.zeros((min(block, m - p * block), n))
                        out[own.field(0).to_numpy()] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                        yield _row(("p", "q", "x"), p, 0, out)

            return cls(rows.mapInArrow(stacked, _SCHEMA), m, n, block)
        at = lambda c: F.floor(F.col(c) / block).cast("bigint")
        inner = F.struct((F.col("i") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), "v")
        cells = a.df.groupBy(at("i").alias("p"), at("j").alias("q")).agg(F.collect_list(inner).alias("x"))

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    p, q, own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                    out = np.zeros((min(block, m - p * block), min(block, n - q * block)))
                    out[own.field(0).to_numpy(), own.field(1).to_numpy()] = own.field(2).to_numpy(zero_copy_only=False)
                    yield _row(("p", "q", "x"), p, q, out)

        return cls(cells.mapInArrow(dense, _SCHEMA), m, n, block)

    def to_matrix(self) -> Matrix:
        """Cells; those of absent blocks are absent."""
        block, width = self.block, self.width

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    p, q = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    yield _cells(p, q, _array(batch.column(2), k, width(q)), block)

        return Matrix(self.df.mapInArrow(cells, "i bigint, j bigint, v double"), self.m, self.n)

    # --- shape ---

    @property
    def width(self) -> Callable[[int], int]:
        """Columns of a block column."""
        n, block = self.n, self.block
        return lambda q: min(block, n - q * block)

    @property
    def height(self) -> Callable[[int], int]:
        m, block = self.m, self.block
        return lambda p: min(block, m - p * block)

    @property
    def rows(self) -> int:
        return -(-self.m // self.block)

    @property
    def columns(self) -> int:
        return -(-self.n // self.block)

    def filled(self) -> Blocked:
        """With blocks of zeros where there are none."""
        every = self.df.sparkSession.range(self.rows * self.columns).select(F.floor(F.col("id") / self.columns).cast("bigint").alias("p"), (F.col("id") % self.columns).alias("q"))
        length = lambda at, n: F.least(F.lit(self.block), F.lit(n) - F.col(at) * self.block)
        zeros = F.array_repeat(F.lit(0.0), (length("p", self.m) * length("q", self.n)).cast("int"))
        absent = every.join(self.df.select("p", "q"), ["p", "q"], "left_anti").select("p", "q", zeros.alias("x"))
        return Blocked(self.df.unionByName(absent), self.m, self.n, self.block)

    def written(self, label: str = "blocks") -> Blocked:
        return Blocked(materialize(self.df, label), self.m, self.n, self.block)

    # --- by block ---

    def T(self) -> Blocked:  # noqa: N802
        width = self.width
        return Blocked(each(self.df, ["p", "q", "x"], lambda p, q, x: [(q, p, np.ascontiguousarray(x.reshape(-1, width(q)).T))], _SCHEMA), self.n, self.m, self.block)

    def turned(self, by: int) -> Blocked:
        """Columns moved ``by`` places to the right, those at the end to the front; a block's columns go to two blocks or three."""
        n, block, width, height = self.n, self.block, self.width, self.height

        def split(p, q, x):
            places = (np.arange(width(q)) + q * block + by) % n
            for to in np.unique(places // block).tolist():
                hit = places // block == to
                yield p, int(to), (places[hit] % block).astype(np.int64), np.ascontiguousarray(x.reshape(-1, width(q))[:, hit].T)

        def joined(p, q, at, x):
            out = np.zeros((height(p), width(q)))
            out[:, at] = x.reshape(len(at), -1).T
            return [(p, q, out)]

        pieces = each(self.df, ["p", "q", "x"], split, "p bigint, q bigint, at array<bigint>, x array<double>")
        met = pieces.groupBy("p", "q").agg(F.collect_list(F.struct("at", "x")).alias("m"))
        met = met.select("p", "q", F.flatten(F.transform("m", lambda m: m["at"])).alias("at"), F.flatten(F.transform("m", lambda m: m["x"])).alias("x"))
        return Blocked(each(met, ["p", "q", "at", "x"], joined, _SCHEMA), self.m, n, block)

    def scaled(self, k: float) -> Blocked:
        return Blocked(self.df.select("p", "q", F.transform("x", lambda v: v * float(k)).alias("x")), self.m, self.n, self.block)

    def add(self, o: Blocked, k: float = 1.0) -> Blocked:
        """A + k·B."""
        if (self.m, self.n, self.block) != (o.m, o.n, o.block):
            raise ValueError("blocks of other shapes")
        both = self.df.join(o.df.withColumnRenamed("x", "y"), ["p", "q"], "full")
        sums = F.zip_with("x", "y", lambda a, b: a + b * float(k))
        x = F.when(F.col("y").isNull(), F.col("x")).when(F.col("x").isNull(), F.transform("y", lambda b: b * float(k))).otherwise(sums)
        return Blocked(both.select("p", "q", x.alias("x")), self.m, self.n, self.block)

    def plus_diagonal(self, k: float) -> Blocked:
        """A + k·I; blocks of the diagonal must be present."""
        width = F.least(F.lit(self.block), F.lit(self.n) - F.col("q") * self.block).cast("int")
        x = F.when(F.col("p") == F.col("q"), F.transform("x", lambda v, at: F.when(at % (width + 1) == 0, v + float(k)).otherwise(v))).otherwise(F.col("x"))
        return Blocked(self.df.select("p", "q", x.alias("x")), self.m, self.n, self.block)

    # --- products ---

    def multiply(self, o: Blocked) -> Blocked:
        """A·B. A small factor is sent to the other's blocks. Where the inner side is one block, tasks read pairs of blocks, and nothing
        is copied on disk. Otherwise a task adds up one tile of the product: both factors are copied once for every tile along the
        other's side, and no partial product is shuffled.
        """
        if self.n != o.m or self.block != o.block:
            raise ValueError(f"product of shapes {(self.m, self.n)} and {(o.m, o.n)}")
        if self._paired(o):
            return Blocked(self._by_pairs(o, lambda p, q, x, first: [_row(("p", "q", "x"), p, q, x)], _SCHEMA), self.m, o.n, self.block)
        if not _small(self.m * self.n if self.m <= o.n else o.m * o.n):
            return self._by_tiles(o)
        left = self.df.select("p", F.col("q").alias("k"), F.col("x").alias("a"))
        right = o.df.select(F.col("p").alias("k"), "q", F.col("x").alias("b"))
        both = right.join(F.broadcast(left), "k") if self.m <= o.n else left.join(F.broadcast(right), "k")
        inner, outer = self.width, o.width
        made = each(both, ["p", "q", "k", "a", "b"], lambda p, q, k, a, b: [(p, q, a.reshape(-1, inner(k)) @ b.reshape(-1, outer(q)))], _SCHEMA)
        return Blocked(made if self.columns == 1 else summed(made), self.m, o.n, self.block)

    def _paired(self, o: Blocked) -> bool:
        return self.columns == 1 and not _small(self.m * self.n if self.m <= o.n else o.m * o.n)

    def _by_pairs(self, o: Blocked, made: Callable[[int, int, np.ndarray, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """One inner block: every pair of blocks is a block of the product, of which rows are ``made``, told whether it is a task's first. Both factors are shuffled once into
        parts of a tile's side, and each task fetches one part of either, so that disk follows the factors and not the product.
        """
        inner, outer, t = self.width(0), o.width, max(1, min(TILE // self.block, -(-max(self.rows, o.columns) // 4)))
        parts = lambda n: max(1, min(-(-n // t), PARTS))
        left = self.df.select("p", F.col("x").alias("a")).repartition(parts(self.rows), "p")
        right = o.df.select("q", F.col("x").alias("b")).repartition(parts(o.columns), "q")
        both = left.crossJoin(right.hint("shuffle_replicate_nl")).select("p", "q", "a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = True
            for batch in batches:
                for k in range(batch.num_rows):
                    p, q = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    yield from made(p, q, _array(batch.column(2), k, inner) @ _array(batch.column(3), k, outer(q)), first)
                    first = False

        return both.mapInArrow(run, schema)

    def product_cells(self, o: Blocked) -> Matrix:
        """A·B as cells; where blocks meet in pairs, the task that multiplies them makes their cells."""
        paired = self._paired(o) or self.columns == 1 and min(self.rows, o.columns) > 1 and not _small(self.m * o.n)
        if self.n != o.m or self.block != o.block or not paired:
            return self.multiply(o).to_matrix()
        block = self.block
        lines = _lines
        return Matrix(spread(self._by_pairs(o, lambda p, q, x, first: lines(p, q, x, block, first), RUNS)), self.m, o.n)

    def _by_tiles(self, o: Blocked) -> Blocked:
        """Blocks of both factors come by inner index; a task holds those of one index, and the blocks of one tile of the product."""
        # Blocks along a tile's side: at least four tiles along each side of the product, for as many tasks.
        t = max(1, min(TILE // self.block, -(-max(self.rows, o.columns) // 4)))
        down, along, inner, outer = -(-self.rows // t), -(-o.columns // t), self.width, o.width
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        of = lambda c: F.floor(F.col(c) / t).cast("bigint")
        left = self.df.select(of("p").alias("tp"), every(along).alias("tq"), F.col("q").alias("k"), F.lit(0).cast("bigint").alias("side"), F.col("p").alias("at"), "x")
        right = o.df.select(every(down).alias("tp"), of("q").alias("tq"), F.col("p").alias("k"), F.lit(1).cast("bigint").alias("side"), F.col("q").alias("at"), "x")
        met = left.unionByName(right).repartition(min(2 * down * along, 4096), "tp", "tq").sortWithinPartitions("tp", "tq", "k", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, index, held, total = None, None, {}, {}
            for batch in batches:
                for r in range(batch.num_rows):
                    tp, tq, k, side_, at = (batch.column(c)[r].as_py() for c in range(5))
                    if (tp, tq) != tile:
                        for (p, q), x in total.items():
                            yield _row(("p", "q", "x"), p, q, x)
                        tile, index, total = (tp, tq), None, {}
                    if k != index:
                        index, held = k, {}
                    x = _array(batch.column(5), r, outer(at) if side_ else inner(k))
                    if not side_:
                        held[at] = x
                        continue
                    for p, a in held.items():
                        total[p, at] = total[p, at] + a @ x if (p, at) in total else a @ x
            for (p, q), x in total.items():
                yield _row(("p", "q", "x"), p, q, x)

        return Blocked(met.mapInArrow(run, _SCHEMA), self.m, o.n, self.block)


#: Cells of a factor that Spark may send to every task instead of copying it to where it is needed; 8 MB.
SMALL = 1024 * 1024


def _small(cells: int) -> bool:
    return cells <= SMALL


def summed(df: DataFrame) -> DataFrame:
    """Blocks of the same place added up: sums of a task's own first, then one row a block and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                at, x = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                if at == held:
                    total = total + x
                else:
                    if held is not None:
                        yield _row(("p", "q", "x"), *held, total)
                    held, total = at, x
        if held is not None:
            yield _row(("p", "q", "x"), *held, total)

    return df.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(run, _SCHEMA)


# --- small factors inside a block -----------------------------------------------------------------


def _lu_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows, L below and U on and above the diagonal) with partial pivoting, for x of any shape.

    Wide ones by halves: the left one's rows are the order of the right one, which meets it in one product.
    """
    if min(x.shape) > 64:
        half = min(x.shape) // 2
        order, left = _lu_rows(x[:, :half])
        right = x[order, half:]
        right[:half] = np.linalg.solve(_unit_lower(left[:half]), right[:half])
        right[half:] -= left[half:] @ right[:half]
        then, low = _lu_rows(right[half:])
        left[half:] = left[half:][then]
        order[half:] = order[half:][then]
        return order, np.hstack([left, np.vstack([right[:half], low])])
    x, order = x.copy(), np.arange(len(x))
    for k in range(min(x.shape)):
        at = k + int(np.abs(x[k:, k]).argmax())
        if at != k:
            x[[k, at]], order[[k, at]] = x[[at, k]], order[[at, k]]
        if x[k, k] != 0:
            x[k + 1 :, k] /= x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
    return order, x


def _over_upper(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """X·U⁻¹; columns of a zero pivot become zero."""
    d = np.diag(u)
    if d.all():
        return np.linalg.solve(u.T, x.T).T
    out = x.copy()
    for k in range(len(u)):
        out[:, k] = (out[:, k] - out[:, :k] @ u[:k, k]) / d[k] if d[k] else 0.0
    return out


def _unit_lower(lu: np.ndarray) -> np.ndarray:
    return np.tril(lu, -1) + np.eye(len(lu))


def _guarded(run: Callable[[], Blocked], what: str) -> Blocked:
    try:
        return run()
    except PythonException as e:
        if "LinAlgError" in str(e):
            raise np.linalg.LinAlgError(what) from None
        raise


# --- Cholesky -------------------------------------------------------------------------------------


def cholesky(a: Blocked, single: bool = False) -> Blocked:
    """L with L·Lᵀ = A, whose lower blocks are read; A must be positive definite.

    ``single`` keeps the factor's numbers to single precision.
    """
    if a.m != a.n:
        raise ValueError("Cholesky of a matrix that is not square")
    kind = np.float32 if single else np.float64
    width, rest, panels = a.width, a.filled().df.where("p >= q"), []

    def panel(k: int) -> Callable:
        def f(p, x, d):
            w = width(k)
            low = np.linalg.cholesky(d.reshape(w, w).astype(kind))
            own = low if p == k else np.linalg.solve(low, x.reshape(-1, w).astype(kind).T).T
            return [(p, k, own.astype(float))]

        return f

    for k in range(a.columns):
        column = rest.where(F.col("q") == k)
        pivot = column.where(F.col("p") == k).select("q", F.col("x").alias("d"))
        made = each(column.join(F.broadcast(pivot), "q"), ["p", "x", "d"], panel(k), _SCHEMA)
        panels.append(_guarded(lambda m=made: Blocked(m, a.m, a.n, a.block).written("cholesky-panel"), "not positive definite").df)
        if k + 1 < a.columns:
            side = lambda name, key, df=panels[-1]: df.select(F.col("p").alias(key), F.col("x").alias(name))
            met = rest.where(F.col("q") > k).join(side("l", "p"), "p").join(side("r", "q"), "q")
            w = width(k)
            update = lambda p, q, x, l, r, w=w: [(p, q, x - (l.reshape(-1, w).astype(kind) @ r.reshape(-1, w).astype(kind).T).ravel())]
            rest = materialize(each(met, ["p", "q", "x", "l", "r"], update, _SCHEMA), "cholesky-rest")
    return Blocked(_union(panels), a.m, a.n, a.block)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- LU -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LU:
    """P·A = L·U. ``order`` has (pos, row): which row of A became the pivot of each position."""

    lower: Blocked
    upper: Blocked
    order: DataFrame

    def permuted(self, b: Blocked) -> Blocked:
        """P·B: rows find their positions, a block's rows meet in one task."""
        block, height, width = b.block, b.height, b.width

        def split(p, q, x, rows, places):
            x = x.reshape(-1, width(q))
            for to in np.unique(places // block).tolist():
                hit = places // block == to
                yield int(to), q, (places[hit] % block).astype(np.int64), x[rows[hit] % block].astype(float)

        moves = self.order.groupBy(F.floor(F.col("row") / block).cast("bigint").alias("p")).agg(F.collect_list(F.struct("row", "pos")).alias("m"))
        moves = moves.select("p", F.transform("m", lambda m: m["row"]).alias("rows"), F.transform("m", lambda m: m["pos"]).alias("places"))
        pieces = each(b.df.join(moves, "p"), ["p", "q", "x", "rows", "places"], split, "p bigint, q bigint, at array<bigint>, x array<double>")

        def joined(p, q, at, x):
            w = width(q)
            out = np.zeros((height(p), w))
            out[at] = x.reshape(-1, w)
            return [(p, q, out)]

        whole = pieces.groupBy("p", "q").agg(F.collect_list(F.struct("at", "x")).alias("m"))
        whole = whole.select("p", "q", F.flatten(F.transform("m", lambda m: m["at"])).alias("at"), F.flatten(F.transform("m", lambda m: m["x"])).alias("x"))
        return Blocked(each(whole, ["p", "q", "at", "x"], joined, _SCHEMA), b.m, b.n, b.block)


def _tournament(panel: DataFrame, k: int, w: int) -> DataFrame:
    """(k, rows, lu): the panel's w pivots in order, and their factors, as one written row."""

    def names(p, rows, x):
        order, _ = _lu_rows(x.reshape(-1, w))
        best = order[:w]
        return [(p // FAN_IN, rows[best], x.reshape(-1, w)[best])]

    schema = "p bigint, rows array<bigint>, x array<double>"
    level = materialize(each(panel, ["p", "rows", "x"], names, schema), "lu-names")
    while (level.agg(F.max("p")).first()[0] or 0) > 0:
        level = materialize(each(_met(level), ["p", "rows", "x"], names, schema), "lu-names")

    def last(p, rows, x):
        order, lu = _lu_rows(x.reshape(-1, w))
        return [(k, rows[order[:w]], lu[:w])]

    return materialize(each(_met(level), ["p", "rows", "x"], last, "k bigint, rows array<bigint>, lu array<double>"), "lu-pivots")


def _met(level: DataFrame) -> DataFrame:
    """At most FAN_IN sets of names as one row."""
    held = level.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("rows", "x"))).alias("m"))
    return held.select("p", F.flatten(F.transform("m", lambda m: m["rows"])).alias("rows"), F.flatten(F.transform("m", lambda m: m["x"])).alias("x"))


def lu(a: Blocked, single: bool = False) -> LU:
    """LU with tournament pivoting of a square matrix; see the module."""
    if a.m != a.n:
        raise ValueError("LU of a matrix that is not square")
    a = a.filled().written()
    kind, block, width, height = np.float32 if single else np.float64, a.block, a.width, a.height
    here = F.sequence(F.col("p") * block, F.least(F.col("p") * block + block, F.lit(a.m)) - 1)
    rest = a.df.select("p", "q", here.alias("rows"), "x")
    lowers, uppers, orders = [], [], []
    schema = "p bigint, q bigint, rows array<bigint>, x array<double>"

    for k in range(a.columns):
        w = width(k)
        column, others = rest.where(F.col("q") == k), rest.where(F.col("q") > k)
        pivots = _tournament(column.select("p", "rows", "x"), k, w)
        told = pivots.select(F.col("rows").alias("pivots"), "lu", F.lit(1).alias("one"))
        orders.append(pivots.select(F.posexplode("rows").alias("pos", "row")).select((F.col("pos") + k * block).cast("bigint").alias("pos"), "row"))

        def below(p, rows, x, chosen, lu_, k=k, w=w):
            """Multipliers: of the rows that stay, X·U⁻¹; of pivots, the rows of L."""
            u = np.triu(lu_.reshape(w, w)).astype(kind)
            out = _over_upper(x.reshape(-1, w).astype(kind), u).astype(float)
            place = {r: s for s, r in enumerate(chosen.tolist())}
            low = _unit_lower(lu_.reshape(w, w))
            for s, r in enumerate(rows.tolist()):
                if r in place:
                    out[s] = low[place[r]]
            return [(p, k, rows, out)]

        left = materialize(each(column.withColumn("one", F.lit(1)).join(F.broadcast(told), "one"), ["p", "rows", "x", "pivots", "lu"], below, schema), "lu-lower")
        lowers.append(left)
        diagonal = each(pivots, ["k", "lu"], lambda k, x, w=w: [(k, k, np.triu(x.reshape(w, w)))], _SCHEMA)
        if k + 1 == a.columns:
            uppers.append(diagonal)
            break

        def taken(p, q, rows, x, chosen):
            """The pivot rows of a block."""
            keep = np.isin(rows, chosen)
            if keep.any():
                yield q, rows[keep], x.reshape(-1, width(q))[keep]

        pieces = each(others.withColumn("one", F.lit(1)).join(F.broadcast(told.select("one", "pivots")), "one"), ["p", "q", "rows", "x", "pivots"], taken, "q bigint, rows array<bigint>, x array<double>")
        met = pieces.groupBy("q").agg(F.collect_list(F.struct("rows", "x")).alias("m"))
        met = met.select("q", F.flatten(F.transform("m", lambda m: m["rows"])).alias("rows"), F.flatten(F.transform("m", lambda m: m["x"])).alias("x"), F.lit(1).alias("one"))

        def across(q, rows, x, chosen, lu_, k=k, w=w):
            """U = L⁻¹ · pivot rows, in the order of the pivots."""
            at = np.argsort(rows)[np.searchsorted(np.sort(rows), chosen)]
            return [(k, q, np.linalg.solve(_unit_lower(lu_.reshape(w, w)).astype(kind), x.reshape(-1, width(q))[at].astype(kind)).astype(float))]

        right = materialize(each(met.join(F.broadcast(told), "one"), ["q", "rows", "x", "pivots", "lu"], across, _SCHEMA), "lu-upper")
        uppers += [diagonal, right]

        def update(p, q, rows, x, l, u, chosen, w=w):
            stay = ~np.isin(rows, chosen)
            if stay.any():
                made = x.reshape(-1, width(q))[stay] - l.reshape(-1, w)[stay].astype(kind) @ u.reshape(w, -1).astype(kind)
                yield p, q, rows[stay], made.astype(float)

        both = others.withColumn("one", F.lit(1)).join(left.select("p", F.col("x").alias("l")), "p").join(right.select("q", F.col("x").alias("u")), "q").join(F.broadcast(told.select("one", "pivots")), "one")
        rest = materialize(each(both, ["p", "q", "rows", "x", "l", "u", "pivots"], update, schema), "lu-rest")

    order = materialize(_union(orders), "lu-order")
    return LU(_in_order(_union(lowers), order, a), Blocked(_union(uppers), a.m, a.n, block), order)


def _in_order(rows: DataFrame, order: DataFrame, a: Blocked) -> Blocked:
    """Rows of L, each with its own number, in the order of the pivots; entries to the right of a row's own panel are absent."""
    block, height, width = a.block, a.height, a.width
    cut = order.select(F.floor(F.col("row") / block).cast("bigint").alias("p"), F.struct("row", "pos").alias("m")).groupBy("p").agg(F.sort_array(F.collect_list("m")).alias("m"))
    cut = cut.select("p", F.transform("m", lambda m: m["row"]).alias("names"), F.transform("m", lambda m: m["pos"]).alias("places"))

    def split(p, q, rows, x, names, places):
        places = places[np.searchsorted(names, rows)]
        for to in np.unique(places // block).tolist():
            hit = places // block == to
            yield int(to), q, places[hit] % block, x.reshape(-1, width(q))[hit]

    pieces = each(rows.join(cut, "p"), ["p", "q", "rows", "x", "names", "places"], split, "p bigint, q bigint, at array<bigint>, x array<double>")
    met = pieces.groupBy("p", "q").agg(F.collect_list(F.struct("at", "x")).alias("m"))
    met = met.select("p", "q", F.flatten(F.transform("m", lambda m: m["at"])).alias("at"), F.flatten(F.transform("m", lambda m: m["x"])).alias("x"))

    def joined(p, q, at, x):
        out = np.zeros((height(p), width(q)))
        out[at] = x.reshape(-1, width(q))
        return [(p, q, out)]

    return Blocked(materialize(each(met, ["p", "q", "at", "x"], joined, _SCHEMA), "lu-factor"), a.m, a.n, block)


# --- triangular systems ---------------------------------------------------------------------------


def substitute(t: Blocked, b: Blocked, lower: bool, transposed: bool = False, unit: bool = False, single: bool = False) -> Blocked:
    """X with T·X = B, or Tᵀ·X = B, for triangular T and any number of right-hand sides.

    A wave over block rows: a step solves one of them and takes its share from those that are still to come,
    which meet the block column of T and the solved blocks in one written table.
    """
    if t.m != t.n or t.m != b.m or t.block != b.block:
        raise ValueError("sides of different heights")
    kind, width, outer = np.float32 if single else np.float64, t.width, b.width
    forward = lower != transposed
    steps = range(t.columns) if forward else range(t.columns - 1, -1, -1)
    across, along = ("q", "p") if not transposed else ("p", "q")
    rest, solved = b.df, []

    def diagonal(k: int) -> Callable:
        def f(p, q, x, d):
            w = width(k)
            own = d.reshape(w, w).astype(kind)
            own = np.tril(own) if lower else np.triu(own)
            if unit:
                np.fill_diagonal(own, 1.0)
            return [(p, q, np.linalg.solve(own.T if transposed else own, x.reshape(w, -1).astype(kind)).astype(float))]

        return f

    for k in steps:
        column = t.df.where(F.col(across) == k)
        own = column.where(F.col(along) == k).select(F.lit(k).cast("bigint").alias("p"), F.col("x").alias("d"))
        now = each(rest.where(F.col("p") == k).join(F.broadcast(own), "p"), ["p", "q", "x", "d"], diagonal(k), _SCHEMA)
        solved.append(_guarded(lambda m=now: Blocked(m, b.m, b.n, b.block).written("solved"), "singular").df)
        ahead = rest.where(F.col("p") > k) if forward else rest.where(F.col("p") < k)
        if k == steps[-1]:
            break
        column = column.where(F.col(along) != k).select(F.col(along).alias("p"), F.col("x").alias("l"))
        met = ahead.join(column, "p", "left").join(solved[-1].select("q", F.col("x").alias("s")), "q")

        def update(p, q, x, l, s, w=width(k)):
            if l is None:
                return [(p, q, x)]
            l = l.reshape(w, -1).T if transposed else l.reshape(-1, w)
            return [(p, q, x - (l.astype(kind) @ s.reshape(w, -1).astype(kind)).ravel())]

        rest = materialize(each(met, ["p", "q", "x", "l", "s"], update, _SCHEMA), "to-solve")
    return Blocked(_union(solved), b.m, b.n, b.block)


def solve_positive(a: Blocked, b: Blocked) -> Blocked:
    """X with A·X = B for symmetric positive definite A."""
    low = cholesky(a)
    return substitute(low, substitute(low, b, True), True, transposed=True)


def solve_factored(f: LU, b: Blocked, transposed: bool = False, single: bool = False) -> Blocked:
    """X with A·X = B, or Aᵀ·X = B, from A's factors; singular A raises."""
    if transposed:
        y = substitute(f.lower, substitute(f.upper, b, False, transposed=True, single=single), True, transposed=True, unit=True, single=single)
        back = LU(f.lower, f.upper, f.order.select(F.col("pos").alias("row"), F.col("row").alias("pos")))
        return back.permuted(y)
    return substitute(f.upper, substitute(f.lower, f.permuted(b), True, unit=True, single=single), False, single=single)


def solve(a: Blocked, b: Blocked, transposed: bool = False) -> Blocked:
    return solve_factored(lu(a), b, transposed)


def log_det(f: LU) -> tuple[int, float]:
    """(sign, logarithm of the absolute value) of the determinant; (0, -inf) if singular."""
    width = f.upper.width

    def ends(p, q, x):
        d = np.diag(x.reshape(-1, width(q)))
        return [(int((d == 0).sum()), int((d < 0).sum()), np.array([np.log(np.abs(d[d != 0])).sum()]))]

    found = each(f.upper.df.where("p = q"), ["p", "q", "x"], ends, "zeros bigint, minus bigint, logs array<double>")
    zeros, minus, logs = found.agg(F.sum("zeros"), F.sum("minus"), F.sum(F.col("logs")[0])).first()
    if zeros:
        return 0, -math.inf
    return (-1) ** ((minus + f.upper.m - _cycles(f.order)) % 2), logs


def _cycles(order: DataFrame) -> int:
    """Cycles of a permutation (pos, row): every place takes the least label it meets, over twice as many steps each round."""
    now = order.select("pos", F.col("row").alias("jump"), F.least("pos", "row").alias("label"))
    while True:
        now = materialize(now, "cycles")
        to = now.select(F.col("pos").alias("jump"), F.col("jump").alias("far"), F.col("label").alias("there"))
        after = materialize(now.join(to, "jump").select("pos", F.col("far").alias("jump"), F.least("label", "there").alias("label"), (F.col("there") < F.col("label")).alias("changed")), "cycles")
        if not after.where("changed").head(1):
            return after.where("label = pos").count()
        now = after.drop("changed")


def inverse(a: Blocked) -> Blocked:
    return solve(a, identity(a))


def identity(like: Blocked) -> Blocked:
    """I in blocks, all present, of the order and session of ``like``."""
    blocks = like.df.sparkSession.range(like.rows * like.columns).select((F.floor(F.col("id") / like.columns)).cast("bigint").alias("p"), (F.col("id") % like.columns).alias("q"))
    height, width = like.height, like.width
    return Blocked(each(blocks, ["p", "q"], lambda p, q: [(p, q, np.eye(height(p), width(q)) if p == q else np.zeros((height(p), width(q))))], _SCHEMA), like.m, like.n, like.block)


# --- mixed precision ------------------------------------------------------------------------------


def norm(a: Blocked) -> float:
    """The largest absolute sum of a row."""
    width = a.width
    sums = each(a.df, ["p", "q", "x"], lambda p, q, x: [(p, np.abs(x.reshape(-1, width(q))).sum(axis=1))], "p bigint, s array<double>")
    rows = sums.select("p", F.posexplode("s").alias("r", "s")).groupBy("p", "r").agg(F.sum("s").alias("s"))
    return rows.agg(F.max("s")).first()[0] or 0.0


def solve_mixed(a: Blocked, b: Blocked, tol: float = 1e-12, most: int = 20) -> tuple[Blocked, int]:
    """(X, corrections): A·X = B by single-precision factors and residuals in double precision.

    Corrections stop when the residual is small against ‖A‖·‖X‖ + ‖B‖. Where one of them doesn't at least halve the residual,
    the factors are too coarse for A, and the double-precision ones solve it; -1 then stands for their number.
    """
    a, b = a.written(), b.written()
    coarse, scale_a, scale_b = lu(a, single=True), norm(a), norm(b)
    try:
        x = solve_factored(coarse, b, single=True).written("mixed")
        was = math.inf
        for k in range(most):
            r = b.add(a.multiply(x), -1.0).written("residual")
            size = norm(r)
            if size <= tol * (scale_a * norm(x) + scale_b):
                return x, k
            if not size <= was / 2:
                break
            was, x = size, x.add(solve_factored(coarse, r, single=True)).written("mixed")
    except np.linalg.LinAlgError:
        pass
    return solve(a, b), -1


# --- functions ------------------------------------------------------------------------------------


def exp(a: Blocked, terms: int = 18) -> Blocked:
    """Exponential: A is halved until its norm is below one half, a Taylor sum by Horner, and squared as often."""
    if a.m != a.n:
        raise ValueError("exponential of a matrix that is not square")
    a = a.written()
    halvings = max(0, math.ceil(math.log2(max(norm(a), 2.0**-60) * 2)))
    small = a.scaled(2.0**-halvings).written()
    out = identity(a).written()
    for k in range(terms, 0, -1):
        out = small.multiply(out).scaled(1 / k).plus_diagonal(1.0).written("exp")
    for _ in range(halvings):
        out = out.multiply(out).written("exp")
    return out


def sqrt(a: Blocked, tol: float = 1e-12, most: int = 100) -> Blocked:
    """The principal root by coupled Newton steps: Y and Z go to A's root and its inverse.

    Of A over its norm, steps are products only, Y·(3·I - Z·Y)/2 and (3·I - Z·Y)·Z/2, as long as Z·Y comes nearer to I, as it does
    for positive definite A. Otherwise each step is the mean with the other's inverse.
    """
    if a.m != a.n:
        raise ValueError("root of a matrix that is not square")
    a, one = a.written(), identity(a).written()
    size, best = norm(a), math.inf
    # Where it converges the gap's largest singular value falls from below one, which bounds its rows' sums.
    bound = 2 * math.sqrt(max(a.n, 1))
    y, z = (a.scaled(1 / size).written(), one) if size else (a, one)
    for _ in range(most if size else 0):
        gap = one.add(z.multiply(y), -1.0).written("root")
        now = norm(gap)
        if now <= tol:
            return y.scaled(math.sqrt(size)).written("root")
        if best <= 1e-9 and now >= best:
            return y.scaled(math.sqrt(size)).written("root")
        if not now <= bound:
            break
        half, best = one.add(gap, 0.5).written("root"), min(best, now)
        y, z = y.multiply(half).written("root"), half.multiply(z).written("root")
    y, z = a, one
    for _ in range(most):
        new = y.add(inverse(z)).scaled(0.5).written("root")
        z = z.add(inverse(y)).scaled(0.5).written("root")
        moved = norm(new.add(y, -1.0)) / max(norm(new), 1e-300)
        y = new
        if moved <= 1e-12:
            return y
    raise ArithmeticError("the root's steps do not settle")


# --- singular values ------------------------------------------------------------------------------


def _rounds(n: int) -> list[list[tuple[int, int]]]:
    """A round-robin tournament of n block columns: every pair once, all of a round's pairs apart. An odd one rests."""
    players = [*range(n), *([-1] if n % 2 else [])]
    out = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        out.append([(max(p), min(p)) if min(p) < 0 else (min(p), max(p)) for p in zip(players[:half], players[half:][::-1])])
        players = [players[0], players[-1], *players[1:-1]]
    return out


def svd(a: Blocked, tol: float = 1e-13, most: int = 30) -> tuple[Blocked, DataFrame, Blocked]:
    """(U, (j, s), V) with A·V = U·S, for any number of columns: V is square, columns of U for a value of zero are zero.

    One-sided block Jacobi: a round makes the columns of every pair of block columns orthogonal, by the eigenvectors
    of their common Gram matrix, and turns V along. Pairs meet in one shuffle a round; a task holds one
    block row of one pair. Sweeps end when no inner product between two block columns exceeds ``tol`` of
    ‖A‖². Values below about 1e-7 of the largest one are noise, and are zero here.
    """
    block, width, spark = a.block, a.width, a.df.sparkSession
    squares = a.df.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    below = identity(Blocked(a.df, a.n, a.n, block)).df.select((F.col("p") + a.rows).alias("p"), "q", "x")
    heights = _heights(a.m, a.n, a.rows, block)
    stack = a.df.unionByName(below)
    rounds = _rounds(a.columns) if a.columns > 1 else [[(0, -1)]]
    for _ in range(most if squares else 0):
        off = 0.0
        for pairs in rounds:
            places = [(q, k, side) for k, pair in enumerate(pairs) for side, q in enumerate(pair) if q >= 0]
            deal = F.broadcast(spark.createDataFrame(places, "q bigint, pair bigint, side int"))
            own = lambda side: F.first(F.when(F.col("side") == side, F.struct("q", "x")), True).alias(f"c{side}")
            met = stack.join(deal, "q").groupBy("pair", "p").agg(own(0), own(1))
            met = materialize(met.select("pair", "p", F.coalesce("c0.q", F.lit(-1)).alias("a"), "c0.x", F.coalesce("c1.q", F.lit(-1)).alias("b"), F.col("c1.x").alias("y")), "jacobi")

            ends = {k: pair for k, pair in enumerate(pairs)}

            def sides(pair, p, x, y, ends=ends):
                """A pair's columns in one block row; absent blocks are zero."""
                q, r = ends[pair]
                own = lambda q, x: np.zeros((heights(p), width(q) if q >= 0 else 0)) if x is None or q < 0 else x.reshape(-1, width(q))
                return np.hstack([own(q, x), own(r, y)])

            def gram(pair, p, x, y):
                z = sides(pair, p, x, y)
                return [(pair, 0, z.T @ z)]

            grams = each(met.where(F.col("p") < a.rows), ["pair", "p", "x", "y"], gram, _SCHEMA)
            grams = grams if a.rows == 1 else summed(grams)

            def turn(pair, q, x, ends=ends):
                c, d = ends[pair]
                n = width(c) + (width(d) if d >= 0 else 0)
                g, k = x.reshape(n, n), width(c)
                values, w = np.linalg.eigh(g)
                inner = np.abs(g[:k, k:]).max(initial=0.0) if d >= 0 else np.abs(g - np.diag(np.diag(g))).max(initial=0.0)
                return [(pair, w[:, ::-1].copy(), np.array([inner]))]

            turns = materialize(each(grams, ["p", "q", "x"], turn, "pair bigint, w array<double>, off array<double>"), "jacobi-turns")
            off = max(off, turns.agg(F.max(F.col("off")[0])).first()[0] or 0.0)

            def turned(pair, p, x, y, w, ends=ends):
                z = sides(pair, p, x, y)
                z = z @ w.reshape(z.shape[1], -1)
                c, d = ends[pair]
                yield p, c, np.ascontiguousarray(z[:, : width(c)])
                if d >= 0:
                    yield p, d, np.ascontiguousarray(z[:, width(c) :])

            stack = each(met.join(turns.select("pair", "w"), "pair"), ["pair", "p", "x", "y", "w"], turned, _SCHEMA)
        if off <= tol * squares or a.columns == 1:
            break
    else:
        if squares:
            raise ArithmeticError("the sweeps do not settle")
    stack = materialize(stack, "jacobi")
    long = each(stack.where(F.col("p") < a.rows), ["p", "q", "x"], lambda p, q, x: [(q, (x.reshape(-1, width(q)) ** 2).sum(axis=0))], "q bigint, s array<double>")
    values = long.select("q", F.posexplode("s").alias("c", "s")).groupBy("q", "c").agg(F.sqrt(F.sum("s")).alias("s"))
    values = values.withColumn("s", F.when(F.col("s") > 1e-7 * math.sqrt(squares), F.col("s")).otherwise(0.0))
    values = materialize(values.select("q", "c", "s"), "singular-values")
    lines = values.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("m")).select("q", F.transform("m", lambda m: m["s"]).alias("s"))

    def unit(p, q, x, s):
        return [(p, q, x.reshape(-1, width(q)) * np.where(s > 0, 1 / np.where(s > 0, s, 1.0), 0.0))]

    u = each(stack.where(F.col("p") < a.rows).join(lines, "q"), ["p", "q", "x", "s"], unit, _SCHEMA)
    v = stack.where(F.col("p") >= a.rows).select((F.col("p") - a.rows).alias("p"), "q", "x")
    return Blocked(u, a.m, a.n, block), values.select((F.col("q") * block + F.col("c")).alias("j"), "s"), Blocked(v, a.n, a.n, block)


def svd_thin(a: Blocked) -> tuple[Blocked, DataFrame, Blocked]:
    """(U, (j, s), V) with A = U·S·Vᵀ and as many columns in both as A's shorter side has.

    A wide matrix is turned on its side: its columns beyond its rows have values of zero, and V's square would grow with them.
    """
    if a.m >= a.n:
        return svd(a)
    u, s, v = svd(a.T().written())
    return v, s, u


def _heights(m: int, n: int, rows: int, block: int) -> Callable[[int], int]:
    """Rows of a block row of A above V."""
    return lambda p: min(block, m - p * block) if p < rows else min(block, n - (p - rows) * block)


def scale_columns(a: Blocked, values: DataFrame) -> Blocked:
    """A·diag(s) for (j, s)."""
    block, width = a.block, a.width
    lines = values.groupBy(F.floor(F.col("j") / block).cast("bigint").alias("q")).agg(F.sort_array(F.collect_list(F.struct("j", "s"))).alias("m")).select("q", F.transform("m", lambda m: m["s"]).alias("s"))
    return Blocked(each(a.df.join(lines, "q"), ["p", "q", "x", "s"], lambda p, q, x, s: [(p, q, x.reshape(-1, width(q)) * s)], _SCHEMA), a.m, a.n, block)
