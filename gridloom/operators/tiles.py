"""Tensors in tiles: dense N-dimensional pieces of bounded size, with the shape and the order of axes as metadata.

A ``Tiled`` is a table (t0 … tk, x): a tile's place along each stored axis and its cells, row-major. Permuting and slicing
change what the object says of the table, and move no cell; a slice reads only the tiles that it cuts. A contraction is a
product of tiles: each is laid out as a matrix of its free by its contracted cells, and tiles meet by contracted and outer
place, so neither cells nor a few keys meet. Tiles that are absent are zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import materialize
from gridloom.operators import blocks
from gridloom.operators.blocks import each, summed

#: Cells of one tile; its sides are as equal as the shape allows.
CELLS = 2**16


def sides(shape: Sequence[int], cells: int = CELLS) -> tuple[int, ...]:
    """Sides of a tile of at most so many cells: short axes whole, the others alike."""
    out, left, rest = {}, cells, sorted(range(len(shape)), key=lambda k: shape[k])
    for n, k in enumerate(rest):
        side = max(1, min(shape[k], int(round(left ** (1 / (len(rest) - n)), 9))))
        out[k], left = side, left / side
    return tuple(out[k] for k in range(len(shape)))


@dataclass(frozen=True)
class Tiled:
    """``order`` names the stored axis behind each axis of the tensor; ``fixed`` the place of the stored axes that are sliced away."""

    df: DataFrame
    stored: tuple[int, ...]
    tile: tuple[int, ...]
    order: tuple[int, ...]
    fixed: tuple[tuple[int, int], ...] = ()

    # --- to and from cells ---

    @classmethod
    def of(cls, t, tile: Sequence[int] | None = None) -> Tiled:
        """From a tensor of cells; a tile's cells meet in one task."""
        shape = t.shape
        tile = tuple(tile or sides(shape))
        place = [F.floor(F.col(a) / s).cast("bigint").alias(f"t{k}") for k, (a, s) in enumerate(zip(t.axes, tile))]
        inner = F.struct(*[(F.col(a) % s).cast("int").alias(f"c{k}") for k, (a, s) in enumerate(zip(t.axes, tile))], "v")
        held = t.df.select(*place, inner.alias("c")).groupBy(*[f"t{k}" for k in range(len(tile))]).agg(F.collect_list("c").alias("c"))
        rank = len(shape)

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    at = [batch.column(k)[row].as_py() for k in range(rank)]
                    own = batch.column(rank)[row].values
                    out = np.zeros([min(s, n - a * s) for a, s, n in zip(at, tile, shape)])
                    out[tuple(own.field(k).to_numpy() for k in range(rank))] = own.field(rank).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([*[pa.array([a]) for a in at], pa.array([out.ravel()], pa.list_(pa.float64()))], names=names)

        names = [*[f"t{k}" for k in range(rank)], "x"]
        return cls(held.mapInArrow(dense, _schema(rank)), tuple(shape), tile, tuple(range(rank)))

    def to_tensor(self):
        """Cells, with those of absent tiles absent."""
        from gridloom.operators.tensor import Tensor

        order, read, rank = self.order, self._reader(), len(self.stored)
        tile = self.tile
        names = [f"a{k}" for k in range(len(order))]

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    at = [batch.column(k)[row].as_py() for k in range(rank)]
                    x = read(at, batch.column(rank)[row].values.to_numpy(zero_copy_only=False))
                    places = [i.ravel() + at[o] * tile[o] for i, o in zip(np.indices(x.shape), order)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, places), pa.array(x.ravel())], names=[*names, "v"])

        return Tensor(self._cut().mapInArrow(cells, ", ".join(f"{a} bigint" for a in names) + (", " if names else "") + "v double"), self.shape)

    # --- metadata ---

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.stored[o] for o in self.order)

    def strides(self) -> tuple[int, ...]:
        """How many cells of a whole stored tensor each axis steps over."""
        steps = [math.prod(self.stored[k + 1 :]) for k in range(len(self.stored))]
        return tuple(steps[o] for o in self.order)

    def is_contiguous(self) -> bool:
        return not self.fixed and self.order == tuple(range(len(self.stored)))

    def written(self) -> Tiled:
        return replace(self, df=materialize(self.df, "tiles"))

    def permute(self, order: Sequence[int]) -> Tiled:
        if sorted(order) != list(range(len(self.order))):
            raise ValueError("not a permutation of the axes")
        return replace(self, order=tuple(self.order[o] for o in order))

    def slice(self, axis: int, index: int) -> Tiled:
        if not 0 <= axis < len(self.order):
            raise IndexError(f"axis {axis} of rank {len(self.order)}")
        if not 0 <= index < self.shape[axis]:
            raise IndexError("the index is outside")
        return replace(self, order=tuple(o for k, o in enumerate(self.order) if k != axis), fixed=(*self.fixed, (self.order[axis], index)))

    def _cut(self) -> DataFrame:
        """The tiles that the slices cut."""
        out = self.df.select(*[f"t{k}" for k in range(len(self.stored))], "x")
        for k, index in self.fixed:
            out = out.where(F.col(f"t{k}") == index // self.tile[k])
        return out

    def _reader(self):
        """(a tile's place, its stored cells) -> its cells in the order of the tensor's axes."""
        stored, tile, order, fixed = self.stored, self.tile, self.order, dict(self.fixed)

        def read(at: Sequence[int], x: np.ndarray) -> np.ndarray:
            x = x.reshape([min(s, n - a * s) for a, s, n in zip(at, tile, stored)])
            x = x[tuple(fixed[k] % tile[k] if k in fixed else slice(None) for k in range(len(stored)))]
            left = [k for k in range(len(stored)) if k not in fixed]
            return x.transpose([left.index(o) for o in order])

        return read

    def contiguous(self) -> Tiled:
        """The same tensor with tiles stored as it has its axes; every tile stays whole where it is."""
        order, rank, read = self.order, len(self.stored), self._reader()

        def moved(*row):
            at, x = row[:rank], row[rank]
            return [(*[at[o] for o in order], np.ascontiguousarray(read(at, x)))]

        made = each(self._cut(), [*[f"t{k}" for k in range(rank)], "x"], moved, _schema(len(order)))
        return Tiled(made, self.shape, tuple(self.tile[o] for o in order), tuple(range(len(order))))

    # --- arithmetic ---

    def zip(self, o: Tiled, f) -> Tiled:
        """``f`` of both tensors' tiles, which have one shape and tiling and are all present."""
        if self.shape != o.shape or [self.tile[k] for k in self.order] != [o.tile[k] for k in o.order]:
            raise ValueError("tensors of other shapes or tiles")
        a, b = self.contiguous(), o.contiguous()
        keys = [f"t{k}" for k in range(len(a.stored))]
        both = a.df.join(b.df.withColumnRenamed("x", "y"), keys)
        made = each(both, [*keys, "x", "y"], lambda *row: [(*row[:-2], np.asarray(f(row[-2], row[-1]), float))], _schema(len(keys)))
        return replace(a, df=made)

    def scaled(self, k: float) -> Tiled:
        return replace(self, df=self.df.withColumn("x", F.transform("x", lambda v: v * float(k))))

    # --- contraction ---

    def _matrices(self, rows: Sequence[int], columns: Sequence[int]) -> DataFrame:
        """(p, q, x): every tile as a matrix of the cells of some axes by those of the others, by their places in one number each."""
        rank, read, counts = len(self.stored), self._reader(), [-(-n // s) for n, s in zip(self.stored, self.tile)]
        order = self.order

        def number(at: Sequence[int], axes: Sequence[int]) -> int:
            out = 0
            for a in axes:
                out = out * counts[order[a]] + at[order[a]]
            return out

        def laid(*row):
            at, x = row[:rank], row[rank]
            y = read(at, x).transpose([*rows, *columns])
            return [(number(at, rows), number(at, columns), np.ascontiguousarray(y))]

        return each(self._cut(), [*[f"t{k}" for k in range(rank)], "x"], laid, "p bigint, q bigint, x array<double>")

    def _numbers(self, axes: Sequence[int]) -> int:
        return math.prod(-(-self.shape[a] // self.tile[self.order[a]]) for a in axes)

    def _size(self, axes: Sequence[int]):
        """Cells along some axes of the tiles of one number."""
        counts = [-(-self.shape[a] // self.tile[self.order[a]]) for a in axes]
        lengths, tile = [self.shape[a] for a in axes], [self.tile[self.order[a]] for a in axes]

        def size(number: int) -> int:
            return math.prod(_lengths(number, counts, lengths, tile))

        return size


def _lengths(number: int, counts: Sequence[int], lengths: Sequence[int], tile: Sequence[int]) -> list[int]:
    out = []
    for c, n, s in zip(reversed(counts), reversed(lengths), reversed(tile)):
        out.append(min(s, n - number % c * s))
        number //= c
    return out[::-1]


def _schema(rank: int) -> str:
    return ", ".join([*[f"t{k} bigint" for k in range(rank)], "x array<double>"])


def contract(a: Tiled, b: Tiled, axes_a: Sequence[int], axes_b: Sequence[int]) -> Tiled:
    """Sums over pairs of axes of two tensors; free axes of A come first. Of none free, the shape is (1)."""
    if [a.shape[x] for x in axes_a] != [b.shape[y] for y in axes_b]:
        raise ValueError("contracted axes of different lengths")
    if [a.tile[a.order[x]] for x in axes_a] != [b.tile[b.order[y]] for y in axes_b]:
        raise ValueError("contracted axes in tiles of different lengths")
    free_a, free_b = [x for x in range(len(a.order)) if x not in axes_a], [y for y in range(len(b.order)) if y not in axes_b]
    left = a._matrices(free_a, axes_a).select("p", F.col("q").alias("k"), F.col("x").alias("l"))
    right = b._matrices(axes_b, free_b).select(F.col("p").alias("k"), "q", F.col("x").alias("r"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    cells_a, cells_b = math.prod(a.shape), math.prod(b.shape)
    if min(cells_a, cells_b) <= blocks.SMALL:
        both = left.join(F.broadcast(right), "k") if cells_b <= cells_a else right.join(F.broadcast(left), "k")
    elif cells_a <= cells_b:
        both = right.withColumn("p", every(a._numbers(free_a))).join(left, ["p", "k"])
    else:
        both = left.withColumn("q", every(b._numbers(free_b))).join(right, ["k", "q"])
    size, wide = a._size(axes_a), b._size(free_b)
    made = each(both, ["p", "q", "k", "l", "r"], lambda p, q, k, x, y: [(p, q, x.reshape(-1, size(k)) @ y.reshape(size(k), wide(q)))], "p bigint, q bigint, x array<double>")
    made = made if a._numbers(axes_a) == 1 else summed(made)

    shape = [a.shape[x] for x in free_a] + [b.shape[y] for y in free_b]
    tile = [a.tile[a.order[x]] for x in free_a] + [b.tile[b.order[y]] for y in free_b]
    if not shape:
        return Tiled(made.select(F.col("p").alias("t0"), "x"), (1,), (1,), (0,))
    places = []
    for number, source, axes in (("p", a, free_a), ("q", b, free_b)):
        left_over = F.col(number)
        own = []
        for x in reversed(axes):
            count = -(-source.shape[x] // source.tile[source.order[x]])
            own.append((left_over % count).cast("bigint"))
            left_over = F.floor(left_over / count)
        places += own[::-1]
    return Tiled(made.select(*[c.alias(f"t{k}") for k, c in enumerate(places)], "x"), tuple(shape), tuple(tile), tuple(range(len(shape))))


def contract_cells(a, b, axes_a: Sequence[int], axes_b: Sequence[int]):
    """The contraction of two tensors of cells, by tiles that fit each other."""
    tile_a, tile_b = list(sides(a.shape)), list(sides(b.shape))
    for x, y in zip(axes_a, axes_b):
        tile_a[x] = tile_b[y] = min(tile_a[x], tile_b[y])
    return contract(Tiled.of(a, tile_a), Tiled.of(b, tile_b), axes_a, axes_b).to_tensor()
