"""Eigenpairs of long-form matrices, symmetric ones above all.

Small problems are solved densely on the driver. Larger ones iterate on a block
of k vectors: up to LOCAL_ENTRIES entries the driver multiplies by itself; beyond,
each product is one job over the cached matrix (the block, n x k numbers, is the
only thing sent around), of which deep Krylov spaces need fewer than LOBPCG does. The k x k Rayleigh-Ritz problems are the driver's. Signs
are fixed: the entry of largest size of each vector is positive.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockwise import fixed_signs, largest_pairs, list_array
from .checks import is_symmetric
from .graph import PathRows

SOLVERS = ("auto", "dense", "arpack", "lobpcg", "amg", "distributed")
DENSE_LIMIT, DENSE_HELD, DENSE_MOST = 3_000, 4_000, 20_000
BLOCK_LIMIT = 40_000_000
LOCAL_ENTRIES = 2_000_000
WIDEST = 256
#: A Krylov space and its image hold so many numbers, between MOST_DEEP and five blocks.
KRYLOV_NUMBERS, MOST_DEEP = 12_000_000, 30
Product = Callable[[np.ndarray], np.ndarray]


def choose_solver(solver: str, n: int, vectors: int) -> str:
    """The solver to run: dense for small problems, a block iteration for larger ones, over tables where the block is too large for the driver. ``amg`` is LOBPCG with a multigrid preconditioner.

    ``dense`` of more than DENSE_HELD rows, which with its work space (four such matrices, half a GB) would fill
    the driver, is solved for the wanted pairs by Krylov spaces, with products in the tasks.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown eigen solver {solver!r}; there are {', '.join(SOLVERS)}")
    if solver == "auto":
        return "dense" if n <= DENSE_LIMIT else "lobpcg" if n * (vectors + 5) <= BLOCK_LIMIT else "distributed"
    if solver not in ("dense", "distributed") and n < 5 * vectors + 1:
        return "dense"
    return "arpack" if solver == "dense" and n > DENSE_HELD else solver


@dataclass
class Eigenpairs:
    """Eigenvalues and, as (id, v), the vectors' entries by id in the eigenvalues' order; ids and entries as arrays, too, unless they were found over tables."""

    values: np.ndarray
    vectors: DataFrame
    ids: np.ndarray | None = None
    matrix: np.ndarray | None = None


def vector_frame(spark: SparkSession, ids: np.ndarray, rows: np.ndarray) -> DataFrame:
    """(id, v) of ids and rows of a matrix."""
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "v": list_array(rows)}))


class Operator:
    """Products of a matrix (i, j, value) over given ids with blocks of vectors; its columns are the same ids, or those given."""

    def __init__(self, matrix: DataFrame, value: str, ids: DataFrame, n: int | None = None, columns: np.ndarray | None = None):
        self.spark = matrix.sparkSession
        own = ids.select("id").distinct()
        self.n = own.count() if n is None else n
        if self.n > BLOCK_LIMIT:
            raise ValueError(f"a vector of {self.n} numbers is too large for the driver")
        self.ids = np.sort(np.asarray(own.toArrow().column(0), np.int64))  # n numbers, checked
        self.columns = self.ids if columns is None else columns
        self.rows = matrix.select("i", "j", F.col(value).cast("double").alias("x"))
        self._cached: DataFrame | None = None
        self._rows: tuple | None = None

    def dense(self) -> np.ndarray:
        if self.n > DENSE_MOST:
            raise ValueError(f"a dense matrix of {self.n} rows is too large for the driver")
        t = self.rows.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # n x n numbers at most
        out = np.zeros((self.n, self.n))
        out[np.searchsorted(self.ids, t.column(0)), np.searchsorted(self.ids, t.column(1))] = np.asarray(t.column(2))
        return out

    def diagonal(self) -> np.ndarray:
        t = self.rows.where("i = j").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # n numbers
        out = np.zeros(self.n)
        out[np.searchsorted(self.ids, t.column(0))] = np.asarray(t.column(1))
        return out

    def bound(self) -> float:
        """At least the largest size of an eigenvalue: the largest row sum of sizes."""
        return self.rows.groupBy("i").agg(F.sum(F.abs("x")).alias("s")).agg(F.max("s")).first()[0] or 0.0

    def local(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows, columns and values, by rows, of a matrix small enough for the driver."""
        if self._rows is None:
            own = self.rows.limit(LOCAL_ENTRIES + 1).toArrow()
            self._rows = ()
            if own.num_rows <= LOCAL_ENTRIES:
                i, j = np.searchsorted(self.ids, own.column(0)), np.searchsorted(self.columns, own.column(1))
                order = np.argsort(i, kind="stable")
                self._rows = (i[order], j[order], np.asarray(own.column(2))[order])
        return self._rows or None

    def apply(self, block: np.ndarray) -> np.ndarray:
        local = self.local()
        if local is not None:
            return _times(local, block, self.n)
        if self._cached is None:
            parts = max(self.spark.sparkContext.defaultParallelism, 1)
            self._cached = self.rows.repartitionByRange(parts, "i").sortWithinPartitions("i").persist()
        shared = self.spark.sparkContext.broadcast((self.ids, self.columns, block))  # n x k numbers, checked by solve()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, columns, x = shared.value
            for batch in batches:
                i, j = (np.searchsorted(own, np.asarray(batch.column(c))) for c, own in enumerate((ids, columns)))
                rows, index = np.unique(i, return_inverse=True)
                part = _times((index, j, np.asarray(batch.column(2))), x, len(rows))  # rows come in order
                yield pa.RecordBatch.from_arrays([pa.array(rows), list_array(part)], ["row", "y"])

        t = self._cached.mapInArrow(run, "row long, y array<double>").toArrow()
        out = np.zeros((self.n, block.shape[1]))
        if t.num_rows:
            np.add.at(out, np.asarray(t.column(0)), np.asarray(t.column(1).combine_chunks().flatten()).reshape(t.num_rows, -1))
        shared.unpersist()
        return out

    def release(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    def frame(self, vectors: np.ndarray) -> DataFrame:
        return vector_frame(self.spark, self.ids, vectors)


class FactorOperator(Operator):
    """B B^T by products with its factor B (i, j, value) and the factor's transpose: B B^T, which has the square of a column's entries, is never formed. With ``other``, C of the same form, the matrix is B C^T."""

    def __init__(self, factor: DataFrame, value: str, ids: DataFrame, n: int | None = None, other: DataFrame | None = None):
        names = factor.select(F.col("j").cast("long").alias("id"))
        names = (names if other is None else names.union(other.select(F.col("j").cast("long")))).distinct()
        right = factor if other is None else other
        turned = right.select(F.col("j").cast("long").alias("i"), F.col("i").alias("j"), F.col(value).alias("x"))
        super().__init__(factor.select("i", F.col("j").cast("long").alias("j"), value), value, ids, n)
        self.turned = Operator(turned, "x", names, columns=self.ids)
        self.columns = self.turned.ids
        self.right = self.rows if other is None else other.select("i", "j", F.col(value).alias("x"))

    def diagonal(self) -> np.ndarray:
        merged = self.rows.groupBy("i", "j").agg(F.sum("x").alias("x"))
        t = merged.groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("x")).toArrow()  # n numbers
        out = np.zeros(self.n)
        out[np.searchsorted(self.ids, t.column(0))] = np.asarray(t.column(1))
        return out

    def bound(self) -> float:
        return factor_bound(self.rows, "x", self.right)

    def apply(self, block: np.ndarray) -> np.ndarray:
        return super().apply(self.turned.apply(block))

    def release(self) -> None:
        super().release()
        self.turned.release()


class PathOperator(Operator):
    """Products with the doubly centred -1/2 squares of all paths of a connected graph: the packed rows are multiplied where they are, between centred blocks. On one line these are the products of the centred places."""

    def __init__(self, paths: PathRows, matrix: DataFrame, value: str, ids: DataFrame):
        super().__init__(matrix, value, ids)
        self.paths = paths

    def local(self) -> None:
        return None

    def apply(self, block: np.ndarray) -> np.ndarray:
        if self.paths.places is not None:
            place = (self.paths.places - self.paths.places.mean())[:, None]
            return place @ (place.T @ block)
        shared, unpacked = self.spark.sparkContext.broadcast(block - block.mean(0)), self.paths.unpacked  # n x k numbers, checked by solve()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sources, rows in unpacked(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(sources), list_array((-0.5 * rows * rows) @ shared.value)], ["row", "y"])

        t = self.paths.frame.mapInArrow(run, "row long, y array<double>").toArrow()
        out = np.zeros((self.n, block.shape[1]))
        out[np.searchsorted(self.ids, np.asarray(t.column(0)))] = np.asarray(t.column(1).combine_chunks().flatten()).reshape(t.num_rows, -1)
        shared.unpersist()
        return out - out.mean(0)


def factor_bound(factor: DataFrame, value: str, other: DataFrame | None = None) -> float:
    """At least the largest size of an eigenvalue of B B^T, or of B C^T with C as ``other``: the largest row sum of sizes of |B| |C|^T."""
    size = factor.select("i", "j", F.abs(value).alias("x"))
    columns = (factor if other is None else other).select("j", F.abs(value).alias("x")).groupBy("j").agg(F.sum("x").alias("s"))
    return size.join(columns, "j").groupBy("i").agg(F.sum(F.col("x") * F.col("s")).alias("s")).agg(F.max("s")).first()[0] or 0.0


def formed(factor: DataFrame, value: str, other: DataFrame | None = None) -> DataFrame:
    """B B^T, or B C^T with C as ``other``, as entries (i, j, value); several of a place add up."""
    one = factor.select("i", F.col("j").alias("_f"), F.col(value).alias("_a"))
    two = (factor if other is None else other).select(F.col("i").alias("j"), F.col("j").alias("_f"), F.col(value).alias("_b"))
    return one.join(two, "_f").select("i", "j", (F.col("_a") * F.col("_b")).alias(value))


def _times(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], block: np.ndarray, n: int | None = None) -> np.ndarray:
    """A sparse matrix, by rows, times a block."""
    i, j, x = matrix
    out = np.zeros((len(block) if n is None else n, block.shape[1]))
    if len(i):
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        own = i[cuts]
        for c in range(block.shape[1]):  # by columns: several times as fast as rows at once
            out[own, c] = np.add.reduceat(x * block[:, c][j], cuts)
    return out


class Multigrid:
    """An approximate inverse of a symmetric positive matrix: one V-cycle over aggregates of strongly connected rows.

    Each row follows its strongest neighbour; the trees that these choices make are
    the aggregates of a level, at least two rows each. Jacobi steps smooth before and
    after; the coarsest level is solved.
    """

    def __init__(self, matrix: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, coarsest: int = 400, damping: float = 0.6):
        self.damping, self.levels = damping, []
        while n > coarsest:
            i, j, x = matrix
            diagonal = np.bincount(i[i == j], x[i == j], n)
            group = self._trees(matrix, n)
            if group.max() + 1 > 0.9 * n:  # what is left has no connections
                break
            self.levels.append((matrix, np.where(diagonal > 0, diagonal, 1.0), group))
            matrix, n = self._merged(matrix, group), int(group.max()) + 1
        if n <= DENSE_LIMIT:
            dense = np.zeros((n, n))
            np.add.at(dense, matrix[:2], matrix[2])
            self.coarse = np.linalg.pinv(dense, hermitian=True)
        else:
            i, j, x = matrix
            diagonal = np.bincount(i[i == j], x[i == j], n)
            self.coarse = 1 / np.where(diagonal > 0, diagonal, 1.0)

    @staticmethod
    def _trees(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """New numbers of rows, one for each tree of strongest neighbours. Equal weights are told apart by a hash of the edge, so that choices end in a mutual one."""
        i, j, x = matrix
        off = i != j
        i, j, x = i[off], j[off], np.abs(x[off])
        edge = (np.minimum(i, j) * n + np.maximum(i, j)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = x * (1 + 1e-3 * (edge >> np.uint64(40)).astype(np.float64) / (1 << 24))
        best = np.arange(n)
        if len(i):  # entries come by rows
            cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            most = np.repeat(np.maximum.reduceat(x, cuts), np.diff(np.r_[cuts, len(i)]))
            first = np.flatnonzero(x == most)
            best[i[first]] = j[first]
        mutual = best[best] == np.arange(n)
        root = np.where(mutual, np.minimum(best, np.arange(n)), best)
        for _ in range(n.bit_length() + 1):
            root = root[root]
        return np.unique(root, return_inverse=True)[1]

    @staticmethod
    def _merged(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = int(group.max()) + 1
        code, index = np.unique(group[matrix[0]].astype(np.int64) * m + group[matrix[1]], return_inverse=True)
        return code // m, code % m, np.bincount(index, matrix[2], len(code))

    def __call__(self, r: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.levels):
            return self.coarse @ r if self.coarse.ndim == 2 else self.coarse[:, None] * r
        matrix, diagonal, group = self.levels[level]
        x = self.damping * r / diagonal[:, None]
        rest = r - _times(matrix, x)
        below = np.zeros((int(group.max()) + 1, r.shape[1]))
        np.add.at(below, group, rest)
        x += self(below, level + 1)[group]
        return x + self.damping * (r - _times(matrix, x)) / diagonal[:, None]


class Thin:
    """Solves of symmetric systems whose graph is thin, such as a curve's: rows by breadth-first levels make the matrix block tridiagonal, and blocks are eliminated in order.

    ``of`` gives nothing where a level has more than WIDEST rows.
    """

    def __init__(self, matrix: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, blocks: list[np.ndarray]):
        self.matrix, self.n, self.blocks = matrix, n, blocks
        i, j, x = matrix
        block, place = np.empty(n, np.int64), np.empty(n, np.int64)
        for k, own in enumerate(blocks):
            block[own], place[own] = k, np.arange(len(own))
        order = np.argsort(block[i], kind="stable")
        cuts = np.searchsorted(block[i][order], np.arange(len(blocks) + 1))
        self.own, self.low = [], []  # each block, and its part under the diagonal
        for k, rows in enumerate(blocks):
            at = order[cuts[k] : cuts[k + 1]]
            a, b, to, v = place[i[at]], place[j[at]], block[j[at]], x[at]
            for out, other in ((self.own, k), (self.low, k - 1)):
                part = np.zeros((len(rows), len(blocks[other]) if other >= 0 else 0))
                np.add.at(part, (a[to == other], b[to == other]), v[to == other])
                out.append(part)

    @classmethod
    def of(cls, matrix: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> Thin | None:
        i, j, _ = matrix  # by rows
        start = np.searchsorted(i, np.arange(n + 1))
        seen, blocks, held = np.zeros(n, bool), [], []
        left = np.arange(n)

        def levels(root: int, mark: np.ndarray) -> list[np.ndarray] | None:
            out, front = [], np.array([root])
            mark[root] = True
            while len(front):
                if len(front) > WIDEST:
                    return None
                out.append(front)
                begin, size = start[front], start[front + 1] - start[front]
                front = np.unique(j[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
                front = front[~mark[front]]
                mark[front] = True
            return out

        parts = 0
        while len(left := left[~seen[left]]):
            parts += 1
            far = levels(int(left[0]), seen.copy())
            found = levels(int(far[-1][0]), seen) if far is not None else None
            if found is None or parts > WIDEST:
                return None
            for level in found:
                held.append(level)
                if sum(map(len, held)) >= 32:
                    blocks.append(np.concatenate(held))
                    held = []
        return cls(matrix, n, blocks + ([np.concatenate(held)] if held else []))

    def factor(self, shift: float, sign: float) -> None:
        """Prepares solves with shift + sign A."""
        self.sign, self.inverse = sign, []
        for k, own in enumerate(self.own):
            d = sign * own + shift * np.eye(len(own))
            if k:
                d -= self.low[k] @ self.inverse[-1] @ self.low[k].T
            self.inverse.append(np.linalg.inv(d))

    def solve(self, b: np.ndarray) -> np.ndarray:
        parts = [b[rows] for rows in self.blocks]
        for k in range(1, len(parts)):
            parts[k] = parts[k] - self.sign * self.low[k] @ (self.inverse[k - 1] @ parts[k - 1])
        out, x = np.empty_like(b), None
        for k in reversed(range(len(parts))):
            rest = parts[k] if x is None else parts[k] - self.sign * self.low[k + 1].T @ x
            x = self.inverse[k] @ rest
            out[self.blocks[k]] = x
        return out

    def pairs(self, k: int, largest: bool, bound: float, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray] | None:
        """The k largest or smallest eigenpairs, by inverse iteration of a block around a shift just outside the spectrum's end, which moves there; nothing if it doesn't come to rest."""
        sign, tiny = (-1.0 if largest else 1.0), 2.0**-46 * bound
        end = bound if largest else 0.0  # smallest: of a positive semidefinite matrix, or found on the way
        x, old, last, moves = np.linalg.qr(start)[0], None, 0, []
        self.factor(tiny - sign * end, sign)
        for step in range(rounds):
            y = self.solve(x)
            inner = x.T @ y
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            x = np.linalg.qr(y @ turn)[0]
            now = (x * _times(self.matrix, x)).sum(0)
            moves.append(1.0 if old is None else self._moved(x[:, :k], old[:, :k]))
            # At rest, or as near as rounding allows where eigenvalues are hardly apart from each other.
            if step - last > 3 and moves[-1] <= 1e-11 or step - last > 8 and moves[-1] <= 1e-4 and moves[-1] > min(moves[-6:-1]) / 2:
                break
            old = x
            gap, spread = abs(end - now[0]), abs(now[k - 1] - now[0])
            if step - last >= 8 and gap > 4 * spread + 4 * tiny:  # the shift is far from the end
                end, last = now[0] - sign * 0.1 * spread, step
                self.factor(tiny - sign * end, sign)
        else:
            return None
        if abs(now[k - 1] - now[0]) <= 8 * np.finfo(float).eps * bound and k > 1:
            warnings.warn("the eigenvalues differ by less than rounding; the vectors span more than their space", stacklevel=4)
        order = np.argsort(-now[:k] if largest else now[:k], kind="stable")
        return now[:k][order], x[:, :k][:, order]

    @staticmethod
    def _moved(x: np.ndarray, old: np.ndarray) -> float:
        """How far a space moved: the sine of the largest angle."""
        return float(np.linalg.norm(x - old @ (old.T @ x), 2))


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Makes each column's entry of largest size positive; near ties go to the first row."""
    if not v.size:
        return v
    size = np.abs(v)
    first = np.argmax(size >= size.max(0) * (1 - 1e-9), axis=0)
    sign = np.sign(v[first, np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def _ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    small = basis.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def lobpcg(apply: Product, start: np.ndarray, k: int, tolerance: float, rounds: int, precondition: Product | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs: Rayleigh-Ritz on the block, its residuals and the last step, re-orthonormalised each round."""
    x, _ = np.linalg.qr(start)
    ax = apply(x)
    step = astep = None
    for _ in range(rounds):
        values, small = _ritz(x, ax, x.shape[1])
        x, ax = x @ small, ax @ small
        r = ax - x * values
        if np.sqrt((r[:, :k] ** 2).sum(0)).max() <= tolerance * max(1.0, np.abs(values[:k]).max()):
            break
        w = precondition(r) if precondition else r
        basis, image = [x], [ax]
        for block, given in ((w, None), (step, astep)):
            if block is None:
                continue
            have = np.concatenate(basis, 1)
            for _ in range(2):
                inner = have.T @ block
                block = block - have @ inner
                if given is not None:
                    given = given - np.concatenate(image, 1) @ inner
            q, t = np.linalg.qr(block)
            good = np.abs(np.diag(t)) > 1e-10
            if not good.any():
                continue
            if given is not None and good.all():
                g = np.linalg.solve(t.T, given.T).T
            else:
                q = q[:, good]
                g = apply(q)
            basis.append(q)
            image.append(g)
        b, a = np.concatenate(basis, 1), np.concatenate(image, 1)
        _, small = _ritz(b, a, x.shape[1])
        width = x.shape[1]
        step, astep = b[:, width:] @ small[width:], a[:, width:] @ small[width:]
        x, ax = b @ small, a @ small
        x, t = np.linalg.qr(x)
        ax = np.linalg.solve(t.T, ax.T).T
    values, small = _ritz(x, ax, k)
    return values, x @ small


def lanczos(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int, tolerance: float, rounds: int, depth: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs by block Krylov spaces of ``depth`` blocks with full reorthogonalisation, restarted from the best Ritz vectors."""
    x, _ = np.linalg.qr(start)
    for _ in range(max(1, rounds // depth)):
        basis, image = [x], [apply(x)]
        for _ in range(depth - 1):
            block = image[-1]
            have = np.concatenate(basis, 1)
            for _ in range(2):
                block = block - have @ (have.T @ block)
            q, t = np.linalg.qr(block)
            q = q[:, np.abs(np.diag(t)) > 1e-10]
            if not q.shape[1]:
                break
            basis.append(q)
            image.append(apply(q))
        b, a = np.concatenate(basis, 1), np.concatenate(image, 1)
        values, small = _ritz(b, a, x.shape[1])
        x, ax = b @ small, a @ small
        if np.sqrt(((ax - x * values)[:, :k] ** 2).sum(0)).max() <= tolerance * max(1.0, np.abs(values[:k]).max()):
            break
        x, _ = np.linalg.qr(x)
    return values[:k], x[:, :k]


def arnoldi(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenpairs of largest real part of a matrix that need not be symmetric, by restarted block Krylov spaces; real parts."""
    x, _ = np.linalg.qr(start)
    for _ in range(max(1, rounds // 5)):
        basis, image = [x], [apply(x)]
        for _ in range(4):
            have, block = np.concatenate(basis, 1), image[-1]
            for _ in range(2):
                block = block - have @ (have.T @ block)
            q, t = np.linalg.qr(block)
            q = q[:, np.abs(np.diag(t)) > 1e-10]
            if not q.shape[1]:
                break
            basis.append(q)
            image.append(apply(q))
        b, a = np.concatenate(basis, 1), np.concatenate(image, 1)
        values, small = _real_order(*np.linalg.eig(b.T @ a))
        vectors, images = b @ small[:, :k], a @ small[:, :k]
        if np.sqrt((np.abs(images - vectors * values[:k]) ** 2).sum(0)).max() <= tolerance * max(1.0, np.abs(values[:k]).max()):
            break
        wide = small[:, : x.shape[1]]
        x, _ = np.linalg.qr(b @ np.concatenate([wide.real, wide.imag], 1)[:, : 2 * x.shape[1]])
        x = x[:, : start.shape[1] * 2]
    return _real(values[:k], vectors)


def _real_order(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs by falling real part."""
    order = np.argsort(-values.real, kind="stable")
    return values[order], vectors[:, order]


def _real(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real parts, vectors of length one."""
    if np.abs(values.imag).max(initial=0) > 1e-9 * max(1.0, np.abs(values).max(initial=0)):
        warnings.warn("some eigenvalues are complex; real parts are kept", stacklevel=3)
    v = vectors.real
    length = np.sqrt((v * v).sum(0))
    return values.real, v / np.where(length > 0, length, 1)


def solve(
    matrix: DataFrame, value: str, ids: DataFrame, k: int, solver: str = "auto", largest: bool = True,
    tolerance: float = 1e-8, rounds: int = 300, seed: int = 0, symmetric: bool | None = None, factor: bool = False, paths: PathRows | None = None, other: DataFrame | None = None,
) -> Eigenpairs:
    """The k largest (descending) or smallest (ascending) eigenpairs of a matrix; ids without entries are rows of zeros.

    With ``factor`` the entries are those of B, and the matrix is B B^T. Where that has
    more than LOCAL_ENTRIES entries it is not formed: products go by B and its transpose. With
    ``other``, a table like B, the matrix is B C^T, C being ``other``, and counts as not symmetric.
    With ``paths`` the entries are those of their centred matrix over a connected graph, and products go by the packed rows.

    A matrix that is not symmetric (found out unless ``symmetric`` says so) is
    solved by ``dense`` or ``arpack``, by real parts; the other solvers refuse it.
    """
    n = ids.select("id").distinct().count()
    k = min(k, n)
    name = choose_solver(solver, n, k)
    if factor:
        symmetric = other is None
        count = matrix.groupBy("j").agg(F.count("*").alias("a"))
        theirs = count.withColumnRenamed("a", "b") if other is None else other.groupBy("j").agg(F.count("*").alias("b"))
        squares = count.join(theirs, "j").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        if name == "dense" or squares <= LOCAL_ENTRIES:
            matrix, factor, other = formed(matrix, value, other), False, None
    if name == "distributed":
        if not (is_symmetric(matrix, value, 1e-9) if symmetric is None else symmetric):
            raise ValueError("distributed needs a symmetric matrix")
        shift = 0.0
        if not largest:
            shift = (factor_bound(matrix, value) if factor else matrix.groupBy("i").agg(F.sum(F.abs(value)).alias("s")).agg(F.max("s")).first()[0]) or 1.0
        values, vectors = largest_pairs(matrix, value, ids, k, shift, max(tolerance, 1e-7), rounds, seed, factor)
        return Eigenpairs(values if largest else shift - values, fixed_signs(vectors, k))
    op = PathOperator(paths, matrix, value, ids) if paths else FactorOperator(matrix, value, ids, n, other) if factor else Operator(matrix, value, ids, n)
    if symmetric is None:
        symmetric = is_symmetric(op.rows, "x", 1e-10 * max(1.0, op.bound()))
    if not symmetric and name not in ("dense", "arpack"):
        if solver != "auto":
            raise ValueError(f"{name} needs a symmetric matrix")
        name = "arpack"
    if name == "dense":
        full = op.dense()
        if symmetric:
            values, vectors = np.linalg.eigh((full + full.T) / 2)
            values, vectors = values[::-1], vectors[:, ::-1]
        else:
            values, vectors = _real(*_real_order(*np.linalg.eig(full)))
        if not largest:
            values, vectors = values[::-1], vectors[:, ::-1]
        values, vectors = values[:k], vectors[:, :k]
    else:
        width = min(op.n, k + 5)
        if op.n * width > BLOCK_LIMIT:
            raise ValueError(f"a block of {op.n} x {width} numbers is too large for the driver")
        found = _thin(op, k, largest, seed) if solver == "auto" and symmetric else None
        shift = 0.0 if largest else op.bound()
        apply = op.apply if largest else (lambda x: shift * x - op.apply(x))
        start = np.random.default_rng(seed).standard_normal((op.n, width))
        if found is not None:
            values, vectors = found
        elif solver == "auto" and symmetric and op.local() is None:  # each product is a job, and deep spaces need few
            depth = max(5, min(MOST_DEEP, KRYLOV_NUMBERS // (2 * start.size)))
            values, vectors = lanczos(apply, start, k, tolerance, rounds, depth)
        elif name == "arpack":
            values, vectors = (lanczos if symmetric else arnoldi)(apply, start, k, tolerance, rounds)
        else:
            values, vectors = lobpcg(apply, start, k, tolerance, rounds, _multigrid(op, largest) if name == "amg" else None)
        if not largest and found is None:
            values = shift - values
        if solver == "dense" and np.abs(op.apply(vectors) - vectors * values).max() > 1e-6 * max(1.0, np.abs(values).max()):
            warnings.warn("the pairs have not converged, and the dense matrix is too large for the driver", stacklevel=2)
        op.release()
    vectors = fix_signs(vectors)
    return Eigenpairs(values, op.frame(vectors), op.ids, vectors)


def _thin(op: Operator, k: int, largest: bool, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenpairs by solves, where the matrix is on the driver and its graph thin: block iterations need more rounds the longer a curve is."""
    local = None if isinstance(op, FactorOperator) else op.local()
    thin = Thin.of(local, op.n) if local is not None else None
    if thin is None:
        return None
    return thin.pairs(k, largest, op.bound(), np.random.default_rng(seed).standard_normal((op.n, min(op.n, k + 12))))


def _multigrid(op: Operator, largest: bool) -> Callable[[np.ndarray], np.ndarray]:
    """A preconditioner for the wanted end of the spectrum: multigrid on bound - A or on A, or its diagonal where the matrix is too large for the driver."""
    ridge = 1e-3 * op.bound() / max(op.n, 1) + 1e-12
    local = None if isinstance(op, FactorOperator) else op.local()
    shift = op.bound() if largest else 0.0
    if local is None:
        warnings.warn("the matrix is too large for multigrid on the driver; its diagonal is used", stacklevel=3)
        gap = np.maximum(shift - op.diagonal() if largest else op.diagonal(), ridge) + ridge
        return lambda r: r / gap[:, None]
    own = np.arange(op.n)
    i, j, x = np.r_[local[0], own], np.r_[local[1], own], np.r_[-local[2] if largest else local[2], np.full(op.n, shift + ridge)]
    code, index = np.unique(i.astype(np.int64) * op.n + j, return_inverse=True)
    return Multigrid((code // op.n, code % op.n, np.bincount(index, x, len(code))), op.n)


def null_space(matrix: DataFrame, value: str, ids: DataFrame, k: int, k_skip: int = 1, solver: str = "auto", **parameters) -> tuple[Eigenpairs, float]:
    """The k eigenpairs of smallest eigenvalue after the first ``k_skip``, of a positive semidefinite matrix, and the sum of these eigenvalues."""
    found = solve(matrix, value, ids, k + k_skip, solver, largest=False, symmetric=True, **parameters)
    values, vectors = found.values[k_skip:], found.vectors.select("id", F.slice("v", k_skip + 1, k).alias("v"))
    return Eigenpairs(values, vectors, found.ids, found.matrix[:, k_skip:] if found.matrix is not None else None), float(values.sum())


def residuals(matrix: DataFrame, value: str, pairs: Eigenpairs) -> np.ndarray:
    """|A v - lambda v| of each pair found on the driver."""
    ids = pairs.vectors.select("id")
    op = Operator(matrix, value, ids)
    out = np.sqrt(((op.apply(pairs.matrix) - pairs.matrix * pairs.values) ** 2).sum(0))
    op.release()
    return out
