"""Kernels of word vectors as operators inside Spark tasks, without a table of all pairs of words."""

from __future__ import annotations

import numpy as np

#: Share of the vectors' squared lengths below which a squared distance is computed from the difference.
CLOSE = 1e-4

#: Words on a side of a tile, and doubles that a task keeps of a kernel or of its factor.
TILE, KEPT_VALUES = 1024, 32_000_000

#: Largest relative error that a product with the factor may have; beyond it the exact tiles are used.
RELATIVE = 1e-9


def squared_distances(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """All squared distances between rows, by one matrix product.

    Where two rows are so close that the product cancels, the distance comes from their difference.
    """
    center = X.mean(axis=0) if len(X) else 0.0
    X, Y = X - center, Y - center
    x2, y2 = (X * X).sum(axis=1), (Y * Y).sum(axis=1)
    lengths = x2[:, None] + y2[None, :]
    out = lengths - 2.0 * (X @ Y.T)
    near, to = np.nonzero(out <= CLOSE * lengths)
    step = max(1, (1 << 22) // max(1, X.shape[1]))
    for at in range(0, len(near), step):
        i, j = near[at : at + step], to[at : at + step]
        out[i, j] = ((X[i] - Y[j]) ** 2).sum(axis=1)
    return out


def distances(X: np.ndarray, Y: np.ndarray, rooted: bool) -> np.ndarray:
    out = squared_distances(X, Y)
    return np.sqrt(out) if rooted else out


class VectorKernel:
    """``K[i, j] = exp(-distance(x_i, x_j) / eps)`` as far as scaling iterations need it: products.

    Tiles are made when they are used; as many as fit are kept. With a ``factor`` L, whose product
    ``L L'`` differs from K by at most ``residual`` in every entry, a product takes L instead if the error
    that this can cause, which is known from the operand, is relatively below ``RELATIVE``.
    """

    def __init__(self, vectors: np.ndarray, eps: float, rooted: bool = False, factor=None, residual: float = 0.0):
        self.vectors, self.eps, self.rooted = vectors, eps, rooted
        self.factor, self.residual = factor, residual
        self.shape = (len(vectors), len(vectors))
        self._kept, self._room = {}, KEPT_VALUES

    @property
    def T(self):
        return self

    def columns(self, at: np.ndarray) -> np.ndarray:
        """Some columns, as an array."""
        return np.exp(-distances(self.vectors, self.vectors[at], self.rooted) / self.eps)

    def _tile(self, r: int, c: int) -> np.ndarray:
        if (r, c) in self._kept:
            return self._kept[r, c]
        X, Y = self.vectors[r : r + TILE], self.vectors[c : c + TILE]
        tile = np.exp(distances(X, Y, self.rooted) / -self.eps)
        if tile.size <= self._room:
            self._kept[r, c] = tile
            self._room -= tile.size
        return tile

    def exactly(self, V: np.ndarray) -> np.ndarray:
        """The product by tiles; of two mirrored tiles one is made."""
        out = np.zeros_like(V)
        starts = range(0, len(self.vectors), TILE)
        for r in starts:
            for c in starts:
                if c < r:
                    continue
                tile = self._tile(r, c)
                out[r : r + TILE] += tile @ V[c : c + TILE]
                if c > r:
                    out[c : c + TILE] += tile.T @ V[r : r + TILE]
        return out

    def __matmul__(self, V: np.ndarray) -> np.ndarray:
        if self.factor is None:
            return self.exactly(V)
        out = self.factor @ (self.factor.T @ V)
        with np.errstate(all="ignore"):
            most = self.residual * np.abs(V).sum(axis=0)
            size = np.abs(out)
            # sums of positive terms are wanted exact in every entry, others against the largest
            signed = (V < 0).any(axis=0)
            wanted = RELATIVE * np.where(signed, size.max(axis=0), size.min(axis=0))
            unsure = ~(most <= wanted)
        if unsure.any():
            out[..., unsure] = self.exactly(np.ascontiguousarray(V[..., unsure]))
        return out


class PairKernel:
    """The kernel between two sets of vectors, rows of ``X`` by rows of ``Y``, in blocks of columns.

    Blocks of ``values`` numbers are made when they are used, and those that fit into ``kept`` numbers are kept,
    so memory does not grow with the product of both sizes.
    """

    def __init__(self, X: np.ndarray, Y: np.ndarray, eps: float, rooted: bool = False, values: int = TILE * TILE, kept: int = KEPT_VALUES):
        self.X, self.Y, self.eps, self.rooted = X, Y, eps, rooted
        self.width, self._kept, self._room = max(1, values // max(1, len(X))), {}, kept

    def costs(self):
        """``(columns, cost)`` of every block."""
        for at in range(0, len(self.Y), self.width):
            columns = slice(at, at + self.width)
            yield columns, distances(self.X, self.Y[columns], self.rooted)

    def kernels(self):
        """``(columns, exp(-cost / eps))`` of every block."""
        for at in range(0, len(self.Y), self.width):
            columns = slice(at, at + self.width)
            block = self._kept.get(at)
            if block is None:
                block = np.exp(distances(self.X, self.Y[columns], self.rooted) / -self.eps)
                if block.size <= self._room:
                    self._kept[at] = block
                    self._room -= block.size
            yield columns, block

    def __matmul__(self, V: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.X), V.shape[1]))
        for columns, block in self.kernels():
            out += block @ V[columns]
        return out

    @property
    def T(self):
        return _Transposed(self)


class _Transposed:
    """The other direction of a :class:`PairKernel`."""

    def __init__(self, kernel: PairKernel):
        self.kernel = kernel

    def __matmul__(self, U: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.kernel.Y), U.shape[1]))
        for columns, block in self.kernel.kernels():
            out[columns] = block.T @ U
        return out


def factorize(vectors: np.ndarray, eps: float, rooted: bool, residual: float = 1e-15, values: int = KEPT_VALUES):
    """``(L, residual)`` with ``L L'`` equal to the kernel up to ``residual`` in every entry, or None.

    Pivoted Cholesky: the kernel is positive definite, so no entry of what is left exceeds the largest of its
    diagonal. None if L would not be well below the kernel's size or exceed ``values``.
    """
    n = len(vectors)
    most = min(n // 4, values // max(1, n))
    if most < 1:
        return None
    kernel = VectorKernel(vectors, eps, rooted)
    L, left = np.zeros((n, most)), np.ones(n)
    for k in range(most):
        at = int(left.argmax())
        if left[at] <= residual:
            # what rounding may hide beside the diagonal
            return np.ascontiguousarray(L[:, :k]), residual + 4e-16
        column = kernel.columns(np.array([at]))[:, 0] - L[:, :k] @ L[at, :k]
        L[:, k] = column / np.sqrt(left[at])
        left = np.maximum(left - L[:, k] ** 2, 0.0)
        left[at] = 0.0
    return None
