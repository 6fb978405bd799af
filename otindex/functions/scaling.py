"""Array helpers used inside Spark tasks: scaling iterations on a stack of problems.

Each function handles the few problems of one Arrow chunk at once, so that one matrix product
serves all of them. Problems stop on their own error, never on that of their neighbours, which
keeps results independent of how Spark cut the table.
"""

from __future__ import annotations

import numpy as np

CONVERGED, MAX_ITER, NONFINITE = "converged", "max_iter", "nonfinite"

#: Doubles of one block of a sum in the log domain.
BLOCK_VALUES = 500_000

#: Rounds between two looks at the error, the same however a problem is laid out.
CHECK_EVERY = 10


def _ratio(top, bottom):
    """``top / bottom`` where ``top`` is positive, else zero."""
    with np.errstate(all="ignore"):
        out, positive = top / bottom, top > 0
    return out if positive.all() else np.where(positive, out, 0.0)


def lse(x, axis):
    """Log of the sum of exponentials, shifted by the maximum along the axis."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# --- transport between pairs: columns of A and B are problems -------------------------------


def scale_pairs(K, A, B, max_iter, tol, trail=None, check_every=CHECK_EVERY):
    """Scalings ``U, V`` per column with the status of each problem.

    Errors are looked at every ``check_every`` rounds and after the last one. A problem that is not
    finite then keeps the state and the number of rounds of the check before.
    ``trail`` collects ``(problems, V at the start)`` per round for the reverse sweep. ``K`` may be any part
    of a kernel: rows are the points of ``A``, columns those of ``B``.
    """
    count = A.shape[1]
    U, V = (A > 0).astype(float), (B > 0).astype(float)
    status = np.full(count, MAX_ITER, dtype=object)
    rounds, error = np.zeros(count, int), np.full(count, np.inf)
    live, done = np.arange(count), 0
    while live.size and done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        a, b, v = A[:, live], B[:, live], V[:, live]
        walked = []
        for _ in range(steps):
            v0 = v
            u = _ratio(a, K @ v0)
            v = _ratio(b, K.T @ u)
            walked.append(v0)
        with np.errstate(all="ignore"):
            gap = np.sqrt(((a - u * (K @ v)) ** 2).sum(axis=0))
        good = np.isfinite(u).all(axis=0) & np.isfinite(v).all(axis=0) & np.isfinite(gap)
        status[live[~good]], error[live[~good]] = NONFINITE, np.inf
        kept = live[good]
        U[:, kept], V[:, kept], error[kept] = u[:, good], v[:, good], gap[good]
        rounds[kept] = done
        if trail is not None:
            trail.extend((kept, x[:, good]) for x in walked)
        closed = gap[good] < tol
        status[kept[closed]] = CONVERGED
        live = kept[~closed]
    return U, V, status, rounds, error


def _log_positive(x):
    """The logarithm, minus infinity for zero."""
    with np.errstate(divide="ignore"):
        return np.log(x)


def scale_pairs_log(C, A, B, eps, max_iter, tol, check_every=CHECK_EVERY):
    """Potentials ``F, G`` of a stack of problems in the log domain; checked as above.

    ``C`` is ``(problems, a, b)``, ``A`` and ``B`` are ``(problems, a)`` and ``(problems, b)``. Problems
    of different sizes are padded with points without mass, whose cost does not matter.
    """
    on_a, on_b = A > 0, B > 0
    log_a, log_b = _log_positive(A), _log_positive(B)
    count = len(C)
    F, G = np.zeros_like(A), np.zeros_like(B)
    status = np.full(count, MAX_ITER, dtype=object)
    rounds, error = np.zeros(count, int), np.full(count, np.inf)
    live, done = np.arange(count), 0
    while live.size and done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        some = slice(None) if live.size == count else live
        la, lb, oa, ob = log_a[some], log_b[some], on_a[some], on_b[some]
        negative = -C[some] / eps
        negative[~(oa[:, :, None] & ob[:, None, :])] = -np.inf
        g = np.where(ob, G[some] / eps, 0.0)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                f = np.where(oa, la - lse(negative + g[:, None, :], 2), 0.0)
                g = np.where(ob, lb - lse(negative + f[:, :, None], 1), 0.0)
            mass = np.exp(negative + f[:, :, None] + g[:, None, :]).sum(axis=2)
            gap = np.sqrt(((mass - A[some]) ** 2).sum(axis=1))
        good = np.isfinite(f).all(axis=1) & np.isfinite(g).all(axis=1) & np.isfinite(gap)
        status[live[~good]], error[live[~good]] = NONFINITE, np.inf
        kept = live[good]
        F[kept], G[kept], rounds[kept], error[kept] = eps * f[good], eps * g[good], done, gap[good]
        closed = gap[good] < tol
        status[kept[closed]] = CONVERGED
        live = kept[~closed]
    return F, G, status, rounds, error


def scale_pair_log(costs, a, b, eps, max_iter, tol, check_every=CHECK_EVERY):
    """:func:`scale_pairs_log` for one problem with mass everywhere, whose cost comes in blocks of columns.

    ``costs()`` gives ``(columns, cost)`` of every block, again for each walk.
    """
    log_a, log_b = np.log(a), np.log(b)
    F, G, rounds, error, done = np.zeros(len(a)), np.zeros(len(b)), 0, np.inf, 0
    while done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        g = G / eps
        with np.errstate(all="ignore"):
            for _ in range(steps):
                top, total = np.full(len(a), -np.inf), np.zeros(len(a))
                for columns, cost in costs():
                    level = g[None, columns] - cost / eps
                    higher = np.maximum(top, level.max(axis=1))
                    total = total * np.exp(top - higher) + np.exp(level - higher[:, None]).sum(axis=1)
                    top = higher
                f, g = log_a - np.log(total) - top, np.empty(len(b))
                for columns, cost in costs():
                    g[columns] = log_b[columns] - lse(f[:, None] - cost / eps, 0)
            mass = np.zeros(len(a))
            for columns, cost in costs():
                mass += np.exp(f[:, None] + g[None, columns] - cost / eps).sum(axis=1)
            gap = np.sqrt(((mass - a) ** 2).sum())
        if not (np.isfinite(f).all() and np.isfinite(g).all() and np.isfinite(gap)):
            return F, G, NONFINITE, rounds, np.inf
        F, G, rounds, error = eps * f, eps * g, done, gap
        if gap < tol:
            return F, G, CONVERGED, rounds, error
    return F, G, MAX_ITER, rounds, error


def pairs_reverse(K, A, B, trail, Ubar, Vbar):
    """Gradient with respect to ``A`` of a function of the final ``U, V``, by reverse sweep.

    One problem may be swept for many functions at once: one column of ``A`` and a column of bars each.
    """
    Abar = np.zeros_like(Ubar)
    if A.shape[1] == 1:  # one column of each round serves all functions
        after, on = np.array(Vbar), A > 0
        for live, v0 in reversed(trail):
            if not len(live):
                continue
            kv = K @ v0
            u = _ratio(A, kv)
            t = K.T @ u
            ubar = K @ (-_ratio(_ratio(B, t), t) * after)
            if Ubar is not None:
                ubar, Ubar = ubar + Ubar, None
            Abar += np.where(on, ubar / kv, 0.0)
            after = K.T @ (-_ratio(u, kv) * ubar)
        return Abar
    started = np.zeros(Ubar.shape[1], bool)
    Ubar, Vbar = Ubar.copy(), Vbar.copy()
    for live, v0 in reversed(trail):
        if not len(live):
            continue
        first = ~started[live]
        ubar = np.where(first, Ubar[:, live], 0.0)
        started[live] = True
        kv = K @ v0
        u = _ratio(A[:, live], kv)
        t = K.T @ u
        tbar = -Vbar[:, live] * _ratio(_ratio(B[:, live], t), t)
        ubar = ubar + K @ tbar
        Abar[:, live] += np.where(A[:, live] > 0, ubar / kv, 0.0)
        Vbar[:, live] = K.T @ (-ubar * _ratio(u, kv))
    return Abar


# --- barycenters: axis 0 words, axis 1 problems, axis 2 atoms; within a round, axis 1 atoms, axis 2 problems ----


def _product(K, X):
    return (K @ X.reshape(X.shape[0], -1)).reshape(K.shape[0], *X.shape[1:])


def _half_rounds(K, A, W, V, d):
    """Everything one round computes from its start ``V, d``.

    Atoms come before problems, as arrays whose last axis is a handful of atoms are slow to walk through.
    """
    KV = _product(K, V)
    U = _ratio(A, KV)
    T = _product(K.T, U)
    with np.errstate(all="ignore"):
        L = np.log(T)
        b = d * np.exp((W[None] * L).sum(axis=1))
        return KV, U, T, L, b, b[:, None, :] / T


def _corrected(K, d, b):
    """The next correction of a debiased barycenter."""
    with np.errstate(all="ignore"):
        return np.sqrt(d * b / (K @ d))


def barycenters(K, A, W, max_iter, tol, debias=False, trail=None, check_every=CHECK_EVERY, whole=True):
    """Barycenter of the atoms ``A[:, p, :]`` (or shared ``A[:, 0, :]``) per weight row ``W[p]``.

    Checked as :func:`scale_pairs`. ``trail`` collects ``(problems, starts, rounds)`` per check for the
    reverse sweep, where starts are ``(V, d)`` of every round or, if not ``whole``, of the first only.
    """
    size, count, atoms = K.shape[0], *W.shape
    A, W = A.transpose(0, 2, 1), np.ascontiguousarray(W.T)
    V, d, out = np.ones((size, atoms, count)), np.ones((size, count)), np.zeros((size, count))
    status = np.full(count, MAX_ITER, dtype=object)
    rounds, error = np.zeros(count, int), np.full(count, np.inf)
    live, done = np.arange(count), 0
    while live.size and done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        a = A if A.shape[2] == 1 else A[:, :, live]
        v, d1, w = V[:, :, live], d[:, live], W[:, live]
        walked = []
        for _ in range(steps):
            v0, d0 = v, d1
            _, u, _, _, b, v = _half_rounds(K, a, w, v0, d0)
            d1 = _corrected(K, d0, b) if debias else d0
            if trail is not None and (whole or not walked):
                walked.append((v0, d0))
        with np.errstate(all="ignore"):
            gap = ((a - u * _product(K, v)) ** 2).sum(axis=(0, 1))
            # the marginals may fit while the correction still moves
            gap = np.sqrt(gap + ((d1 - d0) ** 2).sum(axis=0))
        good = np.isfinite(v).all(axis=(0, 1)) & np.isfinite(d1).all(axis=0) & np.isfinite(gap)
        status[live[~good]], error[live[~good]] = NONFINITE, np.inf
        kept = live[good]
        V[:, :, kept], d[:, kept], out[:, kept] = v[:, :, good], d1[:, good], b[:, good]
        rounds[kept], error[kept] = done, gap[good]
        if trail is not None:
            starts = walked if good.all() else [(v[:, :, good], d[:, good]) for v, d in walked]
            trail.append((kept, starts, steps))
        closed = gap[good] < tol
        status[kept[closed]] = CONVERGED
        live = kept[~closed]
    return out, status, rounds, error


def log_product(C, X, eps):
    """``log(sum_j exp(X[j, c] - C[i, j] / eps))``: a matrix product of logarithms, in blocks.

    Every sum is shifted by its own maximum, so nothing underflows however large the cost.
    """
    out = np.empty((C.shape[0], X.shape[1]))
    for rows, columns, negative in _blocks(C, X.shape[1], eps):
        block = np.ascontiguousarray(X[:, columns].T)
        out[rows, columns] = lse(negative[:, None, :] + block[None, :, :], 2)
    return out


def log_product_reverse(C, X, out, bar, eps):
    """Gradient by ``X`` of what :func:`log_product` gave as ``out``, from the gradient by ``out``.

    The weights ``exp(X[j] - C[i, j] / eps - out[i])`` of a sum are shares, so they cannot overflow.
    """
    back = np.zeros_like(X)
    for rows, columns, negative in _blocks(C, X.shape[1], eps):
        level = np.ascontiguousarray(X[:, columns].T)[None] - out[rows, columns][:, :, None]
        share = np.exp(np.where(np.isfinite(level), negative[:, None, :] + level, -np.inf))
        back[:, columns] += np.einsum("ic,icj->jc", bar[rows, columns], share)
    return back


def _blocks(C, columns, eps):
    """``(rows, columns, -C[rows] / eps)`` so that rows x columns x the other side stays within bounds."""
    rows = max(1, min(C.shape[0], BLOCK_VALUES // max(1, C.shape[1])))
    for at in range(0, C.shape[0], rows):
        negative = -C[at : at + rows] / eps
        wide = max(1, BLOCK_VALUES // negative.size)
        for c in range(0, columns, wide):
            yield slice(at, at + rows), slice(c, c + wide), negative


class ExpSmoothing:
    """``log(K exp(X))`` and the same with K transposed, by plain matrix products."""

    def __init__(self, K):
        self.K = K

    def __call__(self, X):
        with np.errstate(all="ignore"):
            return np.log(self.K @ np.exp(X))

    def transposed(self, X):
        with np.errstate(all="ignore"):
            return np.log(self.K.T @ np.exp(X))


class LogSmoothing:
    """The same from the cost, in the log domain, with gradients."""

    def __init__(self, C, eps):
        self.C, self.eps = C, eps

    def __call__(self, X):
        return log_product(self.C, X, self.eps)

    def transposed(self, X):
        return log_product(self.C.T, X, self.eps)

    def reverse(self, X, out, bar):
        return log_product_reverse(self.C, X, out, bar, self.eps)

    def transposed_reverse(self, X, out, bar):
        return log_product_reverse(self.C.T, X, out, bar, self.eps)


def barycenter_groups(smooth, A, w, starts, max_iter, tol, debias=False, check_every=CHECK_EVERY):
    """Barycenters of a stack of groups with any numbers of members, from logarithms.

    Members are the columns of ``A`` with weights ``w``; group g is the columns from ``starts[g]`` to
    the next start. ``smooth`` is one of the smoothings above. Checked as :func:`scale_pairs`; a group
    whose first check is not finite has no rounds.
    """
    size, members, groups = A.shape[0], A.shape[1], len(starts)
    of = np.repeat(np.arange(groups), np.diff(np.append(starts, members)))
    log_a, on = _log_positive(A), A > 0
    out = np.zeros((size, groups))
    status = np.full(groups, MAX_ITER, dtype=object)
    rounds, error = np.zeros(groups, int), np.full(groups, np.inf)
    live, columns, done = np.arange(groups), np.arange(members), 0
    d, v = np.zeros((size, groups)), np.zeros((size, members))
    while live.size and done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        la, a, plus, weight = log_a[:, columns], A[:, columns], on[:, columns], w[columns]
        begin = np.flatnonzero(np.concatenate(([True], of[columns][1:] != of[columns][:-1])))
        own = np.repeat(np.arange(live.size), np.diff(np.append(begin, columns.size)))
        with np.errstate(all="ignore"):
            kv = smooth(v)
            for _ in range(steps):
                before = d
                u = np.where(plus, la - kv, -np.inf)
                t = smooth.transposed(u)
                b = before + np.add.reduceat(t * weight, begin, axis=1)
                v = b[:, own] - t
                d = (before + b - smooth(before)) / 2 if debias else before
                kv = smooth(v)
            gap = np.add.reduceat(((a - np.exp(u + kv)) ** 2).sum(axis=0), begin)
            # the marginals may fit while the correction still moves
            gap = np.sqrt(gap + ((np.exp(d) - np.exp(before)) ** 2).sum(axis=0))
        broken = np.logical_or.reduceat(~np.isfinite(v).all(axis=0), begin)
        good = ~broken & np.isfinite(d).all(axis=0) & np.isfinite(gap)
        status[live[~good]], error[live[~good]] = NONFINITE, np.inf
        kept = live[good]
        out[:, kept], rounds[kept], error[kept] = np.exp(b[:, good]), done, gap[good]
        closed = gap[good] < tol
        status[kept[closed]] = CONVERGED
        going = good.copy()
        going[good] = ~closed
        live, d = live[going], d[:, going]
        columns, v = columns[going[own]], v[:, going[own]]
    return out, status, rounds, error


def barycenters_reverse(K, A, W, trail, bbar, debias=False):
    """Gradients ``(wrt A per problem, wrt W)`` of a function of the barycenters, by reverse sweep.

    One problem may be swept for many functions at once: one row of ``W`` and a column of ``bbar`` each.

    Each round is recomputed from its start, so memory grows with one scaling per round or, where only
    the first start of a check was stored, per check.
    """
    size, count, atoms, one = K.shape[0], bbar.shape[1], W.shape[1], len(W) == 1
    A, W = A.transpose(0, 2, 1), np.ascontiguousarray(W.T)
    Abar, Wbar = np.zeros((size, atoms, count)), np.zeros((atoms, count))
    Vbar, dbar = np.zeros((size, atoms, count)), np.zeros((size, count))
    started = np.zeros(count, bool)
    for live, starts, rounds in reversed(trail):
        if not len(live):
            continue
        live = slice(None) if one or len(live) == count else live
        a = A if A.shape[2] == 1 else A[:, :, live]
        w = W[:, live]
        starts = list(starts)
        while len(starts) < rounds:
            v, d = starts[-1]
            *_, b, after = _half_rounds(K, a, w, v, d)
            starts.append((after, _corrected(K, d, b) if debias else d))
        for v0, d0 in reversed(starts):
            vbar = Vbar[:, :, live]
            KV, U, T, L, b, V = _half_rounds(K, a, w, v0, d0)
            from_b = np.where(started[live], 0.0, bbar[:, live])
            started[live] = True
            from_b = from_b + (vbar / T).sum(axis=1)
            if debias:
                Kd = K @ d0
                step = dbar[:, live] * np.sqrt(d0 * b / Kd) / 2
                from_b = from_b + step / b
                dbar[:, live] = step / d0 - K.T @ (step / Kd) + from_b * b / d0
            share = (from_b * b)[:, None, :]
            Wbar[:, live] += (share * L).sum(axis=0)
            Ubar = _product(K, (w[None] * share - vbar * V) / T) / KV
            Abar[:, :, live] += Ubar
            Vbar[:, :, live] = -_product(K.T, Ubar * U)
    return Abar.transpose(0, 2, 1), Wbar.T


# --- reverse sweeps in the log domain --------------------------------------------------------


def log_barycenters(smooth, log_a, W, max_iter, tol, debias=False, trail=None, check_every=CHECK_EVERY):
    """As :func:`barycenters` for atoms shared by all problems, from logarithms; the result too is one.

    ``trail`` collects ``(problems, (v, d) at the start of a check, rounds)`` for :func:`log_barycenters_reverse`.
    """
    size, (count, atoms) = len(log_a), W.shape
    v, d = np.zeros((size, count, atoms)), np.zeros((size, count))
    out = np.full((size, count), -np.inf)
    status = np.full(count, MAX_ITER, dtype=object)
    rounds, error = np.zeros(count, int), np.full(count, np.inf)
    live, done = np.arange(count), 0
    while live.size and done < max_iter:
        steps = min(check_every, max_iter - done)
        done += steps
        start = v, d
        for _ in range(steps):
            before = d
            kv, u, t, b, kd, v, d = _log_round(smooth, log_a, W[live], v, before, debias)
        with np.errstate(all="ignore"):
            gap = ((np.exp(log_a)[:, None] - np.exp(u + _log_apply(smooth, v))) ** 2).sum(axis=(0, 2))
            gap = np.sqrt(gap + ((np.exp(d) - np.exp(before)) ** 2).sum(axis=0))
        good = np.isfinite(v).all(axis=(0, 2)) & np.isfinite(d).all(axis=0) & np.isfinite(gap)
        status[live[~good]], error[live[~good]] = NONFINITE, np.inf
        kept = live[good]
        out[:, kept], rounds[kept], error[kept] = b[:, good], done, gap[good]
        if trail is not None:
            trail.append((kept, start[0][:, good], start[1][:, good], steps))
        closed = gap[good] < tol
        status[kept[closed]] = CONVERGED
        live = kept[~closed]
        v, d = v[:, good][:, ~closed], d[:, good][:, ~closed]
    return out, status, rounds, error


def _log_apply(product, x, *more):
    """A log product over the last two axes of ``x`` taken as columns."""
    flat = [y.reshape(len(y), -1) for y in (x, *more)]
    return product(*flat).reshape(x.shape)


def _log_round(smooth, log_a, W, v, d, debias):
    """One round from ``v, d``, with everything that its reverse needs."""
    with np.errstate(all="ignore"):
        kv = _log_apply(smooth, v)
        u = np.where(np.isfinite(log_a)[:, None], log_a[:, None] - kv, -np.inf)
        t = _log_apply(smooth.transposed, u)
        b = d + (W[None] * t).sum(axis=2)
        kd = smooth(d) if debias else None
        return kv, u, t, b, kd, b[:, :, None] - t, (d + b - kd) / 2 if debias else d


def log_barycenters_reverse(smooth, log_a, W, trail, bbar, debias=False):
    """Gradients ``(by log_a per problem, by W)`` of a function of the log barycenters.

    Rounds between two checks are run again from the stored start.
    """
    size, (count, atoms) = len(log_a), W.shape
    Abar, Wbar = np.zeros((size, count, atoms)), np.zeros((count, atoms))
    Vbar, Dbar = np.zeros((size, count, atoms)), np.zeros((size, count))
    started = np.zeros(count, bool)
    for live, v, d, steps in reversed(trail):
        w, walked = W[live], []
        for _ in range(steps):
            walked.append((v, d, *_log_round(smooth, log_a, w, v, d, debias)))
            v, d = walked[-1][-2:]
        for v0, d0, kv, u, t, b, kd, _, _ in reversed(walked):
            vbar, dbar = Vbar[:, live], Dbar[:, live]
            from_b = np.where(started[live], 0.0, bbar[:, live]) + vbar.sum(axis=2)
            started[live] = True
            if debias:
                from_b = from_b + dbar / 2
                dbar = dbar / 2 + from_b - smooth.reverse(d0, kd, dbar / 2)
            Wbar[live] += (from_b[:, :, None] * t).sum(axis=0)
            tbar = w[None] * from_b[:, :, None] - vbar
            ubar = _log_apply(smooth.transposed_reverse, u, t, tbar)
            Abar[:, live] += ubar
            Vbar[:, live] = -_log_apply(smooth.reverse, v0, kv, ubar)
            Dbar[:, live] = dbar
    return Abar, Wbar


def log_pair_gradient(C, a, b, loss, eps, max_iter, tol, check_every=CHECK_EVERY):
    """Transport loss of one pair in the log domain, its gradient by ``log a``, and status.

    The rows of ``C`` are the points of ``a``, its columns those of ``b``.
    """
    with np.errstate(all="ignore"):
        log_a, log_b, negative = np.log(a), np.log(b), -C / eps
        f, g = np.zeros(len(a)), np.zeros(len(b))
        trail, status, done = [], MAX_ITER, 0
        while done < max_iter:
            steps, walked, ahead = min(check_every, max_iter - done), [], g
            for _ in range(steps):
                walked.append(ahead)
                now = np.where(a > 0, log_a - lse(negative + ahead[None, :], 1), -np.inf)
                ahead = np.where(b > 0, log_b - lse(negative + now[:, None], 0), -np.inf)
            mass = np.exp(negative + now[:, None] + ahead[None, :])
            gap = np.sqrt(((mass.sum(axis=1) - a) ** 2).sum())
            fine = np.isfinite(now[a > 0]).all() and np.isfinite(ahead[b > 0]).all() and np.isfinite(gap)
            if not fine:
                return np.nan, np.zeros(len(a)), NONFINITE
            f, g, done = now, ahead, done + steps
            trail += walked
            if gap < tol:
                status = CONVERGED
                break
        mass = np.exp(negative + f[:, None] + g[None, :])
        level = np.where(mass > 0, eps * (f[:, None] + g[None, :]), 0.0)
        spent = mass * (level if loss == "regularized" else C)
        value = (mass * (level - eps)).sum() if loss == "regularized" else spent.sum()
        bar, gbar, total = spent.sum(axis=1), spent.sum(axis=0), np.zeros(len(a))
        for before in reversed(trail):
            level_f = negative + before[None, :]
            f = np.where(a > 0, log_a - lse(level_f, 1), -np.inf)
            level_g = negative + f[:, None]
            shares = np.exp(level_g - lse(level_g, 0)[None, :])  # of each column's sum
            bar = np.where(a > 0, bar - np.where(b > 0, shares * gbar[None, :], 0.0).sum(axis=1), 0.0)
            total += bar
            gbar = -(np.exp(level_f - lse(level_f, 1)[:, None]) * bar[:, None]).sum(axis=0)
            bar = np.zeros(len(a))
    return value, total, status
