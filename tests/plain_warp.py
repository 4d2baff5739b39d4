"""The warp field's equations in plain numpy, to compare with."""

import numpy as np

from pointloom.operators.cloud import nearest_rotation
from pointloom.operators.warp import euler, sqrt_huber, sqrt_huber_slope


def conjugate_gradient(rows, cols, vals, b, n: int, max_iter: int = 1000, tol: float = 1e-5) -> np.ndarray:
    """Least squares of the sparse rows by conjugate gradients on the normal equations, scaled by their diagonal."""
    m = len(b)
    mul = lambda x: np.bincount(rows, vals * x[cols], m)
    tmul = lambda y: np.bincount(cols, vals * y[rows], n)
    diag = np.bincount(cols, vals * vals, n)
    scale = np.where(diag > 0, 1 / np.where(diag > 0, diag, 1), 1)
    x, r = np.zeros(n), tmul(b)
    z = scale * r
    p, rz = z, r @ z
    stop = tol * tol * max(rz, 1e-300)
    for _ in range(max_iter):
        if rz <= stop:
            break
        ap = tmul(mul(p))
        k = rz / max(p @ ap, 1e-300)
        x = x + k * p
        r = r - k * ap
        z = scale * r
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x


def estimate_warp(src, dst, normals, pairs, control, arcs, nodes: int, kind: str = "rigid", w_point=0.0, w_plane=1.0, stiffness=1.0, huber=1e-4, max_iter=10, tol=1e-5, cg_iter=1000) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) of each node. pairs (k x 2): source and destination rows; control: for each source row (nodes, weights); arcs: (i, j, weight).

    Dense fields have one node for each source point (control: itself with weight one). The nodes are few enough for the driver; the
    matches and control edges come from Spark.
    """
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    dim = src.shape[1]
    angles = 0 if kind == "affine" else (1 if dim == 2 else 3)
    size = dim * dim + dim if kind == "affine" else angles + dim
    x = np.zeros((nodes, size))
    if kind == "affine":
        x[:, : dim * dim] = np.eye(dim).ravel()
    use = [(i, j, *control[i]) for i, j in pairs if len(control[i][0]) and np.sum(control[i][1]) > 0]
    arcs = np.asarray(arcs, float).reshape(-1, 3)
    ai, aj, aw = arcs[:, 0].astype(int), arcs[:, 1].astype(int), arcs[:, 2]
    keep = ai != aj
    ai, aj, aw = ai[keep], aj[keep], aw[keep]
    for _ in range(max_iter):
        rows, cols, vals, b, m = [], [], [], [], 0
        if use:
            s, d = src[[u[0] for u in use]], dst[[u[1] for u in use]]
            n = np.asarray(normals, float)[[u[1] for u in use]] if normals is not None else None
            blend = np.array([(np.asarray(w, float) / np.sum(w)) @ x[np.asarray(c)] for _, _, c, w in use])
            if kind == "affine":
                r = blend[:, : dim * dim].reshape(-1, dim, dim)
                grads = [np.where(np.arange(dim)[None, :] == i // dim, s[:, i % dim][:, None], 0.0) for i in range(dim * dim)]
            else:
                r, dr = euler(blend[:, :angles], dim)
                grads = [np.einsum("nij,nj->ni", g, s) for g in dr]
            grads += [np.tile(np.eye(dim)[i], (len(s), 1)) for i in range(dim)]
            gap = d - np.einsum("nij,nj->ni", r, s) - blend[:, -dim:]
            terms = []
            if w_point > 0:
                terms += [(np.sqrt(w_point) * gap[:, i], [np.sqrt(w_point) * g[:, i] for g in grads]) for i in range(dim)]
            if w_plane > 0 and n is not None:
                terms.append((np.sqrt(w_plane) * (n * gap).sum(1), [np.sqrt(w_plane) * (n * g).sum(1) for g in grads]))
            who = np.repeat(np.arange(len(use)), [len(u[2]) for u in use])
            node = np.concatenate([np.asarray(u[2]) for u in use])
            share = np.concatenate([np.asarray(u[3], float) / np.sum(u[3]) for u in use])
            for rhs, coef in terms:
                for p, g in enumerate(coef):
                    rows.append(m + who)
                    cols.append(node * size + p)
                    vals.append(share * g[who])
                b.append(rhs)
                m += len(rhs)
        for p in range(size):
            gap = x[ai, p] - x[aj, p]
            k = np.sqrt(stiffness * aw)
            slope = k * sqrt_huber_slope(gap, huber)
            flat = np.abs(gap) < 1e-12  # where the loss has its kink the arc still ties both ends
            slope = np.where(flat, k / np.sqrt(2), slope)
            rows += [m + np.arange(len(ai))] * 2
            cols += [ai * size + p, aj * size + p]
            vals += [slope, -slope]
            b.append(-np.where(flat, 0, k * sqrt_huber(gap, huber)))
            m += len(ai)
        if not m:
            break
        step = conjugate_gradient(np.concatenate(rows).astype(int), np.concatenate(cols).astype(int), np.concatenate(vals), np.concatenate(b), nodes * size, cg_iter).reshape(nodes, size)
        x += step
        if np.sqrt((step * step).sum(1)).max() < tol:
            break
    r = x[:, : dim * dim].reshape(-1, dim, dim) if kind == "affine" else euler(x[:, :angles], dim)[0]
    return r, x[:, -dim:]


def warp_icp(dst: np.ndarray, normals, src: np.ndarray, control, arcs, nodes: int, match, kind: str = "rigid", max_iter: int = 15, tol: float = 1e-5, **options):
    """Closest-point loop of a warp field. match(points) gives the pairs (source row, destination row) of the moved source points."""
    dim = src.shape[1]
    r, t, moved = np.tile(np.eye(dim), (nodes, 1, 1)), np.zeros((nodes, dim)), src.copy()
    for rounds in range(1, max_iter + 1):
        new_r, new_t = estimate_warp(src, dst, normals, match(moved), control, arcs, nodes, kind, **options)
        delta = np.sqrt(((new_r - r) ** 2).sum((1, 2)) + ((new_t - t) ** 2).sum(1)).max()
        r, t = new_r, new_t
        moved = np.array([_blend(r, t, c, w, kind, dim, p) for p, (c, w) in zip(src, control, strict=True)])
        if delta < tol:
            break
    return r, t, moved, rounds


def _blend(r, t, nodes, weights, kind, dim, p):
    w = np.asarray(weights, float)
    if not len(w) or w.sum() == 0:
        return p
    w = w / w.sum()
    m = np.einsum("k,kij->ij", w, r[np.asarray(nodes)])
    return (m if kind == "affine" else nearest_rotation(m)) @ p + w @ t[np.asarray(nodes)]
