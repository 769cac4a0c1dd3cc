"""Likelihood, score and Hessian of a mixed model's variance parameters from per-entity Grams.

With S_i = Z_iᵀZ_i, A_i = [X y] and the relative covariance Ψ = LLᵀ of the random effects, Woodbury gives
all that an entity adds from its Gram:

    H_i = (I + S_iΨ)⁻¹ Z_iᵀA_i        P_i = (I + S_iΨ)⁻¹ S_i
    M = Σ A_iᵀA_i − (Z_iᵀA_i)ᵀ Ψ H_i   dM = −Σ H_iᵀ dΨ H_i    dP_i = −P_i dΨ P_i    d log|V_i| = tr(P_i dΨ)

The sums of H_i⊗H_i, P_i, P_i⊗P_i and P_i⊗H_i⊗H_i over entities therefore give the profile (RE)ML
likelihood with its exact first and second derivatives at any L.  Their length depends on the numbers
of random effects and columns alone, so a round of the search is one pass over the Gram table, whatever
the number of entities, and a few hundred numbers per stratum come back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Step lengths tried beside each other in a round.
STEPS = (1.0, 0.5, 0.25, 0.05, 2.0)
#: Once a Newton step can gain no more than this (in log-likelihood) it is the last: what it leaves is of the square.
TOLERANCE = 1e-7


def symmetric(g: np.ndarray, m: int) -> np.ndarray:
    """Upper triangles (E × m(m+1)/2) → symmetric matrices (E × m × m)."""
    at = np.zeros((m, m), np.int64)
    iu = np.triu_indices(m)
    at[iu] = np.arange(len(iu[0]))
    return g[:, np.maximum(at, at.T)]


def sizes(q: int, m: int) -> list[tuple[int, ...]]:
    """Shapes of the sums: correction, log determinant, and those of the derivatives."""
    return [(m, m), (1,), (q, q, m, m), (q, q), (q, q, q, q), (q, q, q, q, m, m)]


def entity_sums(G: np.ndarray, L: np.ndarray, derivatives: bool = True) -> np.ndarray:
    """The sums over the entities of G (E × m × m) as one vector."""
    q = L.shape[0]
    psi, S, ZA = L @ L.T, G[:, :q, :q], G[:, :q, :]
    K = np.eye(q) + S @ psi
    H = np.linalg.solve(K, ZA)
    correction = np.einsum("eam,ab,ebn->mn", ZA, psi, H, optimize=True)
    parts = [(correction + correction.T) / 2, np.linalg.slogdet(K)[1].sum()]
    if derivatives:
        P = np.linalg.solve(K, S)
        P = (P + P.transpose(0, 2, 1)) / 2
        parts += [np.einsum("eam,ebn->abmn", H, H, optimize=True), P.sum(axis=0),
                  np.einsum("ebc,eda->bcda", P, P, optimize=True),
                  np.einsum("ebc,eam,edn->abcdmn", P, H, H, optimize=True)]
    return np.concatenate([np.ravel(x) for x in parts])


def split(vec: np.ndarray, q: int, m: int) -> list[np.ndarray]:
    out, at = [], 0
    for shape in sizes(q, m):
        n = int(np.prod(shape))
        out.append(vec[at:at + n].reshape(shape))
        at += n
    return out


def score_and_hessian(vec: np.ndarray, G: np.ndarray, L: np.ndarray, keep: Sequence[int],
                      method: str) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood up to a constant, gradient and Hessian in the lower triangle of L, row by row, and the
    change of Ψ by Fisher scoring)."""
    q, m = L.shape[0], G.shape[0]
    C, ld, T, P, PP, Q = split(vec, q, m)
    keep = list(keep)
    M, n, p = G - C, G[0, 0], len(keep)
    inv = np.linalg.inv(M[np.ix_(keep, keep)])
    beta = inv @ M[keep, -1]
    rss = float(M[-1, -1] - beta @ M[keep, -1])
    u = np.zeros(m)
    u[keep], u[-1] = -beta, 1.0
    nu = n - p if method == "REML" else n
    ll = -nu / 2 * np.log(rss) - ld[0] / 2
    Tu = np.einsum("abmn,n->abm", T, u)
    R = Tu @ u
    U = np.einsum("abcdmn,m,n->abcd", Q, u, u)
    slope = (nu / rss * R - P) / 2
    if method == "REML":
        ll += np.linalg.slogdet(inv)[1] / 2
        Tx = T[:, :, keep][:, :, :, keep]
        slope = slope + np.einsum("abmn,mn->ab", Tx, inv) / 2
        Qx = np.einsum("abcdmn,mn->abcd", Q[..., keep, :][..., keep], inv)
    rows, cols = np.tril_indices(q)
    units = np.zeros((len(rows), q, q))
    units[np.arange(len(rows)), rows, cols] = 1.0
    delta = units @ L.T + L @ units.transpose(0, 2, 1)
    slope = (slope + slope.T) / 2
    grad = np.einsum("kab,ab->k", delta, slope)
    first = -np.einsum("kab,ab->k", delta, R)
    w = -np.einsum("kab,abm->km", delta, Tu)[:, keep]
    second = np.einsum("kab,lcd,abcd->kl", delta, delta, U, optimize=True)
    second = second + second.T - 2 * w @ inv @ w.T
    hess = -nu / 2 * (second / rss - np.outer(first, first) / rss ** 2)
    hess += np.einsum("kab,lcd,bcda->kl", delta, delta, PP, optimize=True) / 2
    if method == "REML":
        dM = -np.einsum("kab,abmn->kmn", delta, Tx)
        dM = (dM + dM.transpose(0, 2, 1)) / 2
        d2 = np.einsum("kab,lcd,abcd->kl", delta, delta, Qx, optimize=True)
        hess += -(d2 + d2.T) / 2 + np.einsum("mn,kno,op,lpm->kl", inv, dM, inv, dM, optimize=True) / 2
    hess += 2 * np.einsum("kab,lcb,ac->kl", units, units, slope, optimize=True)
    # expected information of Ψ, the residual variance profiled out
    sym = (units + units.transpose(0, 2, 1)) / 2
    trace = np.einsum("kab,ab->k", sym, P)
    info = np.einsum("kab,lcd,bcda->kl", sym, sym, PP, optimize=True) / 2 - np.outer(trace, trace) / (2 * nu)
    scored = np.tensordot(np.linalg.lstsq(info, np.einsum("kab,ab->k", sym, slope), rcond=1e-12)[0], sym, 1)
    return float(ll), grad, (hess + hess.T) / 2, scored


def starts(rms: np.ndarray, most: int = 400) -> list[np.ndarray]:
    """Diagonal L's on a logarithmic grid, for columns of root mean squares ``rms``: zeros, then 1e-3 to 100 residual sd."""
    q = len(rms)
    steps = max(3, int(most ** (1.0 / q)))
    axis = np.logspace(-3, 2, steps)
    grid = np.stack(np.meshgrid(*[axis] * q, indexing="ij"), -1).reshape(-1, q) if steps ** q <= 4 * most else \
        np.repeat(axis[:, None], q, 1)
    out = []
    for row in grid:
        out.append(np.diag(row / rms)[np.tril_indices(q)])
    return out


def factor(psi: np.ndarray) -> np.ndarray:
    """Lower triangle of a Cholesky factor of the nearest positive semidefinite matrix."""
    values, vectors = np.linalg.eigh((psi + psi.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 1e-12 * max(float(values.max()), 1e-300)))
    lower = np.linalg.qr(root.T, mode="r").T
    return (lower * np.where(np.diag(lower) < 0, -1.0, 1.0))[np.tril_indices(psi.shape[0])]


def candidates(at: np.ndarray, step: np.ndarray, scored: np.ndarray) -> list[np.ndarray]:
    """Points of the next round: Newton's step at several lengths, and two of Fisher scoring in Ψ."""
    q = scored.shape[0]
    L = np.zeros((q, q))
    L[np.tril_indices(q)] = at
    return [at + t * step for t in STEPS] + [factor(L @ L.T + t * scored) for t in (1.0, 0.5)]


def newton_step(grad: np.ndarray, hess: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ascent step (curvatures taken as downward) in parameters scaled by ``scale``, and half its expected gain."""
    g, h = grad / scale, hess / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(h)
    size = np.maximum(np.abs(values), 1e-9 * max(1.0, float(np.abs(values).max())))
    along = vectors.T @ g
    return vectors @ (along / size) / scale, float(along @ (along / size)) / 2
