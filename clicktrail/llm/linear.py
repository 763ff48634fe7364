"""Small dense logistic regression, shared by the two classifiers; its data are bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x, y, weight=None, l2=1.0, pairs=None, penalty=0.0, steps=300):
    """Weights and intercept by accelerated gradient descent on the mean log loss.

    ``pairs`` are feature differences of a row and its counterfactual, as
    (columns of ``x``, one row of differences in these columns for each pair);
    the mean of their squared score changes is added with factor ``penalty``. The step
    size comes from a bound on the curvature, so the descent is stable.
    """
    n, k = x.shape
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    weight = weight / weight.sum()
    columns, extra = pairs if pairs is not None and pairs[1].size and penalty else (None, None)
    curve = 0.25 * (weight * (np.einsum("ij,ij->i", x, x) + 1)).sum() + l2 / n
    if extra is not None:
        curve += 2 * penalty * (extra**2).sum(axis=1).mean()
        gram = 2 * penalty / len(extra) * (extra.T @ extra)  # the penalty is a quadratic form in few weights
    rate = 1.0 / curve
    w, b = np.zeros(k), float(np.log((weight[y == 1].sum() + 1e-6) / (weight[y == 0].sum() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        # products in the matrix's own precision: a wider vector would copy the matrix in every step
        r = weight * (sigmoid(x @ vw.astype(x.dtype) + vb) - y)
        gw, gb = x.T @ r.astype(x.dtype) + l2 / n * vw, r.sum()
        if extra is not None:
            gw[columns] += gram @ vw[columns]
        nw, nb = vw - rate * gw, vb - rate * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b
