"""Dense numpy statement of the four PLS variants, to check the Spark ones."""

from __future__ import annotations

import numpy as np


def mean_rank(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def logistic(columns, y, iters=200):
    a = np.column_stack([np.ones(len(y)), *columns])
    penalty = np.eye(a.shape[1])
    penalty[0, 0] = 0
    beta = np.zeros(a.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-(a @ beta)))
        grad = a.T @ (y - p) - penalty @ beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hess + 1e-12 * np.eye(len(beta)), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta[1:]


class DensePLS:
    def __init__(self, variant, h, nu=2.0, std=True, center=True):
        self.variant, self.h, self.nu, self.std, self.center = variant, h, nu, std, center

    def ranks(self, x):
        return (len(x) + 1 - mean_rank(x)) ** (self.nu - 1)

    def fit(self, X, y):
        X, y = np.asarray(X, float), np.asarray(y, float)
        self.keep = [i for i in range(X.shape[1]) if X[:, i].min() != X[:, i].max()]
        X = X[:, self.keep]
        self.mu, self.sd = X.mean(0), X.std(0, ddof=1)
        if not self.std:
            self.mu, self.sd = np.zeros_like(self.mu), np.ones_like(self.sd)
        self.X = X = (X - self.mu) / self.sd
        ys = (y - y.mean()) / y.std(ddof=1) if self.std else y
        n, k = X.shape
        rank_based = self.variant in ("gini", "logit_gini")
        R = np.column_stack([self.ranks(X[:, i]) for i in range(k)])
        if self.variant == "standard":
            w = np.array([np.cov(X[:, i], ys)[0, 1] for i in range(k)])
        elif self.variant == "gini":
            w = np.array([-self.nu * np.cov(R[:, i], ys)[0, 1] for i in range(k)])
        else:
            base = R if rank_based else X
            w = np.array([logistic([base[:, i]], y)[0] for i in range(k)])
        size = np.abs(w).sum() if self.variant == "gini" else np.sqrt((w**2).sum())
        w = w / (size or 1.0)
        Z = R - R.mean(0) if rank_based and self.center else (R if rank_based else X)
        self.Z, self.W = Z, []
        T = np.zeros((n, 0))
        for j in range(self.h):
            self.W.append(w)
            t = X @ w if j == 0 else (Z - T @ (np.linalg.pinv(T) @ Z)) @ w
            T = np.column_stack([T, t])
            self.c = np.linalg.pinv(T) @ ys
            eps = ys - T @ self.c
            res = np.round(Z - T @ (np.linalg.pinv(T) @ Z), 10)
            if j + 1 == self.h:
                break
            if self.variant == "standard":
                w = np.array([np.cov(res[:, i], eps)[0, 1] for i in range(k)])
                w = w / np.sqrt((w**2).sum())
            elif self.variant == "gini":
                v = np.column_stack([self.ranks(res[:, i]) for i in range(k)])
                w = np.array([-self.nu * np.cov(v[:, i], eps)[0, 1] for i in range(k)])
                w = w / (np.abs(w).sum() or 1.0)
            else:
                both = np.array([logistic([res[:, i], *T.T], y)[:2] for i in range(k)])
                w = both[:, 0]
                other = both[:, 0] if self.variant == "logit" else both[:, 1]
                w = w / np.sqrt((w**2 + other**2).sum())
        self.T, self.ys, self.y = T, ys, y
        self.threshold = (T @ self.c).mean()
        return self

    def transform(self, X):
        X = (np.asarray(X, float)[:, self.keep] - self.mu) / self.sd
        n, k = self.X.shape
        Z = X
        if self.variant in ("gini", "logit_gini"):
            Z = np.zeros_like(X)
            for r, row in enumerate(X):
                for i in range(k):
                    d = n + 2 - mean_rank(np.concatenate([[row[i]], self.X[:, i]]))
                    d = d ** (self.nu - 1)
                    Z[r, i] = d[0] - (d.mean() if self.center else 0)
        T = np.zeros((len(X), 0))
        for j in range(self.h):
            if j == 0:
                t = X @ self.W[0]
            else:
                B = np.linalg.pinv(self.T[:, :j]) @ self.Z
                t = (Z - T @ B) @ self.W[j]
            T = np.column_stack([T, t])
        return T

    def vip(self):
        n, k = self.X.shape
        m = np.array([np.corrcoef(self.T[:, j], self.ys)[0, 1] ** 2 for j in range(self.h)])
        W = np.array(self.W)
        return np.column_stack(
            [k / m[: s + 1].sum() * (m[: s + 1, None] * W[: s + 1] ** 2).sum(0) for s in range(self.h)]
        )

    def press(self, j):
        """Leave-one-out error of the first j components by actually leaving rows out."""
        T = self.T[:, :j]
        total = 0.0
        for i in range(len(T)):
            rest = np.arange(len(T)) != i
            b = np.linalg.pinv(T[rest]) @ self.ys[rest]
            total += (self.ys[i] - T[i] @ b) ** 2
        return total
