"""Matrix kernels: numpy on one window of returns (dates by assets), for use inside grouped Spark functions."""

from __future__ import annotations

import math

import numpy as np


def centred(x: np.ndarray) -> np.ndarray:
    x = np.nan_to_num(np.asarray(x, float))
    return x - x.mean(axis=0)


def sample(x: np.ndarray, ddof: int = 1) -> np.ndarray:
    c = centred(x)
    return c.T @ c / max(len(c) - ddof, 1)


def positive_definite(s: np.ndarray, jitter: float = 1e-10, tries: int = 9) -> np.ndarray:
    """A symmetric matrix that Cholesky accepts: the diagonal grows tenfold with each try."""
    s = (s + s.T) / 2
    for k in range(tries):
        try:
            np.linalg.cholesky(s)
            return s
        except np.linalg.LinAlgError:
            s = s + jitter * 10**k * np.eye(len(s))
    return s


def analytical_nonlinear(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Analytical nonlinear shrinkage (Ledoit and Wolf 2020) with one additive bandwidth n^(-1/3)."""
    n, p = x.shape
    values, vectors = np.linalg.eigh(sample(x))
    c = p / n
    live = values > eps if c > 1 else np.ones(p, bool)
    lam = np.maximum(values[live], eps)
    h = n ** (-1 / 3)
    u = (lam[:, None] - lam[None, :]) / h
    root = np.sqrt(5.0)
    density = np.maximum(1 - u * u / 5, 0).mean(axis=1) * 3 / (4 * root) / h
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.where(np.isclose(np.abs(u), root), 0.0, (1 - u * u / 5) * np.log(np.abs((root - u) / (root + u))))
    hilbert = (-3 * u / (10 * np.pi) + 3 / (4 * root * np.pi) * tail).mean(axis=1) / h
    shrunk = np.empty(p)
    shrunk[live] = lam / np.maximum((np.pi * c * lam * density) ** 2 + (1 - c - np.pi * c * lam * hilbert) ** 2, eps)
    if not live.all():
        shrunk[~live] = (1 / np.mean(1 / lam)) / (c * (c - 1))
    return (vectors * shrunk) @ vectors.T


def quadratic_inverse(x: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Quadratic-inverse shrinkage (Ledoit and Wolf 2022); keeps the trace of the sample covariance."""
    n, p = len(x) - 1, x.shape[1]
    c = p / n
    values, vectors = np.linalg.eigh(sample(x))
    values = np.maximum(values, 0)
    skip = max(0, p - n)
    inverse = 1 / np.maximum(values[skip:], eps)
    h = min(c * c, 1 / (c * c)) ** 0.35 / p**0.35
    apart = inverse[None, :] - inverse[:, None]
    below = np.maximum(apart**2 + h * h * inverse[None, :] ** 2, eps)
    theta = (inverse[None, :] * apart / below).mean(axis=1)
    htheta = (inverse[None, :] * h * inverse[None, :] / below).mean(axis=1)
    square = theta**2 + htheta**2
    if p <= n:
        shrunk = 1 / ((1 - c) ** 2 * inverse + 2 * c * (1 - c) * inverse * theta + c * c * inverse * square)
    else:
        null = 1 / ((c - 1) * inverse.mean())
        shrunk = np.concatenate([np.full(skip, null), 1 / (inverse * square)])
    shrunk *= values.sum() / shrunk.sum()
    return (vectors * shrunk) @ vectors.T


def linear(x: np.ndarray) -> np.ndarray:
    """Linear shrinkage to a scaled identity (Ledoit and Wolf 2004)."""
    c = centred(x)
    n, p = c.shape
    s = c.T @ c / n
    m, q = np.trace(s) / p, (c * c).sum(axis=1)
    d2, b2 = (s * s).sum() - p * m * m, max(((q * q).sum() - n * (s * s).sum()) / n**2, 0)
    rho = 1.0 if d2 <= 1e-24 else min(max(b2 / d2, 0), 1)
    return rho * m * np.eye(p) + (1 - rho) * s


def ewma_path(x: np.ndarray, decay: float, start: int):
    """The covariances of dates start, start + 1, ... by the recursion with an activity mask."""
    x = np.asarray(x, float)
    s = sample(x[:start])
    for r in x[start:]:
        live = np.isfinite(r) & (r != 0)
        s = decay * s
        if live.sum() >= 2:
            v = np.where(live, np.nan_to_num(r), 0)
            s = s + (1 - decay) * np.outer(v, v)
        yield s


def ewma_step(s: np.ndarray, r: np.ndarray, decay: float) -> np.ndarray:
    """One online step: no mask, missing returns are zero."""
    v = np.nan_to_num(np.asarray(r, float))
    return decay * s + (1 - decay) * np.outer(v, v)


def _correlation(q: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(np.diag(q), 1e-14))
    return q * d[:, None] * d[None, :]


def _ewma_variances(x: np.ndarray, decay: float) -> np.ndarray:
    """A variance for each row and one ahead; the first is the sample's."""
    var = np.empty((len(x) + 1, x.shape[1]))
    var[0] = x.var(axis=0, ddof=1)
    for t in range(len(x)):
        var[t + 1] = decay * var[t] + (1 - decay) * x[t] ** 2
    return np.maximum(var, 1e-14)


def _garch_variances(x: np.ndarray) -> tuple[np.ndarray, dict]:
    """The same by a GARCH(1,1) of each column, and its parameters; columns that it can't be fitted to stay constant."""
    n = x.shape[1]
    var = np.repeat(np.maximum(x.var(axis=0, ddof=1), 1e-14)[None, :], len(x) + 1, axis=0)
    own = {"mu": x.mean(axis=0), "omega": var[0].copy(), "alpha": np.zeros(n), "beta": np.zeros(n)}
    for k in range(n):
        fit = fit_volatility("garch", x[:, k])
        if fit["params"]:
            own["omega"][k], own["alpha"][k], own["beta"][k] = fit["params"]["omega"] * var[0, k], fit["params"]["alpha"], fit["params"]["beta"]
            path = conditional_variance("garch", np.array([own["omega"][k], own["alpha"][k], own["beta"][k]]), np.append(x[:, k] - own["mu"][k], 0.0), var[0, k])
            var[:, k] = np.maximum(path, 1e-14)
    return var, own


def dcc_fit(x: np.ndarray, decay: float = 0.94, volatility: str = "ewma", pairs=None) -> dict:
    """Dynamic conditional correlation (Engle 2002): the state after the rows of x.

    Volatilities are EWMA or GARCH(1,1) ones. (a, b) is the likeliest pair of a grid, then moved on from there
    without derivatives. q and var are those of the row that follows x.
    """
    x = np.nan_to_num(np.asarray(x, float))
    own: dict = {"mu": np.zeros(x.shape[1])}
    if volatility == "garch":
        var, own = _garch_variances(x)
    elif volatility == "ewma":
        var = _ewma_variances(x, decay)
    else:
        raise ValueError(f"unknown volatility {volatility!r}")
    e = (x - own["mu"]) / np.sqrt(var[:-1])
    mean = positive_definite(_correlation(e.T @ e / len(e)), 1e-8)

    def run(a: float, b: float) -> tuple[float, np.ndarray]:
        q, loss = mean, 0.0
        for v in e:
            r = positive_definite(_correlation(q), 1e-8)
            loss += np.linalg.slogdet(r)[1] + v @ np.linalg.solve(r, v)
            q = (1 - a - b) * mean + a * np.outer(v, v) + b * q
        return loss, q

    grid = pairs or [(a, b) for a in (0.01, 0.03, 0.05, 0.08, 0.12) for b in (0.7, 0.8, 0.9, 0.95) if a + b < 1]
    a, b = min(grid, key=lambda p: run(*p)[0])
    if pairs is None:
        proper = lambda p: min(p) >= 0 and p[0] + p[1] < 0.9999
        (a, b), _, _ = nelder_mead(lambda p: run(*p)[0] if proper(p) else 1e12, np.array([a, b]), 25, 0.01)
    return own | {"volatility": volatility, "decay": decay, "a": float(a), "b": float(b), "mean": mean, "q": run(a, b)[1], "var": var[-1]}


def dcc_covariance(state: dict) -> np.ndarray:
    """The covariance that a state expects of the next row."""
    sigma = np.sqrt(state["var"])
    return _correlation(state["q"]) * sigma[:, None] * sigma[None, :]


def dcc_step(state: dict, r: np.ndarray) -> dict:
    """The state after one more row; parameters stay as they are."""
    d = np.nan_to_num(np.asarray(r, float)) - state["mu"]
    e = d / np.sqrt(state["var"])
    a, b = state["a"], state["b"]
    if state["volatility"] == "garch":
        var = state["omega"] + state["alpha"] * d * d + state["beta"] * state["var"]
    else:
        var = state["decay"] * state["var"] + (1 - state["decay"]) * d * d
    return state | {"q": (1 - a - b) * state["mean"] + a * np.outer(e, e) + b * state["q"], "var": np.maximum(var, 1e-14)}


def dcc(x: np.ndarray, decay: float = 0.94, pairs=None, volatility: str = "ewma") -> tuple[np.ndarray, float, float]:
    """The covariance expected after x, a and b."""
    state = dcc_fit(x, decay, volatility, pairs)
    return dcc_covariance(state), state["a"], state["b"]


def stein(estimate: np.ndarray, truth: np.ndarray) -> float:
    m = estimate @ np.linalg.inv(positive_definite(truth))
    return float(np.trace(m) - np.linalg.slogdet(m)[1] - len(m))


def losses(estimate: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    d = estimate - truth
    inverse = np.linalg.inv(positive_definite(estimate)) - np.linalg.inv(positive_definite(truth))
    return {"frobenius": float(np.linalg.norm(d)), "spectral": float(np.abs(np.linalg.eigvalsh(d)).max()), "stein": stein(positive_definite(estimate), truth), "precision": float(np.linalg.norm(inverse))}


ESTIMATORS = {"rolling": sample, "lw": linear, "anls": analytical_nonlinear, "qis": quadratic_inverse, "dcc": lambda x: dcc(x)[0]}


def on_active(x: np.ndarray, estimator) -> np.ndarray:
    """Estimate over the assets that have a return other than zero; the others get zeros."""
    x = np.nan_to_num(np.asarray(x, float))
    live = np.flatnonzero(np.abs(x).max(axis=0) > 0)
    out = np.zeros((x.shape[1],) * 2)
    if len(live) > 1:
        out[np.ix_(live, live)] = estimator(x[:, live])
    return out


def minimise_tracking(cov: np.ndarray, bench: np.ndarray, kept: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Weights over the `kept` places that minimise (w - b)' cov (w - b), with sum one and none negative."""
    return solve_tracking(cov, bench, kept, rounds)[0]


def solve_tracking(cov: np.ndarray, bench: np.ndarray, kept: np.ndarray, rounds: int | None = None, start: np.ndarray | None = None, ridge: float = 0.0) -> tuple[np.ndarray, int]:
    """Weights as of minimise_tracking(), and the rounds they took.

    A primal active-set method: solve with equality on the free places, step until a weight reaches zero,
    which fixes it, and free the fixed place whose gradient pulls most. Ends at the optimum of this convex
    problem; ties go to the lower place, so the path is deterministic. It begins at `start` (over all places), whose
    zeros are fixed at first, so a start near the optimum takes few rounds; without one all are equal. `ridge`, in units
    of the mean variance, adds ridge |w - start|^2.
    """
    s = positive_definite(cov)[np.ix_(kept, kept)]
    s = positive_definite(s)
    q = (cov @ bench)[kept]
    k = len(kept)
    w, free = np.full(k, 1 / k), np.ones(k, bool)
    if start is not None:
        own = np.maximum(np.nan_to_num(start[kept]), 0)
        if own.sum() > 0:
            w = own / own.sum()
            free = w > 0
    scale = max(np.trace(s) / k, 1e-300)
    if ridge > 0:
        s, q = s + ridge * scale * np.eye(k), q + ridge * scale * w
    done = 0
    for done in range(1, (rounds or 20 * k + 50) + 1):
        f = np.flatnonzero(free)
        m = np.zeros((len(f) + 1,) * 2)
        m[:-1, :-1], m[:-1, -1], m[-1, :-1] = s[np.ix_(f, f)] / scale, 1, 1
        goal = np.linalg.lstsq(m, np.append(q[f] / scale, 1.0), rcond=None)[0][:-1]
        step = goal - w[f]
        down = step < -1e-15
        room = np.where(down, -w[f] / np.where(down, step, -1), np.inf)
        t = min(1.0, room.min(initial=np.inf))
        w[f] = w[f] + t * step
        if t < 1:
            hit = f[np.argmin(room)]
            w[hit], free[hit] = 0.0, False
            continue
        g = (s @ w - q) / scale
        level = g[f].mean()
        pull = np.where(free, np.inf, g - level)
        j = int(np.argmin(pull))
        if pull[j] > -1e-12:
            break
        free[j] = True
    w = np.maximum(w, 0)
    return w / w.sum(), done


def nelder_mead(f, start: np.ndarray, rounds: int = 400, spread: float = 0.1) -> tuple[np.ndarray, float, bool]:
    """Minimise f without derivatives (Nelder and Mead 1965)."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + spread * np.eye(n)[i] for i in range(n)]
    scored = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda x: x[:2])
    tag = n
    for _ in range(rounds):
        if abs(scored[-1][0] - scored[0][0]) < 1e-9 * (1 + abs(scored[0][0])):
            return scored[0][2], scored[0][0], True
        middle = np.mean([p for _, _, p in scored[:-1]], axis=0)
        worst = scored[-1]

        def at(k: float, middle=middle, worst=worst):
            nonlocal tag
            p = middle + k * (middle - worst[2])
            tag += 1
            return f(p), tag, p

        new = at(1.0)
        if new[0] < scored[0][0]:
            new = min(new, at(2.0), key=lambda x: x[:2])
        elif new[0] >= scored[-2][0]:
            new = at(0.5 if new[0] < worst[0] else -0.5)
        if new[0] < worst[0]:
            scored[-1] = new
        else:
            scored = [scored[0]] + [(f(p := scored[0][2] + 0.5 * (x - scored[0][2])), i, p) for _, i, x in scored[1:]]
        scored.sort(key=lambda x: x[:2])
    return scored[0][2], scored[0][0], False


def conditional_variance(kind: str, theta: np.ndarray, r: np.ndarray, start: float, p: int = 1, q: int = 1) -> np.ndarray:
    """Variance paths of the models with p lags of returns and q of variances, by their published recursions.

    The variance, its logarithm or its power s_t is omega + the sum of alpha_i times the shock i dates ago + the sum of
    beta_j s_(t-j); signs count one date ago only. Before the sample, squares and variances are `start`.
    """
    theta, r = [float(c) for c in theta], [float(c) for c in r]
    omega, alpha, rest = theta[0], theta[1 : 1 + p], theta[1 + p :]
    gamma, power = 0.0, 2.0
    if kind == "gjr":
        beta, gamma = rest[:q], rest[q]
    elif kind in ("egarch", "aparch"):
        gamma, beta = rest[0], rest[1 : 1 + q]
        power = rest[1 + q] if kind == "aparch" else power
    else:
        beta = rest
    first = math.log(start) if kind == "egarch" else start ** (power / 2)
    calm = math.sqrt(2 / math.pi)
    usual = 0.0 if kind == "egarch" else first
    s, v, shocks = [first], [start], []
    for t in range(1, len(r)):
        x, sign = r[t - 1], 0.0
        if kind == "egarch":
            z = x / math.sqrt(v[-1])
            shock, sign = abs(z) - calm, gamma * z
        elif kind == "aparch":
            shock = abs(x) ** power
            # The lags' common shock has no sign; that of one date ago has.
            sign = alpha[0] * ((abs(x) - gamma * x) ** power - shock)
        else:
            shock, sign = x * x, gamma * x * x * (x < 0)
        shocks.append(shock)
        new = omega + sign
        for i in range(p):
            new += alpha[i] * (shocks[t - 1 - i] if i < t else usual)
        for j in range(q):
            new += beta[j] * (s[t - 1 - j] if j < t else first)
        if kind == "egarch":
            new = min(max(new, -50.0), 50.0)
        s.append(new)
        # A variance that is not positive ends the path; fits reject it.
        if kind != "egarch" and not new > 0:
            return np.array(v + [-1.0] * (len(r) - t))
        v.append(math.exp(new) if kind == "egarch" else new ** (2 / power))
    return np.array(v)


#: The kinds of models.
VOLATILITY = ("garch", "gjr", "egarch", "aparch")


def volatility_model(kind: str, p: int = 1, q: int = 1):
    """Names of the parameters, a start for returns of unit variance, and the region where the model is proper."""
    if kind not in VOLATILITY or min(p, q) < 1:
        raise ValueError(f"no model {kind!r} of order ({p}, {q})")
    numbered = lambda c, n: [c] if n == 1 else [f"{c}{k}" for k in range(1, n + 1)]
    alpha, beta = numbered("alpha", p), numbered("beta", q)
    a, b = slice(1, 1 + p), slice(-q, None)
    if kind == "garch":
        names, start = ["omega", *alpha, *beta], [0.1] + [0.1 / p] * p + [0.8 / q] * q
        proper = lambda c: c[0] > 0 and min(c[1:]) >= 0 and sum(c[1:]) < 0.9999
    elif kind == "gjr":
        names, start = ["omega", *alpha, *beta, "gamma"], [0.1] + [0.05 / p] * p + [0.8 / q] * q + [0.05]
        proper = lambda c: c[0] > 0 and min(c[1:-1]) >= 0 and c[1] + c[-1] >= 0 and sum(c[1:-1]) + c[-1] / 2 < 0.9999
    elif kind == "egarch":
        names, start = ["omega", *alpha, "gamma", *beta], [0.0] + [0.1 / p] * p + [0.0] + [0.9 / q] * q
        proper = lambda c: sum(abs(c[b])) < 0.9999
    else:
        names, start = ["omega", *alpha, "gamma", *beta, "delta"], [0.1] + [0.1 / p] * p + [0.0] + [0.8 / q] * q + [2.0]
        inner = slice(2 + p, -1)
        proper = lambda c: c[0] > 0 and min(c[a]) >= 0 and abs(c[1 + p]) < 1 and min(c[inner]) >= 0 and 0.3 < c[-1] < 4 and sum(c[a]) + sum(c[inner]) < 0.9999
    return names, start, proper


def fit_volatility(kind: str, r: np.ndarray, p: int = 1, q: int = 1) -> dict:
    """Gaussian maximum likelihood on returns scaled to unit variance; conditional deviations are scaled back.

    path has the deviation of each finite return, sigma the last one."""
    names, start, proper = volatility_model(kind, p, q)
    r = np.asarray(r, float)
    r = r[np.isfinite(r)]
    scale = r.std(ddof=1) if len(r) > 2 else 0.0
    if len(r) < 20 or not scale > 0:
        return {"params": {}, "llf": None, "aic": None, "bic": None, "converged": False, "message": "too few or constant returns", "sigma": None, "path": []}
    y = (r - r.mean()) / scale

    def loss(c: np.ndarray) -> float:
        if not proper(c):
            return 1e12
        v = conditional_variance(kind, c, y, 1.0, p, q)
        if not np.all(np.isfinite(v)) or v.min() <= 0:
            return 1e12
        return float(0.5 * np.sum(np.log(2 * np.pi) + np.log(v) + y * y / v))

    c, least, done = nelder_mead(loss, np.array(start), 400 + 100 * (p + q - 2))
    k, llf = len(c), -least
    path = np.sqrt(conditional_variance(kind, c, y, 1.0, p, q)) * scale
    return {"params": dict(zip(names, map(float, c), strict=True)), "llf": llf, "aic": 2 * k - 2 * llf, "bic": k * float(np.log(len(y))) - 2 * llf, "converged": bool(done), "message": "" if done else "stopped at the limit of rounds", "sigma": float(path[-1]), "path": path.tolist()}
