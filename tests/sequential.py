"""Hidden Markov recursions row by row, and the fit that is made of them: what the block scans must equal."""
import numpy as np

from tidemill.operators import regimes


def forward_many(pi: np.ndarray, a: np.ndarray, logb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered probabilities (rows, models, states), their scales (rows, models) and log likelihoods (models): a step costs the same for one model as for many."""
    top = logb.max(axis=2)
    b = np.exp(logb - top[:, :, None])
    alpha, scale = np.empty_like(b), np.empty(b.shape[:2])
    now = pi * b[0]
    for t in range(len(b)):
        if t:
            now = (now[:, None, :] @ a)[:, 0] * b[t]
        total = np.maximum(now.sum(axis=1), 1e-300)
        now = now / total[:, None]
        alpha[t], scale[t] = now, total
    return alpha, scale, np.log(scale).sum(axis=0) + top.sum(axis=0)


def backward_many(a: np.ndarray, logb: np.ndarray, scale: np.ndarray) -> np.ndarray:
    c = np.exp(logb - logb.max(axis=2, keepdims=True)) / scale[:, :, None]
    beta, across = np.ones_like(c), a.transpose(0, 2, 1)
    now = beta[-1]
    for t in range(len(c) - 2, -1, -1):
        now = ((c[t + 1] * now)[:, None, :] @ across)[:, 0]
        beta[t] = now
    return beta


def forward(pi: np.ndarray, a: np.ndarray, logb: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The same of one model: (rows, states), (rows), log likelihood."""
    alpha, scale, score = forward_many(pi[None], a[None], logb[:, None])
    return alpha[:, 0], scale[:, 0], float(score[0])


def backward(a: np.ndarray, logb: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return backward_many(a[None], logb[:, None], scale[:, None])[:, 0]


def viterbi(pi: np.ndarray, a: np.ndarray, logb: np.ndarray) -> np.ndarray:
    la, best = np.log(a + 1e-300), np.log(pi + 1e-300) + logb[0]
    back = np.zeros(logb.shape, int)
    for t in range(1, len(logb)):
        paths = best[:, None] + la
        back[t] = paths.argmax(axis=0)
        best = paths.max(axis=0) + logb[t]
    out = np.empty(len(logb), int)
    out[-1] = best.argmax()
    for t in range(len(logb) - 2, -1, -1):
        out[t] = back[t + 1, out[t + 1]]
    return out


def fit_many(x, seeds, student=True, rounds=regimes.ROUNDS):
    """(pi, a, mu, var, nu, log likelihood) from each random start; starts that have converged stand still."""
    n = len(seeds)
    mu = np.stack([np.sort(x[np.random.default_rng(s).choice(len(x), size=regimes.STATES, replace=False)]) for s in seeds])
    var, nu = np.full((n, regimes.STATES), max(np.var(x), regimes.VAR_LEAST)), np.full((n, regimes.STATES), regimes.NU_START if student else np.inf)
    pi, a, before, at = np.full((n, regimes.STATES), 1 / regimes.STATES), np.full((n, regimes.STATES, regimes.STATES), 1 / regimes.STATES), np.full(n, -np.inf), np.arange(n)
    y = x[:, None, None]
    for step in range(rounds):
        logb = regimes.log_emissions(x, mu[at], var[at], nu[at])
        alpha, scale, score = forward_many(pi[at], a[at], logb)
        beta = backward_many(a[at], logb, scale)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        c = np.exp(logb - logb.max(axis=2, keepdims=True)) / scale[:, :, None] * beta
        xi = a[at] * np.einsum("tsi,tsj->sij", alpha[:-1], c[1:])
        z = (y - mu[at]) ** 2 / var[at]
        u = (nu[at] + 1) / (nu[at] + z) if student else np.ones_like(z)
        weight, wu = gamma.sum(axis=0), gamma * u
        new_mu = (wu * y).sum(axis=0) / wu.sum(axis=0)
        if student:
            log_u = regimes.digamma((nu[at] + 1) / 2) - np.log((nu[at] + z) / 2)
            term = (gamma * (log_u - u)).sum(axis=0) / weight
            nu[at] = regimes.solve_nu(term)
        var[at] = np.maximum((wu * (y - new_mu) ** 2).sum(axis=0) / weight, regimes.VAR_LEAST)
        mu[at], pi[at], a[at] = new_mu, gamma[0], xi / np.maximum(xi.sum(axis=2, keepdims=True), 1e-300)
        still = ~np.isfinite(score) | ((step > 0) & (np.abs(score - before[at]) < regimes.TOLERANCE * np.abs(before[at])))
        before[at], at = score, at[~still]
        if not len(at):
            break
    final = forward_many(pi, a, regimes.log_emissions(x, mu, var, nu))[2]
    return [(pi[i], a[i], mu[i], var[i], nu[i], float(final[i])) for i in range(n)]
