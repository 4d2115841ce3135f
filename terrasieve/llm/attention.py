"""One block of causal self-attention over subword ids, in numpy, with its gradient.

The input at a place is the id before it; normed embeddings make queries, keys and values; what
is attended to is added to the embedding and normed again. The next id is predicted in three
steps, its group, its class in the group and its place in the class, so that a place costs three
short rows of scores (49 in all, where two steps would take 129).

Weights are one flat vector with a view of it for each matrix: a step, a mean or a message is an
operation on one array. Rows of scores have their bias as the weight of an input that is 1.
"""

from __future__ import annotations

import math

import numpy as np

IDS = 4096
WIDTH, CONTEXT = 32, 4
DIM = 16
#: Classes of a group, and ids of a class.
FAN = 16
#: Rows of a block, all of whose targets are of one class.
ROWS = 16
#: Steps of a replica in a round, with batches of a size to match, and the most windows in a batch.
STEPS, BATCH, RATE = 112, 256, 0.03
#: Windows whose output is worked out together, and whose attention is, when scoring.
SCORE_BATCH, BODY_BATCH = 512, 256
#: Numbers that are raised together.
EXP_BLOCK = 131_072

_PAST = np.tril(np.ones((WIDTH, WIDTH), np.float32))
_ONES = {n: np.ones(n, np.float32) for n in (DIM, WIDTH)}
_LOG2E = np.float32(math.log2(math.e))
_ROUND = np.float32(1.5 * 2**23)


def slots(counts: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each id, whose digits to the base FAN are group (all that is left), class and
    member, and the number of groups that open a word. Ids that open and others stand in the
    order of their counts, in groups of their own."""
    place = np.empty(len(counts), np.int32)
    order = np.argsort(-counts, kind="stable")
    first, rest = order[opens[order]], order[~opens[order]]
    n = -(-len(first) // FAN**2)
    place[first], place[rest] = np.arange(len(first)), n * FAN**2 + np.arange(len(rest))
    return place, n


def n_classes(place: np.ndarray) -> int:
    """Groups: classes of the first step."""
    return int(place.max()) // FAN**2 + 1


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    return {
        "E": (IDS + 1, DIM),
        "P": (WIDTH, DIM),
        "QKV": (DIM, 3 * DIM),
        "O": (DIM, DIM),
        "G": (DIM + 1, groups),
        "C": (groups, DIM + 1, FAN),
        "U": (groups * FAN, DIM + 1, FAN),
    }


def size(groups: int) -> int:
    return sum(math.prod(s) for s in shapes(groups).values())


def views(flat: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(groups).items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def start_weights(counts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Small random matrices, and biases that give each id its share of the counts."""
    rng, n = np.random.default_rng(7), n_classes(place)
    flat = np.zeros(size(n), np.float32)
    w = views(flat, n)
    for name, scale in {"E": 0.5, "P": 0.1, "QKV": DIM**-0.5, "O": DIM**-0.5, "G": 0.1, "C": 0.1, "U": 0.1}.items():
        w[name][:] = rng.normal(size=w[name].shape) * scale
    w["QKV"][:, :DIM] *= DIM**-0.5  # the scale of attention is in the weights of queries
    by = np.zeros(n * FAN**2)
    by[place] = counts + 0.5
    for name, own in (("U", by.reshape(-1, FAN)), ("C", by.reshape(-1, FAN, FAN).sum(axis=2)), ("G", by.reshape(1, n, -1).sum(axis=2))):
        share = own / np.maximum(own.sum(axis=1, keepdims=True), 1e-30)
        w[name][..., -1, :] = np.where(share > 0, np.log(np.maximum(share, 1e-30)), -30.0)  # -30: no id has the place
    return flat


def _exp(x: np.ndarray) -> None:
    """Raises e to x in place, for x of -85 to 85 with a relative error of 2e-4: the whole part
    of the power of two is the exponent, a cubic gives the rest. Rows are brought to a sum of 1
    afterwards, so probabilities are exact ones of a slightly different curve."""
    if x.dtype != np.float32:
        np.exp(x, out=x)
        return
    flat = x.reshape(-1)
    for a in range(0, len(flat), EXP_BLOCK):
        x = flat[a : a + EXP_BLOCK]
        x *= _LOG2E
        whole = x + _ROUND  # its lowest bits are the whole part
        p = whole - _ROUND
        x -= p
        bits = whole.view(np.int32)
        bits <<= 23
        np.multiply(x, np.float32(0.0550887), out=p)
        p += np.float32(0.2426041)
        p *= x
        p += np.float32(0.6932762)
        p *= x
        p += np.float32(0.9999289)
        np.add(p.view(np.int32), bits, out=x.view(np.int32))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b."""
    return (a * b) @ _ONES[a.shape[1]]


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = _dot(x, x)
    r /= DIM
    r += 1e-5
    r = (1 / np.sqrt(r))[:, None]
    return x * r, r


def _norm_back(dy: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = y * (_dot(dy, y) / -DIM)[:, None]
    out += dy
    out *= r
    return out


def _body(w: dict, given: np.ndarray) -> tuple:
    b, width = given.shape
    x = w["E"].take(given, axis=0)
    x += w["P"]
    x = x.reshape(-1, DIM)
    n1, r1 = _norm(x)
    qkv = (n1 @ w["QKV"]).reshape(b, width, 3 * DIM)
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    s = q @ k.transpose(0, 2, 1)
    if np.linalg.norm(w["QKV"][:, :DIM] @ w["QKV"][:, DIM : 2 * DIM].T) * DIM > 60:  # rows of n1 have the length DIM ** 0.5
        np.clip(s, -60, 60, out=s)
    _exp(s)
    s *= _PAST
    z = 1 / (s.reshape(-1, width) @ _ONES[width])[:, None]
    o = (s @ v).reshape(-1, DIM)
    o *= z
    h = o @ w["O"]
    h += x
    h, r2 = _norm(h)
    return n1, r1, q, k, v, s, z, o, h, r2


def _by_class(place: np.ndarray, target: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """Of targets: an order by class; group, class and member in this order; where groups begin;
    the class of each block of ROWS rows that holds targets of one class only, and the row of
    each target in these blocks."""
    slot = place[target]
    order = np.argsort((slot // FAN).astype(np.uint16), kind="stable")
    slot = slot[order]
    own = slot // FAN
    count = np.bincount(own, minlength=groups * FAN)
    blocks = -(-count // ROWS)
    row = ((np.cumsum(blocks) - blocks) * ROWS - np.cumsum(count) + count)[own]
    row += np.arange(len(slot))
    edge = np.append(0, np.cumsum(count)[FAN - 1 :: FAN])
    return order, (own // FAN, own % FAN, slot % FAN), edge, np.repeat(np.arange(groups * FAN), blocks), row


def _parts(edge: np.ndarray) -> list[tuple[int, slice]]:
    """Those that have rows, and which they are."""
    return [(j, slice(edge[j], edge[j + 1])) for j in np.flatnonzero(np.diff(edge)).tolist()]


def _in_blocks(h: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows of h in their blocks; other rows of these are 0."""
    out = np.zeros((len(kind) * ROWS, h.shape[1]), h.dtype)
    out[row] = h
    return out.reshape(len(kind), ROWS, -1)


def _scores(w: dict, h: np.ndarray, dense: np.ndarray, edge: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """Scores of all groups and of the classes of their group, for rows in the order of classes,
    and of the members of their class for rows in blocks."""
    out = [h @ w["G"], np.empty((len(h), FAN), h.dtype), (dense @ w["U"].take(kind, axis=0)).reshape(-1, FAN)]
    for j, own in _parts(edge):
        np.matmul(h[own], w["C"][j], out=out[1][own])
    length = DIM**0.5  # of rows of h, without the 1
    squares = lambda u: np.einsum("...ij,...ij->...j", u, u)
    most = max((length * np.sqrt(squares(u[..., :-1, :])) + np.abs(u[..., -1, :])).max() for u in (w["G"], w["C"], w["U"]))
    if most > 80:  # else no score is as large
        for x in out:
            np.clip(x, -80, 80, out=x)
    return out


def _cells(x: np.ndarray, digit: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Where the digits' own scores are in all of x, of its rows or of those named."""
    return (np.arange(0, x.size, x.shape[1]) if row is None else row * x.shape[1]) + digit


def _with_one(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.ones((len(at), DIM + 1), h.dtype)
    out[:, :DIM] = h.take(at, axis=0)
    return out


def log_probabilities(
    w: dict, place: np.ndarray, opening: int, given: np.ndarray, target: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Natural logs of the probabilities of the targets that are scored and of the chance that
    a word opens (or the text ends) there; windows and columns of them."""
    width = given.shape[1]
    h = [_body(w, given[a : a + BODY_BATCH])[-2] for a in range(0, len(given), BODY_BATCH)]
    at = np.flatnonzero((target >= 0) & (np.arange(width) >= first[:, None]))
    order, digits, edge, kind, row = _by_class(place, target.ravel()[at], len(w["C"]))
    at = at[order]
    one = _with_one(np.concatenate(h), at)
    scores = _scores(w, one, _in_blocks(one, kind, row), edge, kind)
    out = sum(x.reshape(-1)[_cells(x, d, r)] for x, d, r in zip(scores, digits, (None, None, row), strict=True))
    for x in scores:
        _exp(x)
    parts = np.ones((len(w["C"]), 2), one.dtype)
    parts[opening:, 1] = 0
    sums = scores[0] @ parts  # of all groups, and of those that open a word
    for x in (sums[:, 0], scores[1] @ _ONES[FAN], (scores[2] @ _ONES[FAN])[row]):
        out -= np.log(x)
    return out, np.log(np.maximum(sums[:, 1] / sums[:, 0], 1e-30)), at // width, at % width


def _errors(x: np.ndarray, at: np.ndarray) -> float:
    """Turns scores into shares less one at the cells; the sum of the negative logs there."""
    _exp(x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    flat = x.reshape(-1)
    share = flat[at]
    flat[at] = share - 1
    return -float(np.log(np.maximum(share, 1e-30)).sum())


def gradients(w: dict, place: np.ndarray, given: np.ndarray, target: np.ndarray, g: dict) -> float:
    """Mean loss over the targets (-1: none); its gradient goes to ``g``."""
    width = given.shape[1]
    n1, r1, q, k, v, s, z, o, h, r2 = _body(w, given)
    at = np.flatnonzero(target >= 0)
    order, digits, edge, kind, row = _by_class(place, target.ravel()[at], len(w["C"]))
    at = at[order]
    one, n = _with_one(h, at), len(at)
    dense = _in_blocks(one, kind, row)
    scores = _scores(w, one, dense, edge, kind)
    loss = sum(_errors(x, _cells(x, d, r)) for x, d, r in zip(scores, digits, (None, None, row), strict=True))
    top, middle, low = scores
    np.matmul(one.T, top, out=g["G"])
    dh, more = top @ w["G"][:-1].T, np.empty((n, DIM), h.dtype)
    g["C"][:] = 0
    for j, own in _parts(edge):
        np.matmul(one[own].T, middle[own], out=g["C"][j])
        np.matmul(middle[own], w["C"][j, :-1].T, out=more[own])
    dh += more
    low = low.reshape(len(kind), ROWS, FAN)
    dh += (low @ w["U"][:, :-1].take(kind, axis=0).transpose(0, 2, 1)).reshape(-1, DIM).take(row, axis=0)
    start = np.flatnonzero(np.diff(kind, prepend=-1))
    g["U"][:] = 0
    g["U"][kind[start]] = np.add.reduceat(dense.transpose(0, 2, 1) @ low, start, axis=0)
    dx = np.zeros_like(h)
    dx[at] = dh
    dx = _norm_back(dx, h, r2)
    np.matmul(o.T, dx, out=g["O"])
    do = dx @ w["O"].T
    do *= z
    ds = do.reshape(v.shape) @ v.transpose(0, 2, 1)
    ds -= _dot(do, o).reshape(-1, width, 1)
    ds *= s
    dqkv = np.empty((len(given), width, 3 * DIM), h.dtype)
    np.matmul(ds, k, out=dqkv[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
    np.matmul(s.transpose(0, 2, 1), do.reshape(v.shape), out=dqkv[..., 2 * DIM :])
    dqkv = dqkv.reshape(-1, 3 * DIM)
    np.matmul(n1.T, dqkv, out=g["QKV"])
    dx += _norm_back(dqkv @ w["QKV"].T, n1, r1)
    g["P"][:] = dx.reshape(-1, width, DIM).sum(axis=0)
    ids = given.ravel()
    sort = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[sort]
    start = np.flatnonzero(np.diff(ids, prepend=-1))
    g["E"][:] = 0
    g["E"][ids[start]] = np.add.reduceat(dx.take(sort, axis=0), start, axis=0)
    for x in g.values():
        x /= n
    return loss / n


def take_steps(flat: np.ndarray, place: np.ndarray, given: np.ndarray, target: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Weights after one pass of Adam over the windows in ``STEPS`` shuffled batches (more, if a
    batch would be larger than ``BATCH``); the rate falls to a half over the steps."""
    flat, slope = flat.copy(), np.zeros_like(flat)
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    w, g = views(flat, n_classes(place)), views(slope, n_classes(place))
    order = np.random.default_rng(seed).permutation(len(given))
    batch = min(BATCH, -(-len(given) // STEPS))
    total = -(-len(given) // batch)
    for t in range(1, total + 1):
        own = order[(t - 1) * batch : t * batch]
        gradients(w, place, given[own], target[own], g)
        step = rate * (1 - 0.5 * t / total) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        m1 += np.float32(0.1) * (slope - m1)
        m2 += np.float32(0.01) * (slope * slope - m2)
        flat -= np.float32(step) * m1 / (np.sqrt(m2) + np.float32(1e-8))
    return flat
