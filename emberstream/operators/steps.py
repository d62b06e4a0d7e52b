"""What a batch does to a model, on arrays: admit observers, count hits, link and color, score rows.

``StreamClusterer`` runs these inside Spark's tasks over one model; ``KeyedClusterer`` over the model
of each key. A model is a ``State``: at most ``k`` observers, however long its stream is.

Colors. Every observer keeps a sparse map from color to weight: each time the graph is rebuilt and
the observer is in a cluster, the weights fade to now and the cluster's color gains one. Fading is
lazy: a map carries the time it was last touched, and its distribution (weights over their sum) does
not depend on the time. Clusters take over colors one to one, the greatest summed weight first;
clusters that are left get new colors. A row's label is the color with the greatest sum of its
nearest observers' distributions.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd

from ..functions.decay import fading
from ..functions.distance import METRICS
from .sampling import DIGITS, MODULUS, STEP

#: The most observers that a model may have: its tables are held whole by the driver and each task.
MOST_OBSERVERS = 20_000
#: Doubles of a block of distances that is held at once.
TILE = 1 << 22
#: Weights below this share of an observer's map are forgotten.
FAINT = 1e-12


@dataclass(frozen=True)
class Parameters:
    """All parameters of both models. The defaults are this engine's choice."""

    k: int = 200
    T: float = 400.0
    idle_observers: float = 0.3
    x: int = 5
    chi_min: int = 3
    chi_prop: float = 0.02
    zeta: float = 0.6
    e: int = 2
    freq_bins: int = 1
    max_freq: float = 1.0
    outlier_threshold: float = 5.0
    outlier_handling: bool = False
    rel_outlier_score: bool = False
    perturb: float = 0.0
    random_sampling: bool = False
    input_buffer: int = 0
    distance: str | Callable = "euclidean"
    p: float = 2.0
    seed: int = 0

    def __post_init__(self):
        if self.k < 1 or self.x < 1 or self.e < 1 or self.T <= 0:
            raise ValueError("k, x and e are at least 1, T is positive")
        if self.k > MOST_OBSERVERS:
            raise ValueError(f"k is at most {MOST_OBSERVERS}")
        if not 0 <= self.idle_observers < 1 or not 0 <= self.zeta <= 1 or not 0 <= self.chi_prop <= 1:
            raise ValueError("idle_observers, zeta and chi_prop are shares")
        if self.distance == "minkowski" and self.p < 1:
            raise ValueError("p must be at least 1")
        if not callable(self.distance) and self.distance not in (*METRICS, "minkowski"):
            raise ValueError(f"no metric {self.distance!r}")

    @property
    def fade(self) -> float:
        return fading(self.T)

    @property
    def named(self) -> tuple:
        return self.distance, self.p

    def plain(self) -> Parameters:
        """Without a function of one's own, which travels in the closure of a task instead."""
        return replace(self, distance="euclidean") if callable(self.distance) else self


#: Arrays of a state that have a row for each observer.
OF_OBSERVERS = ("oid", "data", "observations", "added", "touched", "label", "waves", "cutoff")


@dataclass
class State:
    """Observers as arrays, and their color maps as (owner, color, weight, time touched) entries."""

    oid: np.ndarray
    data: np.ndarray
    observations: np.ndarray
    added: np.ndarray
    touched: np.ndarray
    label: np.ndarray
    waves: np.ndarray
    cutoff: np.ndarray
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    color: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    colored: np.ndarray = field(default_factory=lambda: np.zeros(0))
    version: int = 0
    rows: int = 0
    next_color: int = 0

    @classmethod
    def new(cls, dim: int = 0, bins: int = 1) -> State:
        z = np.zeros(0)
        return cls(np.zeros(0, np.int64), np.zeros((0, dim)), z, z, z, np.zeros(0, np.int64), np.zeros((0, bins), complex), z)

    @property
    def now(self) -> float:
        return float(self.touched.max()) if len(self.touched) else 0.0

    def only(self, places: np.ndarray) -> State:
        """The same with these observers alone, and their maps."""
        out = replace(self, **{n: getattr(self, n)[places] for n in OF_OBSERVERS})
        mine = np.isin(self.owner, out.oid)
        return replace(out, **{n: getattr(self, n)[mine] for n in ("owner", "color", "weight", "colored")})

    def packed(self) -> bytes:
        data = io.BytesIO()
        np.savez(data, **{f.name: np.asarray(getattr(self, f.name)) for f in fields(self)})
        return data.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> State:
        with np.load(io.BytesIO(data)) as held:
            return cls(**{f.name: held[f.name] if held[f.name].ndim else held[f.name].item() for f in fields(cls)})


def distances(a: np.ndarray, b: np.ndarray, which, p: float = 2.0) -> np.ndarray:
    """All distances between rows of a and of b; ``which`` is a name or does just that."""
    if callable(which):
        return np.asarray(which(a, b), float)
    if which == "euclidean":
        gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        out = np.sqrt(np.maximum(gap, 0))
        # the product loses digits for near rows: those are computed from their differences
        near = np.argwhere(out < 1e-4 * (1 + np.sqrt((a * a).sum(1)[:, None])))
        if len(near):
            out[near[:, 0], near[:, 1]] = np.sqrt(((a[near[:, 0]] - b[near[:, 1]]) ** 2).sum(1))
        return out
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = np.abs(a[:, j, None] - b[None, :, j])
        out = np.maximum(out, d) if which == "chebyshev" else out + (d if which == "manhattan" else d**p)
    return out ** (1 / p) if which == "minkowski" else out


def strips(rows: int, wide: int) -> list[tuple[int, int]]:
    """Ranges of rows whose distances to ``wide`` others are a tile of bounded size."""
    step = max(1, TILE // max(1, wide))
    return [(a, min(a + step, rows)) for a in range(0, rows, step)]


# --- nearest of many observers, without most of the distances

#: Metrics for which the triangle inequality holds.
TRIANGLE = ("euclidean", "manhattan", "chebyshev", "minkowski")
#: From so many observers on, groups around pivots are worth their bounds; the results are the same.
PIVOTED = 1024


@dataclass
class Pivots:
    """Observers in about sqrt(k) groups, each around the pivot that is nearest: members of group g are
    ``member[first[g]:first[g + 1]]``, and none is nearer to its pivot than ``least`` or farther than ``most``."""

    data: np.ndarray
    named: tuple
    centre: np.ndarray
    member: np.ndarray
    first: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, named: tuple) -> Pivots:
        many = max(1, math.isqrt(len(data)))
        centre = data[np.arange(many) * len(data) // many]
        group, gap = np.zeros(len(data), np.int64), np.zeros(len(data))
        for a, b in strips(len(data), many):
            d = distances(data[a:b], centre, *named)
            group[a:b], gap[a:b] = d.argmin(1), d.min(1)
        member = np.argsort(group, kind="stable")
        first = np.searchsorted(group[member], np.arange(many + 1))
        least, most = np.full(many, np.inf), np.full(many, -np.inf)
        np.minimum.at(least, group, gap)
        np.maximum.at(most, group, gap)
        return cls(data, named, centre, member, first, least, most)

    def nearest(self, features: np.ndarray, x: int, skip: np.ndarray, eps: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, places, distances taken) of the ``x`` nearest observers of each row, by (distance
        to nine digits, place). ``skip`` is the place of a row's own observer, or -1; ``eps`` (not
        negative) is added to an observer's distances. A group is opened only for rows that could find
        one of their nearest there: the triangle inequality bounds the distance to its members."""
        near, place, taken = np.full((len(features), x), np.inf), np.full((len(features), x), len(self.data)), 0
        for a, b in strips(len(features), len(self.centre) + int(np.diff(self.first).max(initial=1))):
            near[a:b], place[a:b], n = self._strip(features[a:b], x, skip[a:b], eps)
            taken += n
        return near, place, taken

    def _strip(self, rows: np.ndarray, x: int, skip: np.ndarray, eps) -> tuple[np.ndarray, np.ndarray, int]:
        gap = distances(rows, self.centre, *self.named)
        bound = np.maximum(gap - self.most[None], self.least[None] - gap) - 1e-8 * (1 + gap + np.where(np.isfinite(self.most), self.most, 0)[None])
        turn = np.argsort(bound, axis=1, kind="stable")
        near, place, taken = np.full((len(rows), x), np.inf), np.full((len(rows), x), len(self.data)), gap.size
        for step in range(len(self.centre)):
            group = turn[:, step]
            held = np.take_along_axis(bound, group[:, None], 1)[:, 0]
            is_open = np.flatnonzero((held <= near[:, -1]) & (held < np.inf))
            if not len(is_open):
                break  # bounds rise from step to step
            is_open = is_open[np.argsort(group[is_open], kind="stable")]
            cut = np.flatnonzero(np.diff(group[is_open])) + 1
            for own in np.split(is_open, cut):
                g = group[own[0]]
                members = self.member[self.first[g] : self.first[g + 1]]
                d = distances(rows[own], self.data[members], *self.named) + (eps if np.isscalar(eps) else eps[members][None])
                d[members[None] == skip[own, None]] = np.inf
                taken += d.size
                both, at = np.concatenate([near[own], d], 1), np.concatenate([place[own], np.broadcast_to(members, d.shape)], 1)
                order = np.lexsort((at, np.round(both, 9)), axis=-1)[:, :x]
                near[own], place[own] = np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)
        return near, place, taken


def places(oid: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """The place in ``oid`` of each index, or -1."""
    if not len(oid):
        return np.full(len(idx), -1)
    order = np.argsort(oid, kind="stable")
    at = order[np.minimum(np.searchsorted(oid, idx, sorter=order), len(oid) - 1)]
    return np.where(oid[at] == idx, at, -1)


# --- observers


def drawn(rows: pd.DataFrame, p: Parameters, first: bool) -> pd.DataFrame:
    """Of a model's rows (idx, t, features), those that become observers: what the model of a whole
    stream draws by columns (``rank_of``, ``chance``, ``priority``)."""
    idx, t = rows["idx"].to_numpy(np.int64), rows["t"].to_numpy(float)
    if p.random_sampling:
        r = np.array([(int(hashlib.md5(f"{p.seed}:{i}".encode()).hexdigest()[:DIGITS], 16) + 0.5) / 16**DIGITS for i in idx.tolist()])
        r = np.log(-np.log(r)) - t / p.T if first else r
    else:
        r = (idx % MODULUS * STEP + p.seed) % MODULUS / MODULUS
    rows = rows.assign(r=r)
    if not first:
        rows = rows[rows["r"] < min(1.0, p.k / p.T)]
    return rows.sort_values(["r", "idx", "t"], kind="stable")[["idx", "t", "features"]].head(p.k)


def admit(s: State, p: Parameters, rows: pd.DataFrame) -> State:
    """The state with ``rows`` (idx, t, features) as new observers; the lowest averaged counts go
    first where there are more than k. Of rows that share an index one is taken."""
    rows = rows.drop_duplicates("idx")
    rows = rows[~rows["idx"].isin(s.oid)].sort_values(["t", "idx"])
    if not len(rows):
        return s
    now = float(max(rows["t"].max(), s.now))
    extra = max(0, len(s.oid) + len(rows) - p.k)
    if extra:
        av = s.observations * p.fade ** (now - s.touched) / np.maximum(1 - p.fade ** (now - s.added), 1e-12)
        s = s.only(np.sort(np.lexsort((s.oid, av))[extra:]))
    n, t = len(rows), rows["t"].to_numpy(float)
    data = np.stack(rows["features"].to_numpy()).astype(float)
    more = {"oid": rows["idx"].to_numpy(np.int64), "data": data, "observations": np.zeros(n), "added": t, "touched": t, "label": np.full(n, -1), "waves": np.zeros((n, p.freq_bins), complex), "cutoff": np.zeros(n)}
    return replace(s, **{name: np.concatenate([getattr(s, name), rows_]) if len(s.oid) else rows_ for name, rows_ in more.items()})


def active(s: State, p: Parameters, now: float) -> np.ndarray:
    """Indices of the observers that are not idle; new ones are active."""
    age = 1 - p.fade ** (now - s.added)
    av = np.where(age > 0, s.observations * p.fade ** (now - s.touched) / np.where(age > 0, age, 1), np.inf)
    keep = math.ceil((1 - p.idle_observers) * len(s.oid))
    return np.sort(np.lexsort((s.oid, -av))[:keep])


# --- rows and their nearest observers


def frequencies(p: Parameters) -> np.ndarray:
    return p.max_freq * np.arange(p.freq_bins) / max(1, p.freq_bins - 1)


def nearest(batch: pd.DataFrame, s: State, p: Parameters, act: np.ndarray, temporal: bool, named: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the nearest ``x`` active observers of each row, and the observers' places in
    ``act``. A row's own observer does not count."""
    features, t, idx = np.stack(batch["features"].to_numpy()).astype(float), batch["t"].to_numpy(float), batch["idx"].to_numpy()
    x = min(p.x, len(act))
    near, order = np.zeros((len(batch), x)), np.zeros((len(batch), x), np.int64)
    eps = p.perturb * ((s.oid[act] % MODULUS * STEP + p.seed) % MODULUS / MODULUS)[None] if p.perturb else 0.0
    waves = s.waves[act] / np.maximum(np.abs(s.waves[act][:, :1]), 1e-12)
    pruned = len(act) >= PIVOTED and named[0] in TRIANGLE and not (temporal and p.freq_bins > 1)
    if pruned:
        near, order, _ = Pivots.of(s.data[act], named).nearest(features, x, places(s.oid[act], idx), eps[0] if p.perturb else 0.0)
    for a, b in [] if pruned else strips(len(batch), len(act)):
        d = distances(features[a:b], s.data[act], *named) + eps
        d[idx[a:b, None] == s.oid[act][None]] = np.inf
        rank = d
        if temporal and p.freq_bins > 1:
            phase = np.exp(-1j * frequencies(p)[None] * t[a:b, None])
            rank = d / np.maximum((phase @ waves.T).real / p.freq_bins, 0.05)
        order[a:b] = np.argsort(np.round(rank, 9), axis=1, kind="stable")[:, :x]
        near[a:b] = np.take_along_axis(d, order[a:b], 1)
    if x > 1 and np.isinf(near).any():
        for i in np.flatnonzero(np.isinf(near).any(1)):
            good = [j for j in range(x) if not np.isinf(near[i, j])] or [0]
            good = (good * x)[:x]
            order[i], near[i] = order[i, good], near[i, good]
    return np.where(np.isinf(near), 0.0, near), order


def hits(batch: pd.DataFrame, s: State, p: Parameters, act: np.ndarray, temporal: bool, named: tuple, now: float) -> tuple[np.ndarray, np.ndarray]:
    """Faded hits of each observer by the rows of a batch, and with their phases."""
    k = len(s.oid)
    waves = np.zeros((k, p.freq_bins), complex)
    _, order = nearest(batch, s, p, act, temporal, named)
    t = batch["t"].to_numpy(float)
    w, o = np.repeat(p.fade ** (now - t), order.shape[1]), act[order.ravel()]
    if temporal:
        np.add.at(waves, o, w[:, None] * np.exp(1j * frequencies(p)[None, :] * np.repeat(t, order.shape[1])[:, None]))
    return np.bincount(o, w, k), waves


def absorb(s: State, p: Parameters, counted: np.ndarray, waves: np.ndarray, now: float, rows: int) -> State:
    """The state at ``now`` with the hits of ``rows`` rows."""
    old = p.fade ** (now - s.touched)
    return replace(s, observations=s.observations * old + counted, waves=s.waves * old[:, None] + waves, touched=np.full(len(s.oid), now), rows=s.rows + rows)


# --- clusters and colors


def _components(data: np.ndarray, cut: np.ndarray, named: tuple) -> np.ndarray:
    """The least place of each set of observers that are linked, directly or over others: both their
    cutoffs lie above the distance. Distances are taken strip by strip and not kept."""
    part = np.arange(len(data))
    links = []
    for a, b in strips(len(data), len(data)):
        d = distances(data[a:b], data, *named)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        i, j = np.nonzero((d < cut[a:b, None]) & (d < cut[None, :]))
        i = i + a
        if len(links) and sum(map(len, links)) > TILE:
            links = [solved(part, np.concatenate(links))]
        links.append(np.stack([i, j], 1)[i < j])
    solved(part, np.concatenate(links) if links else np.zeros((0, 2), np.int64))
    return part


def solved(part: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Lowers ``part`` to the least place of each component, in place; a spanning forest of the links."""
    while True:
        before = part.copy()
        np.minimum.at(part, links[:, 0], before[links[:, 1]])
        np.minimum.at(part, links[:, 1], before[links[:, 0]])
        part[:] = part[part]
        if (part == before).all():
            return np.stack([part, np.arange(len(part))], 1)


def inherit(part: np.ndarray, ranks: dict[int, int], color: np.ndarray, weight: np.ndarray) -> dict[int, int]:
    """Component to color, one to one: of the summed weights of (component, color) the greatest first,
    ties by the component's rank, then by color. ``part`` is the component of each weight."""
    sums: dict[tuple[int, int], float] = {}
    for c, old, w in zip(part.tolist(), color.tolist(), weight.tolist(), strict=True):
        if c in ranks:
            sums[c, old] = sums.get((c, old), 0.0) + w
    out, used = {}, set()
    for _, _, old, c in sorted((-round(w, 9), ranks[c], old, c) for (c, old), w in sums.items()):
        if c not in out and old not in used:
            out[c] = old
            used.add(old)
    return out


def update(s: State, p: Parameters) -> State:
    """Cutoffs, links, clusters of at least ``e`` active observers, and their colors."""
    act, now = active(s, p, s.now), s.now
    cutoff, label = np.zeros(len(s.oid)), np.full(len(s.oid), -1)
    if len(act) < 2:
        return replace(s, cutoff=cutoff, label=label)
    chi = min(len(act) - 1, max(p.chi_min, math.ceil(p.chi_prop * len(act))))
    data, h = s.data[act], np.zeros(len(act))
    for a, b in strips(len(act), len(act)):
        d = distances(data[a:b], data, *p.named)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        h[a:b] = np.partition(d, chi - 1, axis=1)[:, chi - 1]
    cutoff[act] = h
    part = _components(data, p.zeta * h + (1 - p.zeta) * h.mean(), p.named)
    names, sizes = np.unique(part, return_counts=True)
    large = sorted((-n, c) for n, c in zip(sizes.tolist(), names.tolist(), strict=True) if n >= p.e)
    ranks = {c: i for i, (_, c) in enumerate(large)}
    # the maps of active observers, faded to now
    place = np.full(len(s.oid), -1)
    place[act] = np.arange(len(act))
    by_oid = np.argsort(s.oid, kind="stable")
    owner = by_oid[np.searchsorted(s.oid, s.owner, sorter=by_oid)] if len(s.owner) else np.zeros(0, np.int64)
    faded = s.weight * p.fade ** (now - s.colored)
    mine = place[owner] >= 0
    given = inherit(part[place[owner[mine]]], ranks, s.color[mine], faded[mine])
    next_color = s.next_color
    for c in ranks:
        if c not in given:
            given[c], next_color = next_color, next_color + 1
    inside = np.isin(part, list(given))
    label[act[inside]] = [given[c] for c in part[inside].tolist()]
    # members' maps are touched: faded, and one more for the color of now
    touched = label[owner] >= 0
    members = np.flatnonzero(label >= 0)
    entries = pd.DataFrame({
        "owner": np.concatenate([s.owner, s.oid[members]]),
        "color": np.concatenate([s.color, label[members]]),
        "weight": np.concatenate([np.where(touched, faded, s.weight), np.ones(len(members))]),
        "colored": np.concatenate([np.where(touched, now, s.colored), np.full(len(members), now)]),
    })
    entries = entries.groupby(["owner", "color"], as_index=False).agg({"weight": "sum", "colored": "max"})
    entries = entries[entries["weight"] >= FAINT * entries.groupby("owner")["weight"].transform("sum")]
    maps = {n: entries[n].to_numpy() for n in ("owner", "color", "weight", "colored")}
    return replace(s, cutoff=cutoff, label=label, next_color=next_color, **maps)


def distribution(s: State) -> np.ndarray:
    """Each entry's share of its observer's map."""
    _, at = np.unique(s.owner, return_inverse=True)
    return s.weight / np.bincount(at, s.weight)[at] if len(at) else np.zeros(0)


# --- scores


def vote(s: State, observers: np.ndarray) -> np.ndarray:
    """The color with the greatest sum of the distributions of each row's observers (places in the
    state), the least among equals; -1 where none has a color."""
    out = np.full(len(observers), -1)
    share = distribution(s)
    order = np.argsort(s.owner, kind="stable")
    first, last = (np.searchsorted(s.owner, s.oid, side, sorter=order) for side in ("left", "right"))
    many = (last - first)[observers.ravel()]
    if not many.sum():
        return out
    entry = order[np.repeat(first[observers.ravel()], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    row = np.repeat(np.repeat(np.arange(len(observers)), observers.shape[1]), many)
    votes = pd.DataFrame({"row": row, "color": s.color[entry], "w": share[entry]}).groupby(["row", "color"], as_index=False)["w"].sum()
    votes["w"] = votes["w"].round(9)
    best = votes.sort_values(["row", "w", "color"], ascending=[True, False, True]).drop_duplicates("row")
    out[best["row"].to_numpy()] = best["color"].to_numpy()
    return out


def score(batch: pd.DataFrame, s: State, p: Parameters, act: np.ndarray, temporal: bool, named: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(label, score) of each row of a batch."""
    near, order = nearest(batch, s, p, act, temporal, named)
    ratio = near / np.maximum(s.cutoff[act][order], 1e-12) if p.rel_outlier_score else near
    scores = np.median(ratio, axis=1)
    label = vote(s, act[order])
    return np.where(scores > p.outlier_threshold, -1, label) if p.outlier_handling else label, scores
