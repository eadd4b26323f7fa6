"""Listwise boosted trees: lambda gradients within a session's rows, splits from histograms that tasks sum.

Rows are packed once into blocks of whole sessions, features as bin codes. Many models (objectives, subsets of features) grow in
lockstep over the same blocks: a pass adds up histograms of (model, node, feature, bin) for the nodes that each model may split next,
and only the best split of each node comes to the driver. Gradients are summed in fixed point, so that trees do not
depend on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from trailmix.operators.wide import whole_sessions
from trailmix.session import shipped
from trailmix.sources import files

BLOCKS = "sizes binary, codes binary, aids binary, targets binary, scores binary"
#: Gradients and hessians are summed as whole numbers of this part of one.
FIXED = float(1 << 30)
HISTOGRAMS = "model int, node int, feature int, sums binary"
SPLITS = "model int, node int, feature int, bin int, gain double, total array<double>, left array<double>"


@dataclass(frozen=True)
class Settings:
    """``rounds`` at most, fewer if recall of the first ``top`` on whole selection queries has not risen for ``patience``; it is taken at the first round and every ``interval``."""

    rounds: int = 600
    leaves: int = 31
    rate: float = 0.05
    least_rows: int = 100
    least_hessian: float = 1e-3
    truncation: int = 25
    bins: int = 255
    interval: int = 5
    patience: int = 50
    top: int = 20

    def __post_init__(self):
        if min(self.rounds, self.leaves - 1, self.least_rows, self.truncation, self.interval, self.patience, self.top) < 1 or not 2 <= self.bins <= 256:
            raise ValueError("ranker settings must be positive, and bins fit in a byte")


@dataclass(frozen=True)
class Spec:
    """A model to fit: its name, the objective whose targets it ranks by, and its features."""

    name: str
    objective: str
    features: tuple[str, ...]


@dataclass
class Tree:
    """Parallel arrays; a leaf has feature -1. Rows with a value up to the threshold go left. ``cover`` counts the rows of the fit."""

    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves(self, columns: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node at which each row ends; ``limits`` are thresholds or bins, as ``columns`` are values or codes."""
        at, nodes = np.zeros(len(columns), np.int32), [0]
        for node in nodes:  # parents before their children
            if self.feature[node] >= 0:
                down = columns[:, self.feature[node]] <= limits[node]
                at = np.where(at == node, np.where(down, self.left[node], self.right[node]), at)
                nodes += [self.left[node], self.right[node]]
        return at

    def packed(self) -> dict[str, list]:
        return {k: v.tolist() for k, v in vars(self).items()}

    @classmethod
    def read(cls, packed: dict[str, list]) -> Tree:
        real = ("threshold", "value", "gain")
        return cls(**{k: np.array(v, np.float64 if k in real else np.int32) for k, v in packed.items()})


@dataclass
class Ensemble:
    """Trees in order; the first ``best`` of them score."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    best: int = 0
    recall: float = -1.0

    @property
    def used(self) -> list[Tree]:
        return self.trees[: self.best]

    def margins(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values))
        for tree in self.used:
            total += tree.value[tree.leaves(values, tree.threshold)]
        return total

    def importance(self) -> dict[str, float]:
        """Gain of the splits on each feature."""
        out = dict.fromkeys(self.features, 0.0)
        for tree in self.used:
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    out[self.features[f]] += float(gain)
        return out

    def content(self) -> dict:
        return {"features": self.features, "best": self.best, "recall": self.recall, "trees": [t.packed() for t in self.trees]}

    @classmethod
    def read(cls, content: dict) -> Ensemble:
        return cls(list(content["features"]), [Tree.read(t) for t in content["trees"]], content["best"], content["recall"])


def lambdas(scores: np.ndarray, labels: np.ndarray, sizes: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row for LambdaRank on 0/1 labels, queries one after the other.

    A pair of a relevant and another row counts if the better placed is among the first ``truncation``; it weighs the change of NDCG if
    the two changed places, tempered by their distance, and the gradients of a query are scaled by its sum of them. Queries of rows of one label have none.
    """
    g, h = np.zeros(len(scores)), np.zeros(len(scores))
    if not len(sizes):
        return g, h
    starts = np.cumsum(sizes) - sizes
    found = np.add.reduceat(labels.astype(np.int64), starts)
    mixed = np.flatnonzero((found > 0) & (found < sizes))
    classes = np.ceil(np.log2(np.maximum(sizes[mixed], 2))).astype(int)
    for width_class in np.unique(classes):
        some = mixed[classes == width_class]
        width = int(sizes[some].max())
        step = max(1, (1 << 20) // (width * min(truncation, width)))
        for a in range(0, len(some), step):
            part = some[a : a + step]
            _lambdas(scores, labels, starts[part], sizes[part], width, truncation, g, h)
    return g, h


def _lambdas(scores, labels, starts, sizes, width: int, truncation: int, g: np.ndarray, h: np.ndarray) -> None:
    place = np.arange(width)
    real = place < sizes[:, None]
    rows = np.where(real, starts[:, None] + place, 0)
    s = np.where(real, scores[rows], -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    rows, real = np.take_along_axis(rows, order, 1), np.take_along_axis(real, order, 1)
    s, y = np.where(real, scores[rows], 0.0), np.where(real, labels[rows] > 0, False)
    cut = min(truncation, width)
    discount = 1.0 / np.log2(place + 2.0)
    ideal = np.cumsum(discount)[np.minimum(y.sum(axis=1), truncation) - 1]
    worst = s[np.arange(len(s)), sizes - 1]
    up, down = y[:, :cut, None], y[:, None, :]
    pair = (up != down) & (place[:cut, None] < place[None, :]) & real[:, None, :] & real[:, :cut, None]
    gap = np.where(up, s[:, :cut, None] - s[:, None, :], s[:, None, :] - s[:, :cut, None])
    change = np.abs(discount[:cut, None] - discount[None, :])[None] / ideal[:, None, None]
    change = np.where((s[:, 0] != worst)[:, None, None], change / (0.01 + np.abs(gap)), change)
    p = 1.0 / (1.0 + np.exp(np.minimum(gap, 700.0)))
    pull = np.where(pair, change * p, 0.0)
    bend = np.where(pair, change * p * (1.0 - p), 0.0)
    signed = np.where(up, -pull, pull)
    grad, hess = -signed.sum(axis=1), bend.sum(axis=1)
    grad[:, :cut] += signed.sum(axis=2)
    hess[:, :cut] += bend.sum(axis=2)
    total = 2.0 * pull.sum(axis=(1, 2))
    scale = np.where(total > 0, np.log2(1.0 + total) / np.maximum(total, 1e-300), 1.0)[:, None]
    g[rows[real]], h[rows[real]] = (grad * scale)[real], (hess * scale)[real]


def thresholds(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature the values that part its bins, from quantiles in one aggregation; a value falls in the bin of the first that is not below it."""
    at = [float(x) for x in np.linspace(0, 1, bins)[1:-1]] if bins > 2 else [0.5]
    found: list = []
    for a in range(0, len(features), 200):  # a bounded number of sketches at a time
        some = [F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"_{i}") for i, f in enumerate(features[a : a + 200])]
        found += list(rows.agg(*some).first())
    return [np.unique(np.array(x if x else [0.0], float)) for x in found]


def blocks(rows: DataFrame, features: list[str], limits: list[np.ndarray], objectives: list[str], block_rows: int = 4096) -> DataFrame:
    """Blocks of whole sessions: sizes, bin codes by row, items and targets. One shuffle, on the session; rows of a session are in order of candidate_position."""
    shipped(rows.sparkSession)
    targets = [f"target_{o}" for o in objectives]
    ready = rows.select("session", "aid", "candidate_position", *[F.col(t).cast("int").alias(t) for t in targets], *[F.col(f).cast("double").alias(f) for f in features])
    ready = ready.repartition("session").sortWithinPartitions("session", "candidate_position", "aid")
    first = 3 + len(targets)

    def block(parts: list[tuple]) -> pa.RecordBatch:
        session, aid, target, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.flatnonzero(np.append(session[1:] != session[:-1], True)) + 1
        data = [np.diff(ends, prepend=0).astype("<i4"), code, aid.astype("<i8"), target, np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=["sizes", "codes", "aids", "targets", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            session = batch.column(0).to_numpy()
            codes = np.column_stack([np.searchsorted(x, batch.column(first + i).to_numpy(), "left") for i, x in enumerate(limits)]).astype(np.uint8)
            target = np.column_stack([batch.column(3 + i).to_numpy() for i in range(len(targets))]).astype(np.uint8)
            held.append((session, batch.column(1).to_numpy(), target, codes))
            if sum(len(x[0]) for x in held) >= block_rows:
                joined = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(joined[0], joined[0][-1]))  # the last session may go on in the next batch
                if cut:
                    yield block([tuple(x[:cut] for x in joined)])
                held = [tuple(x[cut:] for x in joined)]
        if held and len(held[0][0]):
            yield block(held)

    return ready.mapInArrow(run, BLOCKS)


class _Block:
    """A block as arrays, with the scores of every model."""

    def __init__(self, row: list, n_features: int, n_objectives: int, n_models: int):
        sizes, codes, aids, targets, scores = row
        self.sizes, self.aids = np.frombuffer(sizes, "<i4"), np.frombuffer(aids, "<i8")
        n = len(self.aids)
        self.codes = np.frombuffer(codes, np.uint8).reshape(n, n_features)
        self.targets = np.frombuffer(targets, np.uint8).reshape(n, n_objectives)
        self.scores = np.frombuffer(scores, "<f8").reshape(n_models, n).copy() if scores else np.zeros((n_models, n))

    def grown(self, trees: list[list[Tree]], columns: list[np.ndarray]) -> None:
        for m, (new, own) in enumerate(zip(trees, columns, strict=True)):
            codes = self.codes[:, own] if new else None
            for tree in new:
                self.scores[m] += tree.value[tree.leaves(codes, tree.bin)]


class _Growth:
    """One tree while it grows, best split first. Nodes whose split is known may be opened ahead of their turn."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.stats: list[tuple[float, float, float] | None] = [None]
        self.split: dict[int, tuple | None] = {}
        self.child: dict[int, tuple[int, int]] = {}

    def known(self, node: int, best: tuple | None) -> None:
        self.split[node] = best

    def replay(self) -> tuple[list[int], list[int], bool]:
        """(nodes split so far in order, leaves that wait for their children's splits, whether the tree is done)."""
        most = self.settings.leaves - 1
        heap = [(-self.split[0][2], 0)] if self.split.get(0) else []
        done: list[int] = []
        while heap and len(done) < most:
            node = heap[0][1]
            if node not in self.child:
                self.open(node)
            if len(done) + 1 < most and any(c not in self.split for c in self.child[node]):
                return done, [n for _, n in heapq.nsmallest(most - len(done), heap)], False
            heapq.heappop(heap)
            done.append(node)
            for c in self.child[node]:
                if self.split.get(c):
                    heapq.heappush(heap, (-self.split[c][2], c))
        return done, [], True

    def open(self, node: int) -> None:
        """Make the children of a node; those that are too small to be split are known at once."""
        total, left = self.split[node][3:]
        a = len(self.stats)
        self.stats += [tuple(left), tuple(t - x for t, x in zip(total, left, strict=True))]
        self.child[node] = (a, a + 1)
        for c in (a, a + 1):
            if self.stats[c][2] < 2 * self.settings.least_rows or self.stats[c][1] < 2 * self.settings.least_hessian:
                self.split[c] = None

    def wanted(self) -> list[int]:
        """Nodes whose best split the next pass should tell; none when the tree is done."""
        if 0 not in self.split:
            return [0]
        _, ahead, done = self.replay()
        if done:
            return []
        out = []
        for node in ahead:
            if node not in self.child:
                self.open(node)
            out += [c for c in self.child[node] if c not in self.split]
        return out

    def tree(self, nodes: list[int], limits: list[np.ndarray]) -> Tree:
        """The tree in which exactly ``nodes`` are split."""
        inner, order, n = set(nodes), [0], 0
        for node in order:
            if node in inner:
                order += self.child[node]
        at = {node: i for i, node in enumerate(order)}
        n = len(order)
        out = Tree(*(np.zeros(n, np.float64 if k in (1, 5, 7) else np.int32) for k in range(8)))
        for node, i in at.items():
            stats = self.stats[node]
            out.cover[i] = stats[2] if stats else 0
            out.feature[i] = -1
            if node in inner:
                f, b, gain, _, _ = self.split[node]
                out.feature[i], out.bin[i], out.gain[i] = f, b, gain
                out.threshold[i] = limits[f][b]
                out.left[i], out.right[i] = (at[c] for c in self.child[node])
            elif stats and stats[1] > 0:
                out.value[i] = -self.settings.rate * stats[0] / stats[1]
        return out


def best_split(sums: np.ndarray, settings: Settings) -> tuple[int, float, list[float]] | None:
    """(bin, gain, left sums) of the best cut of one feature's histogram (gradient, hessian, rows by bin; fixed point); ties go to the smaller bin."""
    left = np.cumsum(sums, axis=1)
    total = left[:, -1:]
    g, h, n = left[0] / FIXED, left[1] / FIXED, left[2]
    rg, rh, rn = (total[0] - left[0]) / FIXED, (total[1] - left[1]) / FIXED, total[2] - n
    fair = (n >= settings.least_rows) & (rn >= settings.least_rows) & (h >= settings.least_hessian) & (rh >= settings.least_hessian)
    if not fair.any():
        return None
    whole = (total[0, 0] / FIXED) ** 2 / (total[1, 0] / FIXED)
    gains = np.where(fair, g * g / np.where(fair, h, 1.0) + rg * rg / np.where(fair, rh, 1.0) - whole, -np.inf)
    b = int(np.argmax(gains))
    return (b, float(gains[b]), [float(g[b]), float(h[b]), float(n[b])]) if gains[b] > 0 else None


class Trainer:
    """Fits the models of ``specs`` on blocks of the fit role, their rounds by recall on blocks of the selection role.

    ``denominators`` has for each objective the sum of recall denominators over all selection queries. With a ``folder`` on shared storage
    the state is written there every ``interval`` rounds under the hash of what it depends on, and a later call with the same content goes on from it.
    """

    def __init__(self, fit: DataFrame, selection: DataFrame, features: list[str], limits: list[np.ndarray], objectives: list[str], specs: list[Spec], denominators: dict[str, int], settings: Settings | None = None, folder: str | None = None, lineage: dict | None = None):
        if unknown := {f for s in specs for f in s.features} - set(features):
            raise ValueError(f"features without codes: {sorted(unknown)[:3]}")
        if any(denominators.get(s.objective, 0) < 1 for s in specs):
            raise ValueError("every objective needs a positive denominator")
        self.spark, self.features, self.limits, self.objectives, self.specs = fit.sparkSession, features, limits, objectives, specs
        self.settings, self.denominators, self.folder = settings or Settings(), denominators, folder
        self.fit_blocks, self.selection = fit, selection
        self.columns = [np.array([features.index(f) for f in s.features]) for s in specs]
        self.goal = [objectives.index(s.objective) for s in specs]
        self.models = [Ensemble(list(s.features)) for s in specs]
        self.done, self.round, self.fresh = [False] * len(specs), 0, [[] for _ in specs]
        content = {"specs": [asdict(s) for s in specs], "settings": asdict(self.settings), "limits": [x.tolist() for x in limits], "denominators": denominators, "lineage": lineage or {}}
        self.contract = hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()
        shipped(self.spark)

    def _reader(self):
        shape = (len(self.features), len(self.objectives), len(self.specs))
        return lambda batch: (_Block([c[i].as_py() for c in batch.columns], *shape) for i in range(batch.num_rows))

    def histograms(self, growing: dict[int, tuple[Tree, dict[int, int]]]) -> DataFrame:
        """Sums over all blocks for the nodes asked for: model to (tree so far, its nodes to slots)."""
        read, columns, goal, fresh = self._reader(), self.columns, self.goal, self.fresh
        bins, truncation = self.settings.bins, self.settings.truncation

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {m: np.zeros((3, len(slots), len(columns[m]), bins), np.int64) for m, (_, slots) in growing.items()}
            for batch in batches:
                for block in read(batch):
                    block.grown(fresh, columns)
                    for m, (tree, slots) in growing.items():
                        codes = block.codes[:, columns[m]]
                        slot = np.full(len(tree.feature), -1, np.int64)
                        slot[list(slots)] = list(slots.values())
                        mine = slot[tree.leaves(codes, tree.bin)]
                        rows = np.flatnonzero(mine >= 0)
                        if not len(rows):
                            continue
                        g, h = lambdas(block.scores[m], block.targets[:, goal[m]], block.sizes, truncation)
                        g, h = np.rint(g[rows] * FIXED), np.rint(h[rows] * FIXED)
                        live = np.flatnonzero((g != 0) | (h != 0))  # most queries have no label of an objective among their rows
                        for a in range(0, codes.shape[1], 64):
                            some = codes[rows, a : a + 64].astype(np.int64)
                            width = some.shape[1]
                            key = (mine[rows, None] * width + np.arange(width)) * bins + some
                            size = len(slots) * width * bins
                            for k, w in enumerate((g, h, None)):
                                added = np.bincount(key.ravel(), None, size) if w is None else np.bincount(key[live].ravel(), np.repeat(w[live], width), size)
                                sums[m][k, :, a : a + width] += added.astype(np.int64).reshape(len(slots), width, bins)
            for m, (_, slots) in growing.items():
                for node, k in slots.items():
                    if sums[m][2, k].any():
                        data = [sums[m][:, k, f].tobytes() for f in range(len(columns[m]))]
                        n = len(data)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, node, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(data, pa.binary())], names=["model", "node", "feature", "sums"])

        return self.fit_blocks.mapInArrow(run, HISTOGRAMS)

    def splits(self, histograms: DataFrame) -> dict[tuple[int, int], tuple]:
        """The best split of each (model, node): histograms of tasks meet by (model, node, feature), and of each partition one split a node goes to the driver."""
        bins, settings = self.settings.bins, self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                for m, node, f, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    added = np.frombuffer(data, np.int64).reshape(3, bins)
                    sums[m, node, f] = sums[m, node, f] + added if (m, node, f) in sums else added
            best: dict[tuple[int, int], tuple] = {}
            for (m, node, f), x in sorted(sums.items()):
                total = x.sum(axis=1)
                whole = [total[0] / FIXED, total[1] / FIXED, float(total[2])]
                found = best_split(x, settings) or (-1, 0.0, [0.0, 0.0, 0.0])
                if (m, node) not in best or found[1] > best[m, node][2]:
                    best[m, node] = (f, found[0], found[1], whole, found[2])
            if best:
                rows = [(*k, *v) for k, v in best.items()]
                kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.list_(pa.float64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["model", "node", "feature", "bin", "gain", "total", "left"])

        out: dict[tuple[int, int], tuple] = {}
        for r in histograms.repartition("model", "node", "feature").mapInArrow(run, SPLITS).collect():
            key, new = (r["model"], r["node"]), (r["feature"], r["bin"], r["gain"], r["total"], r["left"])
            if key not in out or (-new[2], new[0]) < (-out[key][2], out[key][0]):
                out[key] = new
        return out

    def grow(self) -> dict[int, Tree]:
        """One tree for each model that goes on."""
        active = [m for m, over in enumerate(self.done) if not over]
        growths = {m: _Growth(self.settings) for m in active}
        limits = {m: [self.limits[c] for c in self.columns[m]] for m in active}
        while True:
            wanted = {m: w for m in active if (w := growths[m].wanted())}
            if not wanted:
                break
            growing = {}
            for m, nodes in wanted.items():
                opened = growths[m]
                tree, at = self._open_tree(opened, limits[m])
                growing[m] = (tree, {at[node]: k for k, node in enumerate(nodes)})
            back = {m: {i: nodes[k] for i, k in growing[m][1].items()} for m, nodes in wanted.items()}
            found = self.splits(self.histograms(growing))
            for m, nodes in wanted.items():
                told = {back[m][i]: v for (model, i), v in found.items() if model == m}
                for node in nodes:
                    best = told.get(node)
                    if node == 0 and best:
                        growths[m].stats[0] = tuple(best[3])
                    growths[m].known(node, best if best and best[1] >= 0 else None)
        return {m: growths[m].tree(growths[m].replay()[0], limits[m]) for m in active}

    @staticmethod
    def _open_tree(growth: _Growth, limits: list[np.ndarray]) -> tuple[Tree, dict[int, int]]:
        """The tree in which every opened node is split, and where its nodes are in it."""
        order = [0]
        for node in order:
            order += growth.child.get(node, ())
        return growth.tree(list(growth.child), limits), {node: i for i, node in enumerate(order)}

    def _rescored(self, df: DataFrame, name: str) -> DataFrame:
        """Blocks with the scores of the trees so far, written anew: later passes add only what has grown since."""
        read, columns, fresh = self._reader(), self.columns, self.fresh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = []
                for block in read(batch):
                    block.grown(fresh, columns)
                    scores.append(block.scores.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.binary())], names=batch.schema.names)

        return files.kept(df.mapInArrow(run, BLOCKS), name)

    def recalls(self) -> list[float]:
        """For each model the hits among the first rows of each selection query by score, ties by item, over all its denominators."""
        read, columns, fresh, goal, top, n_models = self._reader(), self.columns, self.fresh, self.goal, self.settings.top, len(self.specs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = np.zeros(n_models, np.int64)
            for batch in batches:
                for block in read(batch):
                    block.grown(fresh, columns)
                    query = np.repeat(np.arange(len(block.sizes)), block.sizes)
                    first = np.arange(len(query)) - np.repeat(np.cumsum(block.sizes) - block.sizes, block.sizes) < top
                    for m in range(n_models):
                        order = np.lexsort((block.aids, -block.scores[m], query))
                        hits[m] += int(block.targets[order[first], goal[m]].sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_models, dtype=np.int32)), pa.array(hits)], names=["model", "hits"])

        found = {r["model"]: r["hits"] for r in self.selection.mapInArrow(run, "model int, hits long").groupBy("model").agg(F.sum("hits").alias("hits")).collect()}
        return [found.get(m, 0) / self.denominators[s.objective] for m, s in enumerate(self.specs)]

    def _both_classes(self) -> None:
        read, goal, n_models = self._reader(), self.goal, len(self.specs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ones, rows = np.zeros(n_models, np.int64), 0
            for batch in batches:
                for block in read(batch):
                    ones += block.targets[:, goal].sum(axis=0, dtype=np.int64)
                    rows += len(block.aids)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_models, dtype=np.int32)), pa.array(ones), pa.array([rows] * n_models, pa.int64())], names=["model", "ones", "n"])

        for role, df in (("fit", self.fit_blocks), ("selection", self.selection)):
            sums = df.mapInArrow(run, "model int, ones long, n long").groupBy("model").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()
            if not sums or any(not 0 < r["ones"] < r["n"] for r in sums):
                raise ValueError(f"the ranker needs rows of both target classes in the {role} role")

    def _save(self) -> None:
        if self.folder:
            state = {"round": self.round, "done": self.done, "models": [m.content() for m in self.models]}
            files.write_text(self.spark, f"{self.folder}/{self.contract}/{self.round:06d}.json", json.dumps(state))

    def _resume(self) -> None:
        if not self.folder:
            return
        found = files.names(self.spark, f"{self.folder}/{self.contract}", ".json")
        if found:
            state = json.loads(files.read_text(self.spark, f"{self.folder}/{self.contract}/{found[-1]}"))
            self.round, self.done, self.models = state["round"], state["done"], [Ensemble.read(c) for c in state["models"]]
            self.fresh = [list(m.trees) for m in self.models]

    def run(self) -> dict[str, Ensemble]:
        settings = self.settings
        self._both_classes()
        self._resume()
        while self.round < settings.rounds and not all(self.done):
            self.round += 1
            for m, tree in self.grow().items():
                self.models[m].trees.append(tree)
                self.fresh[m] = [*self.fresh[m], tree]
            last = self.round == settings.rounds
            if self.round == 1 or self.round % settings.interval == 0 or last:
                if self.round > 1 or last:
                    self.fit_blocks, self.selection = self._rescored(self.fit_blocks, "boosted-fit"), self._rescored(self.selection, "boosted-selection")
                    self.fresh = [[] for _ in self.specs]
                for m, recall in enumerate(self.recalls()):
                    model = self.models[m]
                    if self.done[m]:
                        continue
                    if recall > model.recall:
                        model.recall, model.best = recall, self.round
                    self.done[m] = self.round - model.best >= settings.patience
                self._save()
        return {s.name: m for s, m in zip(self.specs, self.models, strict=True)}


def _scorer(models: dict[str, Ensemble]) -> tuple[list[str], dict[str, tuple[Ensemble, list[int]]]]:
    """The features on which some tree splits, and each model over its own of them, with their places."""
    lean = {}
    for name, m in models.items():
        mine = np.unique(np.concatenate([np.zeros(0, int), *[t.feature[t.feature >= 0] for t in m.used]]))
        trees = [replace(t, feature=np.where(t.feature >= 0, np.searchsorted(mine, t.feature), -1)) for t in m.used]
        lean[name] = replace(m, features=[m.features[f] for f in mine], trees=trees)
    names = sorted({f for m in lean.values() for f in m.features})
    return names, {k: (m, [names.index(f) for f in m.features]) for k, m in lean.items()}


def _columns(batch: pa.RecordBatch | pa.Table, first: int) -> np.ndarray:
    """The columns from ``first`` on, each in one stretch."""
    values = np.empty((batch.num_rows, batch.num_columns - first), order="F")
    for i in range(values.shape[1]):
        values[:, i] = batch.column(first + i).to_numpy()
    return values


def scored(rows: DataFrame, models: dict[str, Ensemble], keep: list[str]) -> DataFrame:
    """(*keep, model, score): every row under every model. Only features on which trees split are read."""
    shipped(rows.sparkSession)
    names, made = _scorer(models)
    shared = rows.sparkSession.sparkContext.broadcast(made)
    schema = rows.select(*keep).schema.add("model", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _columns(batch, len(keep))
            for name, (model, own) in shared.value.items():
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([name] * batch.num_rows), pa.array(model.margins(values[:, own]))], names=schema.names)

    return rows.select(*keep, *[F.col(f).cast("double").alias(f"_{f}") for f in names]).mapInArrow(run, schema)


def placed(rows: DataFrame, models: dict[str, Ensemble], keep: list[str]) -> DataFrame:
    """(session, aid, *keep, scores, ranks): arrays in the order of ``models``; ranks within the session are by score, ties by item.

    Rows of a session must lie in one partition, one after the other, as ``studied.matrix`` leaves them, so that nothing is shuffled.
    """
    shipped(rows.sparkSession)
    names, made = _scorer(models)
    shared = rows.sparkSession.sparkContext.broadcast(made)
    schema = rows.select("session", "aid", *keep).schema.add("scores", ArrayType(DoubleType())).add("ranks", ArrayType(IntegerType()))
    first = 2 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_sessions(batches):
            values, session, aid = _columns(t, first), t.column(0).to_numpy(), t.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, session[1:] != session[:-1]))
            before = np.repeat(starts, np.diff(starts, append=len(session)))
            scores = np.column_stack([model.margins(values[:, own]) for model, own in shared.value.values()])
            ranks = np.empty(scores.shape, np.int32)
            for m in range(scores.shape[1]):
                ranks[np.lexsort((aid, -scores[:, m], session)), m] = np.arange(len(session)) - before + 1
            ends = pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (scores, ranks)]
            yield pa.RecordBatch.from_arrays([*[t.column(i).combine_chunks() for i in range(first)], *lists], names=schema.names)

    return rows.select("session", "aid", *keep, *[F.col(f).cast("double").alias(f"_{f}") for f in names]).mapInArrow(run, schema)
