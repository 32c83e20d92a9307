"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on the driver to a bounded sample of distinct directions (unit vectors) and then
deepened: a leaf that holds more than ``LEAF_ROWS`` rows of the table is split by k-means of a sample
of its own rows, inside tasks, level after level. A query walks the tree with a priority queue: the
branch whose centre is nearest comes first, and the leaves come out in the order in which they are
visited. How many leaves a query visits is calibrated over the whole table: trial queries get exact
answers by one scan, and the walk is widened until they are found in the leaves visited, in sum and
for nearly every single query; a query goes on until its leaves hold enough rows. Queries then meet the
vectors of their leaves in blocks of bounded size on both sides.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import top_per
from factloom.llm.common import mix
from factloom.session import cut_lineage

#: Fitting reads at most this many vectors.
SAMPLE = 20_000
BRANCHES, LEAF_SIZE = 8, 64
#: Rows of a leaf beyond which it is split, the rows a split is fitted on, and the bytes of centres that end splitting.
LEAF_ROWS, SPLIT_SAMPLE, TREE_BYTES = 1024, 1024, 1 << 26
#: Recall to reach in calibration, over all trial queries and as the share of them that miss none; the number of trials.
RECALL, WHOLE, TRIALS = 0.98, 0.95, 300
#: Vectors and queries of one leaf that meet in one group.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
#: Visits (a query with its vector, once per leaf) that a task holds at a time.
VISIT_BLOCK = 16_384
#: Scores are compared to this many decimals; beyond, they are ties.
DECIMALS = 12


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Tree:
    """``centres`` of all nodes, the ``children`` of each (none for a leaf), and the number of each leaf."""

    def __init__(self, points: np.ndarray, seed: int = 13):
        draw = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [_mean(points)]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF_SIZE:
                continue
            centres, owner = _k_means(points[rows], BRANCHES, draw)
            if len(centres) < 2:
                continue
            todo.extend((child, rows[owner == k]) for k, child in enumerate(self._grow(node, centres)))
        self._number()

    def __getstate__(self) -> dict:
        """Tasks get the matrix of centres only; the list, which grows on the driver, would be a second copy."""
        return {**self.__dict__, "centres": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.centres = list(self.matrix)

    def _grow(self, node: int, centres: list[np.ndarray]) -> list[int]:
        first = len(self.centres)
        self.children[node] = list(range(first, first + len(centres)))
        self.centres.extend(centres)
        self.children.extend([] for _ in centres)
        return self.children[node]

    def _number(self) -> None:
        self.matrix = np.array(self.centres)
        self.leaf_of = {node: i for i, node in enumerate(n for n, c in enumerate(self.children) if not c)}
        self.n_leaves = len(self.leaf_of)

    def split(self, centres: dict[int, list[np.ndarray]]) -> None:
        """Gives leaves children with the ``centres`` by number of leaf; leaves are numbered anew."""
        node_of = {leaf: node for node, leaf in self.leaf_of.items()}
        for leaf in sorted(centres):
            self._grow(node_of[leaf], centres[leaf])
        self._number()

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the tree to the nearest centre."""
        out = np.empty(len(points), dtype=np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
                continue
            own = self.children[node]
            nearest = (points[rows] @ self.matrix[own].T).argmax(axis=1)
            todo.extend((child, rows[nearest == k]) for k, child in enumerate(own))
        return out

    def leaves(self, point: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and more until they hold ``least`` of the ``rows`` of leaves."""
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < most or met < least):
            _, node = heapq.heappop(queue)
            while node not in self.leaf_of:
                own = self.children[node]
                nearness = (self.matrix[own[0] : own[-1] + 1] @ point).tolist()
                ranked = sorted(zip((-x for x in nearness), own))
                for entry in ranked[1:]:
                    heapq.heappush(queue, entry)
                node = ranked[0][1]
            out.append(self.leaf_of[node])
            met += int(rows[out[-1]]) if rows is not None else 0
        return out


def _mean(points: np.ndarray) -> np.ndarray:
    centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
    size = np.linalg.norm(centre)
    return centre / size if size else centre


def _k_means(points: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
    """Spherical k-means; centres without points are left out, so equal points give one centre."""
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)]
    owner = np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        owner = (points @ centres.T).argmax(axis=1)
        centres = np.array([_mean(points[owner == c]) for c in np.unique(owner)])
    owner = (points @ centres.T).argmax(axis=1)
    used, owner = np.unique(owner, return_inverse=True)
    return list(centres[used]), owner


def calibrate(tree: Tree, points: np.ndarray, places: list[np.ndarray], recall: float = RECALL, whole: float = WHOLE) -> int:
    """Leaves to visit so that the trial ``points`` meet their neighbours, which lie in the leaves ``places``.

    The least number at which ``recall`` of all neighbours are met, and by a share ``whole`` of the
    points all of theirs. No neighbours: one leaf.
    """
    needed: list[int] = []
    last: list[int] = []
    for point, own in zip(points, places):
        if len(own):
            order = np.empty(tree.n_leaves, dtype=np.int64)
            walk = tree.leaves(point, tree.n_leaves)
            order[walk] = np.arange(1, len(walk) + 1)
            needed.extend(order[own].tolist())
            last.append(int(order[own].max()))
    if not needed:
        return 1
    cut = lambda values, share: sorted(values)[min(int(np.ceil(share * len(values))), len(values)) - 1]
    return max(cut(needed, recall), cut(last, whole))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _sample(vectors: DataFrame, sample: int) -> np.ndarray:
    """Distinct directions of at most ``sample`` of ``vectors(id, vector)``."""
    n = vectors.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = vectors.filter(place < int((1 << 30) * min(1.0, 0.95 * sample / max(n, 1)))).orderBy(place, "id").limit(sample)
    found = _stack(rows.select("vector").toPandas()["vector"])
    if not len(found):
        found = _stack(vectors.select("vector").limit(1).toPandas()["vector"])
    return np.unique(_unit(found), axis=0) if len(found) else found


def _assigned(vectors: DataFrame, tree: Tree) -> DataFrame:
    """``leaf, id, vector`` of ``vectors(id, vector)``."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["leaf"] = tree.assign(_unit(_stack(batch["vector"])))
            yield batch[["leaf", "id", "vector"]]

    return vectors.select("id", "vector").mapInPandas(assign, "leaf int, id long, vector array<double>")


def deepen(vectors: DataFrame, tree: Tree, most: int = LEAF_ROWS) -> None:
    """Splits leaves until none holds more than ``most`` rows, but those of equal vectors.

    A split is fitted on about ``SPLIT_SAMPLE`` rows of its leaf, in one task a leaf; the driver gets
    counts and centres only. It ends where the centres take ``TREE_BYTES``: beyond, leaves are larger.
    """
    done: set[int] = set()
    while tree.matrix.nbytes < TREE_BYTES:
        rows = _assigned(vectors, tree)
        node_of = {leaf: node for node, leaf in tree.leaf_of.items()}
        large = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().filter(F.col("count") > most).collect() if node_of[r["leaf"]] not in done}
        large = dict(sorted(large.items())[: max(TREE_BYTES // (tree.matrix[0].nbytes * BRANCHES), 1)])
        if not large:
            return
        share = np.zeros(tree.n_leaves)
        for leaf, count in large.items():
            share[leaf] = SPLIT_SAMPLE / count

        def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                draw = (mix(batch["id"].to_numpy().astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                yield batch[draw < share[batch["leaf"].to_numpy()]]

        def split(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
            points = np.unique(_unit(_stack(group["vector"])), axis=0)
            centres, _ = _k_means(points, BRANCHES, np.random.default_rng(key[0]))
            return pd.DataFrame({"leaf": key[0], "centre": [c.tolist() for c in centres]})

        found = rows.mapInPandas(thin, rows.schema).groupBy("leaf").applyInPandas(split, "leaf int, centre array<double>")
        centres: dict[int, list[np.ndarray]] = {}
        for row in found.collect():
            centres.setdefault(row["leaf"], []).append(np.array(row["centre"]))
        centres = {leaf: sorted(own, key=tuple) for leaf, own in centres.items() if len(own) > 1}
        done.update(node_of[leaf] for leaf in large if leaf not in centres)
        if not centres:
            return
        tree.split(centres)


def exact_places(own: DataFrame, trials: np.ndarray, k: int) -> list[np.ndarray]:
    """The leaves of the ``k`` rows of ``own(leaf, id, vector)`` nearest to each trial, by one scan.

    The trials are directions of rows of the table, so the first row found, their own, is left out.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            near = np.round(_unit(_stack(batch["vector"])) @ trials.T, DECIMALS)
            few = min(k + 1, len(batch))
            # Rows in the order of ids, so that equal scores keep the smallest.
            order = np.argsort(batch["id"].to_numpy(), kind="stable")
            pick = order[np.argsort(-near[order], axis=0, kind="stable")[:few]] if len(order) else np.zeros((0, len(trials)), dtype=np.int64)
            new = pd.DataFrame({
                "trial": np.tile(np.arange(len(trials), dtype=np.int32), few), "score": np.take_along_axis(near, pick, 0).ravel(),
                "id": batch["id"].to_numpy()[pick].ravel(), "leaf": batch["leaf"].to_numpy()[pick].ravel()})
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["trial", "score", "id"], ascending=[True, False, True]).groupby("trial").head(k + 1)
        if best is not None:
            yield best

    found = own.mapInPandas(scan, "trial int, score double, id long, leaf int")
    best = top_per(found, ["trial"], [F.col("score").desc(), F.col("id")], k + 1, "rank").filter("rank > 1").select("trial", "leaf").collect()
    places: list[list[int]] = [[] for _ in trials]
    for row in best:
        places[row["trial"]].append(row["leaf"])
    return [np.array(p, dtype=np.int64) for p in places]


def visits_of(batch: pd.DataFrame, leaves: Callable[[np.ndarray], list[int]], most: int = VISIT_BLOCK) -> Iterator[pd.DataFrame]:
    """``leaf, id, vector`` of every leaf that the queries ``batch(id, vector)`` visit, at most ``most`` rows at a time.

    Where neighbours are not clustered a query visits most leaves, so the visits of one batch have no bound.
    """
    rows, found, n = [], [], 0

    def block() -> pd.DataFrame:
        at = np.repeat(rows, [len(f) for f in found])
        return pd.DataFrame({"leaf": np.concatenate(found), "id": batch["id"].to_numpy()[at], "vector": batch["vector"].to_numpy()[at]})

    for row, point in enumerate(_unit(_stack(batch["vector"])) if len(batch) else ()):
        left = np.array(leaves(point), dtype=np.int32)
        while len(left):
            part, left = left[: most - n], left[most - n :]
            rows.append(row)
            found.append(part)
            n += len(part)
            if n == most:
                yield block()
                rows, found, n = [], [], 0
    if n:
        yield block()


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE) -> tuple[Tree, DataFrame, int] | None:
    """The tree, ``leaf, id, vector`` of all of ``vectors(id, vector)``, and the leaves to visit; None without rows."""
    points = _sample(vectors, sample)
    if not len(points):
        return None
    tree = Tree(points)
    deepen(vectors, tree)
    own = cut_lineage(_assigned(vectors, tree), "leaves")
    if tree.n_leaves == 1:
        return tree, own, 1
    trials = points[np.random.default_rng(29).choice(len(points), min(TRIALS, len(points)), replace=False)]
    return tree, own, calibrate(tree, trials, exact_places(own, trials, k))


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row where ``is_query`` holds.

    Candidates are all rows but the query's own; nearness is the cosine in double precision; ties go
    to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id or vectors whose length is not the commonest. Rows that repeat
    an id are one vector, the smallest. Every query gets ``k`` rows where there are as many: it visits
    leaves until they hold them. Copies of one vector share a leaf, which is met in blocks. An empty
    table gives no rows; other columns are not read.
    """
    rows = vectors.filter(usable(embedding) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 0
    rows = rows.filter(F.size("vector") == width).groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = cut_lineage(rows, "vectors")
    fitted = fit(rows, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    tree, own, visits = fitted
    held = np.zeros(tree.n_leaves, dtype=np.int64)
    for row in own.groupBy("leaf").count().collect():
        held[row["leaf"]] = row["count"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from visits_of(batch, lambda point: tree.leaves(point, visits, held, k + 1))

    def blocks(found: DataFrame, size: int, name: str) -> DataFrame:
        """Splits leaves into blocks of about ``size`` rows; counts are one row per leaf."""
        count = found.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(f"{name}s"))
        return count

    fields = "leaf int, id long, vector array<double>"
    asked = cut_lineage(rows.filter("asks").select("id", "vector").mapInPandas(walk, fields), "visits")
    # A tree is at most TREE_BYTES large, so the block counts of its leaves are a small table.
    counts = F.broadcast(blocks(own, VECTOR_BLOCK, "_v").join(blocks(asked, QUERY_BLOCK, "_q"), "leaf"))
    block = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = own.join(counts, "leaf").select("leaf", block("_vs").alias("vb"), every("_qs").alias("qb"), "id", "vector")
    right = asked.join(counts, "leaf").select("leaf", every("_vs").alias("vb"), block("_qs").alias("qb"), "id", "vector")

    def meet(vectors_here: pd.DataFrame, queries_here: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors_here) or not len(queries_here):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, a, b = vectors_here["id"].to_numpy(), _stack(vectors_here["vector"]), _stack(queries_here["vector"])
        order = np.argsort(ids)
        ids, a = ids[order], a[order]
        near = np.round(_unit(b) @ _unit(a).T, DECIMALS)
        out = []
        for q, asks in enumerate(queries_here["id"].to_numpy()):
            line = near[q]
            line[ids == asks] = -2
            least = np.partition(line, -k)[-k] if len(line) > k else -1.5
            above = np.flatnonzero(line > max(least, -1.5))
            ties = np.flatnonzero(line == least)[: k - len(above)] if least > -1.5 else np.zeros(0, dtype=np.int64)
            rows_here = np.concatenate([above, ties])
            exact = np.einsum("ij,j->i", a[rows_here], b[q]) / (np.sqrt(np.einsum("ij,ij->i", a[rows_here], a[rows_here])) * np.sqrt(np.einsum("j,j->", b[q], b[q])))
            out.append(pd.DataFrame({"query_id": asks, "vec_id": ids[rows_here], "score": exact}))
        return pd.concat(out)

    keys = ["leaf", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    ranked = top_per(found, ["query_id"], [F.round("score", DECIMALS).desc(), F.col("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
