"""Hard negatives: a spanning tree of anchors carries bounds of scores from anchor to anchor, and only candidates in a window are rescored.

A candidate's score with an anchor differs from that with the anchor's parent by at most the length of the edge between the two anchors times
the candidate's own length. So each candidate has an interval of scores at every anchor of a tree, exact at the root and wherever it has
been rescored since. First the positives are found: rows of the anchor's label whose interval reaches the best ones so far. Their scores are
the windows of the second walk, in which the rows of other labels whose interval meets a window are rescored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, scratch
from spanloom.llm.tiles import finite, matrix, numbered_rows, tile_join

#: Anchors of a tree, and candidates whose intervals at all anchors of a tree are held at a time.
TREE, INNER = 256, 2048
#: Components are whole numbers below this in size, so that no score passes 64 bits.
LARGEST = 1 << 26
#: Scores below this are exact as doubles.
EXACT = float(1 << 53)


def spanning_tree(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree by distance: the anchors in the order in which they join it, the place of each one's parent in that order (-1 for
    the first), and the length of the edge to it."""
    n = len(anchors)
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    order, edges, parents = [], [], []
    at = 0
    for place in range(n):
        left[at] = False
        order.append(at)
        edges.append(0.0 if place == 0 else near[at])
        parents.append(parent[at])
        step = np.sqrt(((anchors - anchors[at]) ** 2).sum(axis=1))
        closer = left & (step < near)
        near[closer], parent[closer] = step[closer], place
        at = int(np.argmin(np.where(left, near, np.inf)))
    return np.array(order, np.int64), np.array(parents, np.int64), np.array(edges)


def scores(candidates: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if np.abs(candidates).max(initial=0) * np.abs(anchor).max(initial=0) * len(anchor) < EXACT:
        return (candidates @ anchor).astype(np.int64)
    return candidates.astype(np.int64) @ anchor.astype(np.int64)


class Best:
    """The k best (score, id) seen, higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, name: np.ndarray) -> None:
        score, name = np.append(self.score, score), np.append(self.id, name)
        order = np.lexsort((name, -score))[: self.k]
        self.score, self.id = score[order], name[order]

    @property
    def floor(self) -> float:
        """No score below it can enter."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def walk(anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray, candidates: np.ndarray, wanted, take) -> int:
    """Visits the anchors of a tree in order. wanted(anchor, low, high): which candidates need a score, by their bounds; take(anchor, at,
    score): gets the scores of those. Returns how many scores were computed, all of the root's among them."""
    length = np.sqrt((candidates**2).sum(axis=1))
    low, high = np.empty((len(anchors), len(candidates))), np.empty((len(anchors), len(candidates)))
    done = 0
    for i, (parent, edge) in enumerate(zip(parents.tolist(), edges.tolist(), strict=True)):
        if parent < 0:
            low[i] = high[i] = scores(candidates, anchors[i])
            done += len(candidates)
        else:
            reach = edge * length
            reach += 1 + 1e-9 * (reach + np.abs(high[parent]) + np.abs(low[parent]))  # more than doubles may lose
            low[i], high[i] = low[parent] - reach, high[parent] + reach
        at = np.flatnonzero(wanted(i, low[i], high[i]))
        if len(at):
            score = scores(candidates[at], anchors[i])
            done += len(at) if parent >= 0 else 0
            low[i, at] = high[i, at] = score
            take(i, at, score)
    return done


def anchor_trees(anchors: DataFrame) -> DataFrame:
    """The anchors (row, id, label, v) in trees of about TREE of one length: with tree, and their place, parent and edge in it."""
    counts = anchors.groupBy(F.size("v").alias("length")).agg(F.ceil(F.count("*") / TREE).cast("int").alias("trees"))
    dealt = anchors.withColumn("length", F.size("v")).join(counts, "length").withColumn("tree", F.pmod(F.xxhash64("row"), F.col("trees")).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        order, parents, edges = spanning_tree(matrix(table["v"]))
        out = table.take(pa.array(order)).select(["row", "id", "label", "v"])
        return out.append_column("tree", pa.array([f"{x}:{y}" for x, y in zip(table["length"].to_pylist(), table["tree"].to_pylist(), strict=True)])).append_column("place", pa.array(np.arange(len(order)), pa.int32())).append_column("parent", pa.array(parents, pa.int32())).append_column("edge", pa.array(edges))

    return dealt.groupBy("length", "tree").applyInArrow(run, "row long, id long, label long, v array<double>, tree string, place int, parent int, edge double")


def in_trees(one: pa.Table, two: pa.Table):
    """Each tree of a tile, in order of its places, with the pieces of the candidates: table, vectors and pieces as (slice, names, labels, vectors)."""
    if not len(one) or not len(two):
        return
    names, labels, vectors = two["id"].to_numpy(), two["label"].to_numpy(), matrix(two["v"])
    one = one.sort_by([("tree", "ascending"), ("place", "ascending")])
    heads = np.append(np.flatnonzero(one["parent"].to_numpy() < 0), len(one))
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        tree = one.slice(a, b - a)
        pieces = ((names[c : c + INNER], labels[c : c + INNER], vectors[c : c + INNER]) for c in range(0, len(names), INNER))
        yield tree, matrix(tree["v"]), pieces


@scratch
def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """For each row that is_anchor (a condition on id_col) picks and each of its positives, the best `positives` rows of its label and another
    id: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score, of the best `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. A score is the inner product with the anchor; higher ones come
    first, ties by smaller id; all there are, if fewer.

    Vectors hold whole numbers (see whole()), ids and labels are whole numbers. Rows without an id or label take no part; nor do vectors that are
    null or empty, hold a component that is null, not finite or of 2**26 or more in size, whose scores might pass 64 bits. Vectors meet those of
    their own dimension only. Repeated rows count each; equal anchor rows are searched once, and rows that share an id but not the vector
    or label each. An empty table gives an empty result. Other columns aren't read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), is_anchor.alias("asks"))
    fits = F.forall("v", lambda x: F.abs(x) < LARGEST)
    rows = numbered_rows(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")) & fits))
    anchors = rows.where("asks").groupBy("id", "label", "v").agg(F.min("row").alias("row"))
    trees = materialise(anchor_trees(anchors))
    candidates = rows.select("row", "id", "label", "v")

    def nearest(one: pa.Table, two: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("row", "id", "score")}
        for tree, own, pieces in in_trees(one, two):
            ids, labels = tree["id"].to_numpy(), tree["label"].to_numpy()
            best = [Best(positives) for _ in ids]
            for names, kinds, held in pieces:

                def wanted(i: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    same = (kinds == labels[i]) & (names != ids[i])
                    bound = best[i].floor
                    if np.count_nonzero(same) >= positives:
                        bound = max(bound, np.partition(least[same], -positives)[-positives])
                    return same & (most >= bound)

                walk(own, tree["parent"].to_numpy(), tree["edge"].to_numpy(), held, wanted, lambda i, at, score: best[i].add(score, names[at]))
            for row, b in zip(tree["row"].to_pylist(), best, strict=True):
                out["row"] += [row] * len(b.id)
                out["id"] += b.id.tolist()
                out["score"] += b.score.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    # trees stay whole in a tile
    found = tile_join(trees, candidates, nearest, "row long, id long, score long", place="tree")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    found = materialise(found.withColumn("place", place).where(F.col("place") <= positives))
    windows = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("w"))  # positives at most
    windows = windows.select("row", F.col("w.id").alias("positive"), F.col("w.score").alias("worth"))
    trees = materialise(trees.join(windows, "row", "left"))

    def hardest(one: pa.Table, two: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")}
        for tree, own, pieces in in_trees(one, two):
            ids, labels, worth, positive = tree["id"].to_numpy(), tree["label"].to_numpy(), [w or [] for w in tree["worth"].to_pylist()], tree["positive"].to_pylist()
            bounds = [[(-(-low * w // 100), high * w // 100) for w in ws] for ws in worth]
            best = [[Best(negatives) for _ in ws] for ws in worth]
            for names, kinds, held in pieces:

                def wanted(i: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    meets = np.zeros(len(least), bool)
                    for (a, b), seen in zip(bounds[i], best[i], strict=True):
                        meets |= (most >= max(a, seen.floor)) & (least <= b)
                    return meets & (kinds != labels[i])

                def take(i: int, at: np.ndarray, score: np.ndarray) -> None:
                    for (a, b), seen in zip(bounds[i], best[i], strict=True):
                        fit = (score >= a) & (score <= b)
                        seen.add(score[fit], names[at[fit]])

                walk(own, tree["parent"].to_numpy(), tree["edge"].to_numpy(), held, wanted, take)
            for i, row in enumerate(tree["row"].to_pylist()):
                for j, b in enumerate(best[i]):
                    n = len(b.id)
                    for c, x in zip(out, (row, ids[i], j, positive[i][j], worth[i][j]), strict=False):
                        out[c] += [x] * n
                    out["negative_id"] += b.id.tolist()
                    out["negative_score"] += b.score.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    mined = tile_join(trees, candidates, hardest, "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long", place="tree")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole(vector: Column, scale: int = 256) -> Column:
    """The vector with each component x as floor(scale * x), a double; components that are null or not finite stay so."""
    big = lambda x: x.cast("double") * scale
    return F.transform(vector, lambda x: F.when(F.abs(big(x)) < 2.0**53, F.floor(big(x)).cast("double")).otherwise(big(x)))
