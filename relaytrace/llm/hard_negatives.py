"""Hard negatives by threshold joins in the manner of L2AP.

Vectors become whole numbers, so scores (inner products) are exact.  Anchors
are taken in blocks of bounded size; each block goes to all rows in one pass,
in which a task reads its rows in blocks as well.

Dimensions are ordered by the anchors' weight in them.  The rest of a row from
some dimension on can add at most the product of its norm and the anchors'
greatest such norm; where that is below the least threshold, the index of the
row block leaves those dimensions out.  The lists of the other dimensions
accumulate partial scores for row and anchor, pairs whose partial score and
remaining norms cannot reach the anchor's threshold are pruned, and what is
left is scored to the end, again pruned on the way.

A search returns every pair at or over its anchor's threshold.  Thresholds start
high and are lowered until an anchor's windows are full or the window's own
lower end is reached; once full, the last score in a window is the threshold
for all further rows.  So the rows found are those of the full join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaytrace.session import scratch_path, ship_package

#: Factor before components are rounded down to whole numbers.
SCALE = 256
#: Anchors searched in one pass over the rows.
ANCHORS = 2048
#: Rows that are indexed together.
ROWS = 2048
#: Dimensions whose lists are added together.
SEGMENT = 8
#: Lowering steps from the highest possible score to none at all.
STEPS = (0.9, 0.7, 0.5, 0.3, 0.1)

_LOW = -float("inf")


def _norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row from each segment's first dimension on; 0 after the last."""
    sq = np.square(x.astype(np.float64))
    tail = np.cumsum(sq[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail[:, ::SEGMENT], np.zeros((len(x), 1))], axis=1))


def _over(bound: np.ndarray) -> np.ndarray:
    """A bound that rounding cannot make too small."""
    return bound * (1 + 1e-9) + 1e-6


class Anchors:
    """A block of anchors: whole-number vectors, labels and ids."""

    def __init__(self, ids: list, labels: list, vectors: list[list[int]], dims: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        x = _matrix(vectors, dims)
        energy = np.square(x.astype(np.float64)).sum(axis=0)
        self.order = np.argsort(-energy, kind="stable")
        self.x = x[:, self.order]
        self.norms = _norms(self.x)


def _matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :min(len(v), dims)] = v[:dims]
    return out


class Rows:
    """A block of rows that the anchors' dimensions order; ``index`` leaves
    dimensions out by a least threshold."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.norms = _norms(x)

    def part(self, rows: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.ids, out.labels, out.x, out.norms = self.ids[rows], self.labels[rows], self.x[rows], self.norms[rows]
        return out


def search(rows: Rows, anchors: Anchors, which: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, score)`` of all pairs of a row and one of the anchors
    ``which`` whose score is ``least[i]`` or more for the i-th of them."""
    none = np.zeros(0, np.int64)
    if not len(rows.ids) or not len(which):
        return none, none, none
    q, q_norms = anchors.x[which], anchors.norms[which]
    segments = rows.norms.shape[1] - 1
    exact = np.float64 if rows.norms[:, 0].max(initial=0) * q_norms[:, 0].max(initial=0) < 2.0 ** 52 else object
    # the first segment from which on a row's rest alone stays below every threshold
    reach = _over(rows.norms * q_norms.max(axis=0))
    keep = np.minimum((reach >= least.min()).sum(axis=1), segments)
    order = np.argsort(-keep, kind="stable")
    keep, x, x_norms = keep[order], rows.x[order].astype(exact), rows.norms[order]
    q = q.astype(exact)
    total = np.zeros((len(x), len(which)), exact)
    for s in range(segments):
        n = int((keep > s).sum())  # the list of this segment: rows that index it
        if not n:
            break
        dims = slice(s * SEGMENT, (s + 1) * SEGMENT)
        total[:n] += x[:n, dims] @ q[:, dims].T
    rest = _over(x_norms[np.arange(len(x)), keep][:, None] * q_norms.T[keep])
    r, a = np.nonzero(total + rest >= least)
    score = total[r, a]
    for s in range(int(keep.min(initial=segments)), segments):
        todo = np.flatnonzero(keep[r] <= s)
        dims = slice(s * SEGMENT, (s + 1) * SEGMENT)
        for lo in range(0, len(todo), 1 << 18):
            some = todo[lo:lo + (1 << 18)]
            score[some] += (x[r[some], dims] * q[a[some], dims]).sum(axis=1)
        left = np.where(keep[r] <= s, _over(x_norms[r, s + 1] * q_norms[a, s + 1]), _over(x_norms[r, keep[r]] * q_norms[a, keep[r]]))
        live = score + left >= least[a]
        r, a, score = r[live], a[live], score[live]
    ok = score >= least[a]
    return order[r[ok]], which[a[ok]], np.array([max(-2**63, min(2**63 - 1, int(v))) for v in score[ok]] if exact is object else score[ok], np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` first of each group: highest score, then least id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < many]


class Windows:
    """The best rows of each window of each anchor so far.

    Window w belongs to anchor ``anchor[w]`` and takes scores from ``low[w]`` to
    ``high[w]``; ``wanted`` says which rows may stand in an anchor's windows."""

    def __init__(self, anchors: Anchors, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, many: int, same_label: bool):
        self.anchors, self.anchor, self.low, self.high, self.many, self.same = anchors, anchor, low, high, many, same_label
        self.by = np.argsort(anchor, kind="stable")  # windows by anchor
        self.at = np.searchsorted(anchor[self.by], np.arange(len(anchors.ids) + 1))
        self.win = np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.need = low.astype(np.float64)  # score that a further row needs for a window
        self.full = np.zeros(len(anchor), bool)

    def _add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        each = (self.at[1:] - self.at[:-1])[a]  # windows of each pair's anchor
        pair = np.repeat(np.arange(len(a)), each)
        win = self.by[np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each) + self.at[a][pair]]
        ok = (score[pair] >= self.low[win]) & (score[pair] <= self.high[win])
        pair, win = pair[ok], win[ok]
        win, sc, ident = np.append(self.win, win), np.append(self.score, score[pair]), np.append(self.ids, ids[pair])
        top = _first(win, sc, ident, self.many)
        self.win, self.score, self.ids = win[top], sc[top], ident[top]
        n = np.bincount(self.win, minlength=len(self.anchor))
        self.full = n >= self.many
        worst = np.full(len(self.anchor), np.inf)
        np.minimum.at(worst, self.win, self.score)
        self.need = np.where(self.full, np.maximum(worst, self.low), self.low)

    def take(self, rows: Rows) -> None:
        """Offer a block of rows to every window."""
        if not len(self.anchor):
            return
        if not self.same:
            return self._offer(rows, np.unique(self.anchor))
        for label in np.intersect1d(rows.labels, self.anchors.labels).tolist():
            mine = np.unique(self.anchor)
            self._offer(rows.part(np.flatnonzero(rows.labels == label)), mine[self.anchors.labels[mine] == label])

    def _offer(self, rows: Rows, which: np.ndarray) -> None:
        highest = _over(rows.norms[:, 0].max(initial=0) * self.anchors.norms[:, 0])
        top = np.full(len(self.anchors.ids), -np.inf)
        np.maximum.at(top, self.anchor, self.high)
        highest = np.minimum(highest, top)
        above = np.full(len(self.anchors.ids), np.inf)  # scores from here on have been seen
        for step in (*STEPS, None):
            floor = np.full(len(self.anchors.ids), np.inf)  # an anchor's windows need no score below
            np.minimum.at(floor, self.anchor, self.need)
            live = which[floor[which] < above[which]]
            if not len(live):
                return
            least = floor[live] if step is None else np.maximum(floor[live], highest[live] * step)
            r, a, score = search(rows, self.anchors, live, np.minimum(least, above[live]))
            new = (score < above[a]) & (rows.ids[r] != self.anchors.ids[a]) & ((rows.labels[r] == self.anchors.labels[a]) == self.same)
            above[live] = np.minimum(least, above[live])
            self._add(a[new], score[new], rows.ids[r[new]])


def _rows(batches: Iterator[pa.RecordBatch], anchors: Anchors, dims: int, many: int = ROWS) -> Iterator[Rows]:
    for batch in batches:
        for lo in range(0, batch.num_rows, many):
            b = batch.slice(lo, many)
            x = _matrix(b.column(2).to_pylist(), dims)[:, anchors.order]
            yield Rows(b.column(0).to_numpy(), b.column(1).to_numpy(), x)


def whole_numbers(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, vec)`` of the rows that take part: label, id and vector not
    null, every component finite; components scaled and rounded down."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~bad).select(
        "id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("vec"))


def _pass(rows: DataFrame, schema: str, windows: Callable[[Anchors], Windows], block: tuple, dims: int) -> DataFrame:
    """One pass of a block of anchors over all rows; every task reports the best
    of its rows as ``(win, score, id)``."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*shared.value, dims)
        best = windows(anchors)
        for part in _rows(batches, anchors, dims):
            best.take(part)
        yield pa.RecordBatch.from_arrays([pa.array(best.win), pa.array(best.score), pa.array(best.ids)], ["win", "score", "id"])

    return rows.mapInArrow(run, schema)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = 5,
         negatives: int = 5, low: int = 80, scale: int = SCALE, block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the inner product of the whole-number vectors; higher scores come
    first, then smaller ids.  An anchor's positives are its first ``positives``
    rows of the same label.  For each of them the first ``negatives`` rows of
    another label with ``low * positive_score <= 100 * negative_score <= 100 *
    positive_score`` are returned, ranked from 1.

    Rows with a null label, id or vector or a null or non-finite component take
    no part.  A shorter vector counts as followed by zeros.  Rows that share the
    anchor's id are no partners of it; a repeated row is a partner as often as it
    occurs, a repeated anchor is one anchor.  ``is_anchor`` is a condition on
    ``id``.  Other columns are not read; an empty table gives no rows.
    """
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "vectors")
    whole_numbers(df, id_col, label_col, vec_col, scale).write.parquet(path)
    # as many tasks as the cluster runs at once report each anchor's best rows
    rows = spark.read.parquet(path)
    rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, 2))
    anchors = spark.read.parquet(path).where(is_anchor).distinct()
    size = anchors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    many, dims = size[0], max(size[1] or 0, 1)
    out = scratch_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    blocks = -(-many // block)
    path = scratch_path(spark, "anchors")
    anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(max(blocks, 1)))).write.partitionBy("block").parquet(path)
    found = "win bigint, score bigint, id bigint"
    ranked = Window.partitionBy("win").orderBy(F.desc("score"), "id")
    for b in range(blocks):
        got = spark.read.parquet(path).where(F.col("block") == b).orderBy("id", "label", "vec").toArrow()
        if not got.num_rows:
            continue
        one = tuple(got.column(c).to_pylist() for c in ("id", "label", "vec"))
        n = len(one[0])

        def all_scores(a: Anchors) -> Windows:
            every = np.arange(len(a.ids))
            return Windows(a, every, np.full(len(every), _LOW), np.full(len(every), np.inf), positives, same_label=True)

        top = _pass(rows, found, all_scores, one, dims).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives)
        pos = top.orderBy("win", "rank").toArrow()  # at most positives * block rows
        anchor, score, ident = (pos.column(c).to_numpy() for c in ("win", "score", "id"))
        at_least = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)  # least whole score in the window
        open_ = np.flatnonzero(at_least <= score)
        if not len(open_):
            continue
        anchor, score, ident, at_least = anchor[open_], score[open_], ident[open_], at_least[open_]

        def in_reach(a: Anchors, anchor=anchor, score=score, at_least=at_least) -> Windows:
            return Windows(a, anchor, at_least.astype(np.float64), score.astype(np.float64), negatives, same_label=False)

        near = _pass(rows, found, in_reach, one, dims).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        names = spark.createDataFrame(pa.table({"win": np.arange(len(anchor)), "anchor_id": np.array(one[0], np.int64)[anchor], "positive_id": ident, "positive_score": score}))
        near = near.join(names, "win").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        near.write.mode("append").parquet(out)
        assert n <= many
    return spark.read.schema(schema).parquet(out)
