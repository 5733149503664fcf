"""Exact top-k by inner product: a Voronoi join of a query table with a data table.

A bounded sample of the data (`SAMPLE` vectors, by hash) gives pivots. Data go to the cell of their
nearest pivot, queries to the cell of theirs; a cell of queries is summed up by its pivot c, its radius
(the greatest distance of a query from c) and its bound (the least, over its queries, of the k+1-st best
score with the sample: every query has k better candidates than that, its own row left out). A data
vector x can matter to a cell only if c.x + radius * |x| reaches the bound; it is sent to those cells
alone. Cells of data are cut into blocks of about `BLOCK` vectors, so no cell is gathered whole; each
block is solved against a query cell by one matrix product, and the best of all blocks are ranked.

Equal vectors are one class that carries its k+1 smallest ids: no more of them can be in a result, and a
vector that a third of the rows share costs one.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part; ties go to the
smaller id; a query's own id is no candidate of it; rows that agree in id and vector are one candidate
and one query; of vectors of different lengths the shorter counts as filled with zeros; scaled components
are held to +-2**31; fewer than k candidates give fewer rows; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm.store import Store

SAMPLE = 1024
BLOCK = 8192
QUERY_CELL = 1024
MOST_CELLS = 1024
SCALE = 64


def scaled(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component as floor(scale * x); vectors that take no part are left out."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-2.0**31)), F.lit(2.0**31))))
    return df.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(id_column).cast("long").alias("vec_id"), held.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """float64 rows filled with zeros up to `width`."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else []] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where no sum can reach 2**53."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    own = gap.argmin(axis=1)
    return own, np.sqrt(np.maximum(gap[np.arange(len(x)), own], 0))


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, store: Store | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (vec_id, v)."""
    store = store or Store(data.sparkSession)
    spark = store.spark
    data = store.put(data.select("vec_id", "v").distinct(), "data")
    queries = store.put(queries.select("vec_id", "v").distinct(), "queries")
    # Equal vectors: one class with its k+1 smallest ids.
    in_class = Window.partitionBy("v").orderBy("vec_id")
    first = data.withColumn("r", F.row_number().over(in_class)).filter(f"r <= {k + 1}")
    classes = store.put(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n_queries, query_width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(width, query_width)
    picked = classes.select("v", "ids").orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(SAMPLE).toArrow()
    if n == 0 or n_queries == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = _matrix(picked.column("v").combine_chunks(), width)
    cells = sample[: min(MOST_CELLS, -(-n // BLOCK))]
    query_cells = sample[: min(MOST_CELLS, -(-n_queries // QUERY_CELL))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), width)
            own, away = _nearest(q, query_cells)
            scores = q @ sample.T
            at = min(k, scores.shape[1] - 1)
            bound = -np.partition(-scores, at, axis=1)[:, at] if scores.shape[1] > k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array(away), pa.array(bound)],
                names=["query_id", "v", "cell", "away", "bound"])

    placed = store.put(queries.mapInArrow(
        place, "query_id long, v array<long>, cell int, away double, bound double"), "placed")
    summary = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.min("bound").alias("bound")).collect()
    cell_no = np.array([r.cell for r in summary])
    radius, bound = np.array([r.radius for r in summary]), np.array([r.bound for r in summary])
    centre = query_cells[cell_no]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            own, _ = _nearest(x, cells)
            reach = x @ centre.T + np.sqrt((x * x).sum(1))[:, None] * radius
            row, to = np.nonzero(reach + 1e-9 * np.abs(reach) + 1e-6 >= bound)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_no[to], pa.int32()), pa.array(own[row], pa.int32()), batch.column(0).take(pick),
                 batch.column(1).take(pick)], names=["cell", "data_cell", "v", "ids"])

    sent = store.put(classes.mapInArrow(send, "cell int, data_cell int, v array<long>, ids array<long>"), "sent")
    parts = sent.groupBy("cell", "data_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = sent.join(F.broadcast(parts), ["cell", "data_cell"]).withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    again = parts.select(*(F.col(c).alias(c) for c in parts.columns))
    asked = placed.join(again, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))

    def solve(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        if len(asked) and len(held):
            held = held.assign(low=[i[0] for i in held["ids"]]).sort_values("low", ignore_index=True)
            x, ids = _rows(held["v"], width), list(held["ids"])
            n, order = len(x), np.arange(len(x) - 1, -1, -1)
            best = min(k + 1, n)
            for a in range(0, len(asked), 128):
                part = asked.iloc[a : a + 128]
                scores = _product(_rows(part["v"], width), x)
                top = np.argpartition(scores * n + order, n - best, axis=1)[:, n - best:]
                for i, query in enumerate(part["query_id"]):
                    flat = np.concatenate([ids[c] for c in top[i]])
                    score = np.repeat(scores[i, top[i]], [len(ids[c]) for c in top[i]])
                    keep = flat != query
                    flat, score = flat[keep], score[keep]
                    by = np.lexsort((flat, -score))[:k]
                    found.append(np.stack([np.full(len(by), query), flat[by], score[by]], axis=1))
        rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        return pd.DataFrame(rows.astype(np.int64), columns=["query_id", "vec_id", "score"])

    key = ["cell", "data_cell", "part"]
    solved = asked.select("query_id", "v", *key).groupBy(*key).cogroup(blocks.select("v", "ids", *key).groupBy(*key)).applyInPandas(
        solve, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(by_score)).filter(f"rank <= {k}").select(
        "query_id", "rank", "vec_id", "score")


def _rows(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out
