"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors become whole numbers, floor(scale * x). Candidates are dealt into blocks
of bounded size by the pivot they score highest with, so that a block holds
vectors of one direction. A block sorts its candidates by every dimension. A
query walks down all lists at once, from the end that its sign favours, scores
every row that turns up, and stops as soon as the sum of what the lists have
reached, the best that an unseen row can score, is below its k-th score. A tie
with the bound goes on, as an unseen row with a smaller id could still win.

The same rule holds for whole blocks. A query first asks the block of its own
pivot, which gives it a k-th score. Of every other block the ends of its lists,
the largest and smallest value by dimension, bound what its rows can score; a
block below the k-th score is skipped before anything is copied. Queries go to
the blocks that are left, and the best k meet by query. Vectors without
directions of their own (noise) skip few blocks, and nothing exact can.

Rows with a null id, a null vector, or null or non-finite components take no
part. Vectors of other lengths than the query's are no candidates. Repeated
candidate rows are candidates each; of repeated query ids the smallest vector
asks. Columns beside id and vector, whatever their names, are not read. Very
long vectors make smaller blocks. An empty table gives an empty result. A score
beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables

CANDIDATES, QUERIES = 8192, 2048
BLOCK_BYTES = 32 << 20
#: Vectors that blocks are dealt by, at most, and bytes of block bounds that go to all tasks at once.
PIVOTS, BOX_BYTES = 256, 32 << 20
FOUND = "query_id long, vec_id long, score long"


def search_block(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the best k of one block; order and ranked hold the sorted list of each dimension."""
    n = len(ids)
    up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    seen = ids == query_id
    best_s, best_i = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    depth, step = 0, max(4, k)
    if not len(up) and not len(down):  # every row scores 0
        own = np.sort(ids[~seen])[:k]
        return [(0, int(i)) for i in own]
    while depth < n:
        end = min(n, depth + step)
        met = np.zeros(n, bool)
        met[order[depth:end, up]] = True
        met[order[n - end : n - depth, down]] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        best_s, best_i = np.concatenate([best_s, rows[new] @ query]), np.concatenate([best_i, ids[new]])
        top = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i = best_s[top], best_i[top]
        bound = ranked[end - 1, up] @ query[up] + ranked[n - end, down] @ query[down]
        if len(top) == k and best_s[-1] > bound:
            break
        depth, step = end, step * 2
    return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True)]


def _numbers(v, scale: int) -> np.ndarray:
    return np.floor(scale * np.stack(v.to_numpy()))


def _exact(c: np.ndarray, q: np.ndarray) -> bool:
    """Whether all scores are whole numbers of a double."""
    return not c.size or not q.size or np.abs(c).max() * np.abs(q).max() * c.shape[1] < 2.0**53


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray], scale: int) -> DataFrame:
    """rows (vec_id, v, dim) with the pivot of their length that they score highest with; 0 if there is none."""

    def deal(parts):
        for part in parts:
            best = np.zeros(len(part), np.int64)
            for dim, p in pivots.items():
                own = (part["dim"] == dim).to_numpy()
                if dim and own.any():
                    best[own] = np.argmax(_numbers(part["v"][own], scale) @ p.T, axis=1)
            yield part.assign(pivot=best)

    return rows.mapInPandas(deal, "vec_id long, v array<double>, dim int, pivot long")


def _search(rows: pd.DataFrame, asks: pd.DataFrame, k: int, scale: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the best k rows of one block for each of the queries."""
    if not len(rows) or not len(asks):
        return []
    if not len(rows.v.iloc[0]):
        own = np.sort(rows.vec_id.to_numpy())
        return [(q, int(i), 0) for q in asks.query_id for i in [x for x in own if x != q][:k]]
    ids, c, q = rows.vec_id.to_numpy(), _numbers(rows.v, scale), _numbers(asks.v, scale)
    if not _exact(c, q):
        c, q = (np.array([[int(y) for y in x] for x in z], object) for z in (c, q))
    order = np.argsort(c, axis=0, kind="stable")
    ranked = np.take_along_axis(c, order, 0)
    found = [(i, r, s) for i, x in zip(asks.query_id.to_numpy(), q, strict=True) for s, r in search_block(ids, c, i, x, order, ranked, k)]
    if any(abs(s) >= 2**63 for _, _, s in found):
        raise OverflowError("a score doesn't fit in 64 bits")
    return found


class Search:
    """One search: blocks, what each query finds at home, and the blocks it still has to ask."""

    def __init__(self, vectors: DataFrame, is_query, k: int, scale: int, id_col: str, vector_col: str, candidates: int, queries: int):
        spark = vectors.sparkSession
        self.store, self.k, self.scale = SharedTables(spark, "topk"), k, scale
        usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
            F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        ).select("*", F.size("v").alias("dim"))
        n, width = usable.agg(F.count("*"), F.max("dim")).first()
        # a block takes so many bytes at most, however long its vectors are
        room = max(1, BLOCK_BYTES // (8 * max(width or 1, 1)))
        self.queries = min(queries, room)
        blocks = self.blocks = max(1, -(-n // min(candidates, room)))
        size = -(-n // blocks) if n else 1
        drawn = [] if blocks == 1 else usable.orderBy(F.xxhash64("vec_id", "v")).limit(min(PIVOTS, blocks, room)).collect()  # at most PIVOTS vectors, of BLOCK_BYTES in all
        lengths: dict[int, list] = {}
        for r in drawn:
            lengths.setdefault(r.dim, []).append(r.v)
        pivots = {d: np.floor(scale * np.array(v)).reshape(len(v), d) for d, v in lengths.items()}
        dealt = self.store.write(_dealt(usable, pivots, scale), "dealt") if pivots else usable.withColumn("pivot", F.lit(0).cast("long"))
        # a row a length and pivot; a pivot with many rows has several blocks
        parts = {(r.dim, r.pivot): -(-r["count"] // size) for r in dealt.groupBy("dim", "pivot").count().collect()}
        split = F.try_element_at(F.create_map(*[x for (d, p), m in parts.items() for x in (F.lit(f"{d}:{p}"), F.lit(m))]), F.concat_ws(":", "dim", "pivot")) if parts else F.lit(1)
        block = F.concat_ws(":", "dim", "pivot", F.pmod(F.xxhash64("vec_id", "v"), split))
        self.rows = dealt.select("vec_id", "v", "dim", block.alias("block"))
        self.asked = self.rows.filter(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "dim", "block")).alias("x")).select("query_id", "x.*")

    def at_home(self) -> DataFrame:
        """What each query finds in its own block (query_id, vec_id, score), and lowest and highest values of each block (lo, hi)."""
        k, scale = self.k, self.scale

        def meet(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            found = [(key[0], q, i, s, None, None, None) for q, i, s in _search(rows, asks, k, scale)]
            if len(rows):
                c = _numbers(rows.v, scale)
                found.append((key[0], None, None, None, int(rows.dim.iloc[0]), c.min(axis=0), c.max(axis=0)))
            out = pd.DataFrame(found, columns=["block", "query_id", "vec_id", "score", "dim", "lo", "hi"])
            return out.astype({"query_id": "Int64", "vec_id": "Int64", "score": "Int64", "dim": "Int64"})

        # in parts of so many queries, where a block is home to more
        return self.store.write(self._together(self.asked.select("query_id", "v", "block"), meet, "block string, query_id long, vec_id long, score long, dim long, lo array<double>, hi array<double>"), "home")

    def _together(self, asks: DataFrame, meet, schema: str) -> DataFrame:
        """Blocks beside the queries that ask them; a block moves once for every ``queries`` of these."""
        counted = asks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(self.queries)).cast("int").alias("parts"))
        every = self.rows.select("block").distinct().join(counted, "block", "left").select("block", F.coalesce("parts", F.lit(1)).alias("parts"))
        own = every if schema != FOUND else counted
        left = self.rows.join(own, "block").select("vec_id", "v", "dim", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = asks.join(counted, "block").select("query_id", "v", "block", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, schema)

    def left_over(self, home: DataFrame) -> DataFrame:
        """query_id, v, block of blocks beyond the own one that may hold a better row, by the ends of their lists."""
        kth = home.filter("score IS NOT NULL").groupBy("query_id").agg(F.when(F.count("*") >= self.k, F.min("score")).alias("kth"))
        asks = self.asked.select("query_id", "v", "dim", F.col("block").alias("home")).join(kth, "query_id", "left")
        boxes = self.store.write(home.filter("lo IS NOT NULL").select("block", "dim", "lo", "hi").distinct(), "boxes")
        n, width = boxes.agg(F.count("*"), F.max("dim")).first()
        per, scale, out = max(1, BOX_BYTES // (16 * max(width or 1, 1))), self.scale, None
        rounds = max(1, -(-n // per))
        for i in range(rounds):
            some = boxes.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == i).collect()  # about BOX_BYTES, whatever the number of blocks
            by_dim: dict[int, tuple] = {}
            for r in some:
                own = by_dim.setdefault(r.dim, ([], [], []))
                own[0].append(r.block), own[1].append(r.lo), own[2].append(r.hi)
            by_dim = {d: (b, np.array(lo).reshape(len(b), d), np.array(hi).reshape(len(b), d)) for d, (b, lo, hi) in by_dim.items()}
            shared = self.rows.sparkSession.sparkContext.broadcast(by_dim)

            def bounded(parts, shared=shared):
                for part in parts:
                    found = []
                    for dim, (names, lo, hi) in shared.value.items():
                        own = part[part["dim"] == dim]
                        if not len(own):
                            continue
                        q = _numbers(own["v"], scale) if dim else np.zeros((len(own), 0))
                        up, down = np.maximum(q, 0), np.minimum(q, 0)
                        best = up @ hi.T + down @ lo.T
                        sure = _exact(np.maximum(np.abs(lo), np.abs(hi)), q)
                        for j, (query_id, v, home_, kth_) in enumerate(zip(own["query_id"], own["v"], own["home"], own["kth"], strict=True)):
                            for b in range(len(names)) if not sure or pd.isna(kth_) else np.flatnonzero(best[j] >= kth_):
                                if names[b] != home_:
                                    found.append((query_id, v, names[b]))
                    yield pd.DataFrame(found, columns=["query_id", "v", "block"])

            pairs = asks.mapInPandas(bounded, "query_id long, v array<double>, block string")
            out = pairs if out is None else out.unionByName(pairs)
        return self.store.write(out, "pairs")

    def found(self) -> DataFrame:
        """query_id, vec_id, score: at least the k best rows of every query."""
        home = self.at_home()
        k, scale, own = self.k, self.scale, home.filter("score IS NOT NULL").select("query_id", "vec_id", "score")
        if self.blocks == 1:  # every length has one block
            return own

        def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_search(rows, asks, k, scale), columns=["query_id", "vec_id", "score"]).astype("int64")

        beyond = self._together(self.left_over(home), meet, FOUND)
        return own.unionByName(beyond)


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row for which is_query holds, its own id left out."""
    found = Search(vectors, is_query, k, scale, id_col, vector_col, candidates, queries).found()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
