"""Exact nearest neighbours by cosine: one pass of the table for a small stated query set, one join of blocks for everything else."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import cut

#: Query vectors that may be broadcast; more queries are joined with the table block by block.
BLOCK = 4096
#: Similarities that a task holds at a time.
CELLS = 4_000_000
#: Rows and bytes of a block of the join, centers of one dimension, and rows of the sample from which centers are fit.
ROWS, BYTES, CENTERS, SAMPLE = 1024, 2 << 20, 64, 2048
#: Distances within this are taken for equal, and similarities are ranked in so many digits: products of other shapes round otherwise.
NEAR, DIGITS = 1e-6, 12


def vector_topk(queries: DataFrame, table: DataFrame, k: int, id: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, id, sim, rank: for each query (id, vector) its k nearest rows of the table, sim = cosine clamped to 0..1.

    Queries find the rows of their own dimension; vectors that are null or of length zero neither find nor are found. Up to ``block`` queries are
    broadcast and the table stays where it is: each of its batches is multiplied with them, and only a task's k best of each query leave it. More are
    joined as blocks, see neighbour_join."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("q"), F.col(vector).alias("v"))
    some = q.limit(block + 1).collect()
    if len(some) > block:
        return neighbour_join(queries, table, k, id, vector)
    spark = table.sparkSession
    by_size: dict[int, list] = {}
    for r in some:
        if any(r.v):
            by_size.setdefault(len(r.v), []).append(r)
    made = {}
    for n, rs in by_size.items():
        m = np.array([r.v for r in rs], np.float64)
        made[n] = np.array([r.q for r in rs], np.int64), m / np.linalg.norm(m, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(made)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {n: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for n in shared.value}  # query's place, id, sim
        for b in batches:
            for n, (names, units) in shared.value.items():
                ids, flat = _units(b.column(0), b.column(1), n)
                step = max(1, CELLS // len(names))
                for at in range(0, len(ids), step):
                    new = _best(units, flat[at : at + step], ids[at : at + step], k)
                    top[n] = _first([np.concatenate(x) for x in zip(top[n], new)], k)
        for n, (place, id_, sim) in top.items():
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][place]), pa.array(id_), pa.array(sim)], ["query_id", "id", "sim"])

    rows = table.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return _ranked(rows.mapInArrow(best, "query_id long, id long, sim double"), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id"))
    out = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sim"))).alias("sim"), "rank")


def _units(ids: pa.Array, vectors: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows of dimension n."""
    good = vectors.value_lengths().to_numpy(zero_copy_only=False) == n
    flat = np.asarray(vectors.filter(pa.array(good)).flatten()).reshape(-1, n)
    norms = np.linalg.norm(flat, axis=1)
    full = np.isfinite(norms) & (norms > 0)
    return ids.to_numpy(zero_copy_only=False)[good][full], flat[full] / norms[full, None]


def _best(units: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, sim) of the rows among each query's k best, and all that tie with the last."""
    sims = units @ rows.T
    least = np.partition(sims, -min(k, sims.shape[1]), axis=1)[:, -min(k, sims.shape[1])]
    place, here = np.nonzero(sims >= least[:, None] - 10.0**-DIGITS)
    return _first((place, ids[here], np.round(sims[place, here], DIGITS)), k)


def _first(rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, id_, sim = rows
    order = np.lexsort((id_, -sim, place))
    place = place[order]
    order = order[np.arange(len(place)) - np.searchsorted(place, place) < k]
    return tuple(x[order] for x in rows)


# ---- the join of blocks ----


def _centers(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit vectors around which the rows are gathered, by dimension: spherical k-means on a sample of at most SAMPLE rows. Dimensions without one get the first axis."""
    most = min(CENTERS, -(-count // ROWS))
    if most < 2:
        return {}
    by_size: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect():
        if any(r.v):
            by_size.setdefault(len(r.v), []).append(r.v)
    out = {}
    for n, vs in by_size.items():
        x = np.array(vs, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x[:most]
        for _ in range(5):
            nearest = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, nearest, x)
            norms = np.linalg.norm(sums, axis=1)
            c = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], c)
        out[n] = c
    return out


def _axis(n: int) -> np.ndarray:
    return np.eye(1, n)


def _apart(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * sims))


def _cells(batches: Iterator[pa.RecordBatch], centers: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(dim, cell, id, v): unit vectors as bytes, with the number of their nearest center."""
    for b in batches:
        for n in set(b.column(1).value_lengths().to_pylist()) - {0, None}:
            ids, flat = _units(b.column(0), b.column(1), n)
            cell = (flat @ centers.get(n, _axis(n)).T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n)), pa.array(cell), pa.array(ids), pa.array([x.tobytes() for x in flat], pa.binary())], ["dim", "cell", "id", "v"])


def _block(table: pa.Table, centers: dict[int, np.ndarray], queries: bool) -> pa.Table:
    """A group of rows as one row: its ids and vectors, and its least and greatest distance to its own center, or for queries to all centers of the dimension."""
    n, cell = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
    ids = table.column("id").to_numpy()
    x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(-1, n)
    c = centers.get(n, _axis(n))
    far = _apart(x @ (c if queries else c[cell : cell + 1]).T)
    name = f"{n}:{cell}:{table.column('part')[0].as_py()}"
    return pa.table({"block": [name], "dim": [n], "cell": [cell], "n": [len(ids)], "near": [far.min(axis=0).tolist()], "far": [far.max(axis=0).tolist()], "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([x.tobytes()], pa.binary())})


def _blocks(rows: DataFrame, centers: dict[int, np.ndarray], queries: bool) -> DataFrame:
    """Rows (id, v) as blocks of about ROWS rows or BYTES bytes of one cell. Rows are dealt by their number, so repeated rows fill no block. Queries that are fewer
    are gathered around fewer of the centers, since each of their blocks has the table's blocks sent to it."""
    own = centers
    if queries and centers:
        most = max(1, -(-rows.count() // ROWS))
        own = {n: c[:most] for n, c in centers.items()}
    cells = cut(rows.mapInArrow(partial(_cells, centers=own), "dim long, cell long, id long, v binary").withColumn("row", F.monotonically_increasing_id()))
    size = F.least(F.lit(ROWS), F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.col("dim")))))
    counts = cells.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # at most CENTERS rows for each dimension
    dealt = cells.join(F.broadcast(counts), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("row"), "parts").alias("part"), "id", "v")
    schema = "block string, dim long, cell long, n long, near array<double>, far array<double>, ids binary, v binary"
    return cut(dealt.groupBy("dim", "cell", "part").applyInArrow(lambda t: _block(t, centers, queries), schema))


def block_pairs(q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    """(q, t, least, first): pairs of a block of queries and a block of rows that may hold one of their k nearest. least: no distance between the two is less, by
    the triangle inequality over the row block's center. first: whether the pair is among those that come first and hold k rows for every query."""
    cells = t.groupBy("dim", "cell").agg(F.sum("n").alias("rows"), F.min(F.col("near")[0]).alias("inner"), F.max(F.col("far")[0]).alias("outer"))
    by_dim = cells.groupBy("dim").agg(F.collect_list(F.struct("cell", "rows", "inner", "outer")).alias("cells"))  # at most CENTERS entries
    at = lambda name, c: F.get(F.col(name), c.cast("int"))
    heads = q.select(F.col("block").alias("q"), "dim", "near", "far").join(F.broadcast(by_dim), "dim")
    reach = F.array_sort(F.transform("cells", lambda c: F.struct((at("far", c["cell"]) + c["outer"]).alias("reach"), c["rows"].alias("rows"))))
    # the distance within which the nearest cells hold k rows for every query of the block
    zero = F.struct(F.lit(0).cast("long").alias("have"), F.lit(4.0).alias("within"))
    grown = F.aggregate(reach, zero, lambda s, c: F.struct((s["have"] + c["rows"]).alias("have"), F.when(s["have"] < k, F.when(s["have"] + c["rows"] >= k, c["reach"]).otherwise(F.lit(4.0))).otherwise(s["within"]).alias("within")))
    heads = heads.withColumn("within", grown["within"]).select("q", "dim", "near", "far", "within", F.explode("cells").alias("c"))
    near, far = at("near", F.col("c.cell")), at("far", F.col("c.cell"))
    gap = lambda inner, outer: F.greatest(F.lit(0.0), near - outer, inner - far)
    heads = heads.where(gap(F.col("c.inner"), F.col("c.outer")) <= F.col("within") + NEAR)
    pairs = heads.select("q", "dim", F.col("c.cell").alias("cell"), near.alias("lo"), far.alias("hi"), "within").join(
        t.select("dim", "cell", F.col("block").alias("t"), F.col("n").alias("rows"), F.col("near")[0].alias("inner"), F.col("far")[0].alias("outer")), ["dim", "cell"]
    )
    least = F.greatest(F.lit(0.0), F.col("lo") - F.col("outer"), F.col("inner") - F.col("hi"))
    pairs = pairs.withColumn("least", least).where(F.col("least") <= F.col("within") + NEAR)
    before = F.sum("rows").over(Window.partitionBy("q").orderBy(F.col("hi") + F.col("outer"), "t").rowsBetween(Window.unboundedPreceding, -1))
    return pairs.select("q", "t", "least", (F.coalesce(before, F.lit(0)) < k).alias("first"))


def _hits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query over the consecutive rows that have the same block of queries and slab."""

    def found(at: tuple, names: np.ndarray, top: tuple) -> pa.RecordBatch:
        place, id_, sim = top
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(place), pa.string()), pa.array(place), pa.array(names[place]), pa.array(id_), pa.array(sim)], ["q", "place", "query_id", "id", "sim"])

    at, names, top = None, None, None
    for b in batches:
        for q, slab, n, q_ids, q_v, t_ids, t_v in zip(*[c.to_pylist() for c in b.columns]):
            if at != (q, slab):
                if at:
                    yield found(at, names, top)
                at, names, top = (q, slab), np.frombuffer(q_ids, np.int64), None
                units = np.frombuffer(q_v, np.float64).reshape(-1, n)
            new = _best(units, np.frombuffer(t_v, np.float64).reshape(-1, n), np.frombuffer(t_ids, np.int64), k)
            top = new if top is None else _first([np.concatenate(x) for x in zip(top, new)], k)
    if at:
        yield found(at, names, top)


def neighbour_join(queries: DataFrame, table: DataFrame, k: int, id: str = "id", vector: str = "embedding", count: dict | None = None) -> DataFrame:
    """The rows of vector_topk for any number of queries, by one join of blocks.

    Queries and table are gathered around a few centers and cut into blocks. Pairs of blocks are compared in two waves: first those that hold k rows for
    every query of a block, which bounds the distance of its k-th neighbour, then the pairs whose least distance is within this bound; all others are skipped,
    so the result is exact. The pairs are joined with the blocks' bytes and dealt by block of queries; a task yields at most k rows a query, and one window
    picks the k best of all. No vector passes the driver but a sample of SAMPLE rows. ``count`` receives the numbers of pairs: all, first, then."""
    spark = table.sparkSession
    narrow = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = narrow(table)
    centers = _centers(rows, rows.count())
    t, q = _blocks(rows, centers, False), _blocks(narrow(queries), centers, True)
    pairs = cut(block_pairs(q, t, k))

    # blocks of queries are dealt to several tasks each as long as they are fewer than the cluster's cores
    slabs = max(1, -(-spark.sparkContext.defaultParallelism // max(1, q.count())))
    q_rows = q.select(F.col("block").alias("q"), "dim", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    t_rows = t.select(F.col("block").alias("t"), F.col("ids").alias("t_ids"), F.col("v").alias("t_v"))

    def compared(some: DataFrame) -> DataFrame:
        """The pairs with their bytes, by block of queries: a merge join leaves those of one block behind each other, so a task keeps k rows a query."""
        with_t = some.select("q", F.pmod(F.xxhash64("t"), F.lit(slabs)).cast("int").alias("slab"), "t").join(t_rows, "t")
        both = with_t.join(q_rows.hint("merge"), ["q", "slab"])
        return both.select("q", "slab", "dim", "q_ids", "q_v", "t_ids", "t_v").mapInArrow(partial(_hits, k=k), "q string, place long, query_id long, id long, sim double")

    hits = cut(compared(pairs.where("first")))
    kth = hits.withColumn("n", F.row_number().over(Window.partitionBy("q", "place").orderBy(F.desc("sim")))).where(F.col("n") == k)
    sizes = q.select(F.col("block").alias("q"), F.col("n").alias("of"))
    # a block in which some query has fewer than k rows so far has no bound
    bound = kth.groupBy("q").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n")).join(sizes, "q").where("n = of")
    bound = bound.select("q", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("sim"))).alias("within"))
    rest = cut(pairs.where("not first").join(bound, "q", "left").where(F.col("within").isNull() | (F.col("least") <= F.col("within") + NEAR)).select("q", "t"))
    if count is not None:
        count |= {"all": q.count() * t.count(), "first": pairs.where("first").count(), "then": rest.count()}
    out = hits.unionByName(compared(rest)) if rest.limit(1).count() else hits
    return _ranked(out.select("query_id", "id", "sim"), k)


def reached(rows: DataFrame, points: DataFrame, id: str = "id", vector: str = "embedding") -> DataFrame:
    """id of the rows (id, vector, least) to which one of the given points, a set small enough to be broadcast, has a cosine of ``least`` or more."""
    spark = rows.sparkSession
    by_size: dict[int, list] = {}
    for r in points.where(F.col(vector).isNotNull()).select(vector).collect():
        if any(r[0]):
            by_size.setdefault(len(r[0]), []).append(r[0])
    shared = spark.sparkContext.broadcast({n: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64), axis=1, keepdims=True) for n, v in by_size.items()})

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = b.column(2).to_numpy(zero_copy_only=False)
            place = pa.array(np.arange(b.num_rows))
            for n, units in shared.value.items():
                at, flat = _units(place, b.column(1), n)
                step = max(1, CELLS // len(units))
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    hit = some[np.clip((flat[lo : lo + step] @ units.T).max(axis=1), 0, 1) >= least[some] - NEAR]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit))], ["id"])

    return rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col("least").cast("double").alias("least")).mapInArrow(over, "id long")
