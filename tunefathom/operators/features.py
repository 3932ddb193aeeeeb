"""Feature matrix, standardisation, exact nearest neighbours and the 2-D map."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.plans.shapes import one_row, top_n
from tunefathom.session import settled

# Vectors that make a cell worth while; upper bounds of what is sent to every task: pivots, and rows per compared block.
CELL_ROWS = 1024
PIVOT_BYTES = 64_000_000
BLOCK_ROWS = 4096
BLOCK_BYTES = 32_000_000
# Groups of blocks that a vector's visits go to: so many, and more only where a group would exceed these bytes.
VISIT_GROUPS = 8
GROUP_BYTES = 64_000_000
# What a short vector takes in a group besides its numbers, where the library is much larger than what is looked up in it.
ROW_BYTES = 240


def feature_statistics(songs: DataFrame, keys: list[str], zero_is_missing: bool = True) -> DataFrame:
    """One row with every feature's mean and population deviation after imputation: the model to store.

    Filling gaps with the mean leaves the mean alone and scales the variance by the share of values present.
    """
    def known(k: str) -> Column:
        v = F.col(k).cast("double")
        return F.nullif(v, F.lit(0.0)) if zero_is_missing else v
    return songs.agg(F.count("*").alias("songs"), *[F.struct(
        F.coalesce(F.avg(known(k)), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(known(k)) * F.sqrt(F.count(known(k)) / F.count("*")), F.lit(0.0)).alias("std"),
    ).alias(k) for k in keys])


def feature_matrix(songs: DataFrame, keys: list[str], statistics: DataFrame | None = None, zero_is_missing: bool = True, song: str = "song_id") -> DataFrame:
    """Features with gaps filled by the library mean (0 where a feature has no value at all)."""
    stats = one_row(feature_statistics(songs, keys, zero_is_missing) if statistics is None else statistics)

    def filled(k: str) -> Column:
        v = F.col(k).cast("double")
        return F.coalesce(F.nullif(v, F.lit(0.0)) if zero_is_missing else v, F.col(f"_s.{k}.mean")).alias(k)
    return songs.withColumn("_s", stats).select(song, *[filled(k) for k in keys])


def standardise(songs: DataFrame, keys: list[str], statistics: DataFrame | None = None, zero_is_missing: bool = True, song: str = "song_id") -> DataFrame:
    """``(song_id, features array<double>)``: z-scores with population deviation, constant features 0."""
    stats = feature_statistics(songs, keys, zero_is_missing) if statistics is None else statistics
    matrix = feature_matrix(songs, keys, stats, zero_is_missing, song).withColumn("_s", one_row(stats))

    def z(k: str) -> Column:
        # a deviation this far below the mean is rounding noise of a constant column
        std, mean = F.col(f"_s.{k}.std"), F.col(f"_s.{k}.mean")
        return F.when(std > F.abs(mean) * 1e-12, (F.col(k) - mean) / std).otherwise(F.lit(0.0))
    return matrix.select(song, F.array(*[z(k) for k in keys]).alias("features"))


def zscore_fixed(vectors: DataFrame, means: list[float], deviations: list[float], vector: str = "features", name: str = "scores") -> DataFrame:
    """Vectors against stored training means and deviations (zero deviation gives 0)."""
    pairs = F.zip_with(F.col(vector), F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(means, deviations)]),
                       lambda v, p: F.when(p["s"] == 0, F.lit(0.0)).otherwise((v - p["m"]) / p["s"]))
    return vectors.withColumn(name, pairs)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances: the fast product form proposes, exact differences decide (see _closest)."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _closest(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, data row and distance of the ``k`` closest, ties at the border by id.

    ``reach`` leaves out what is farther from its query; a product then settles nearly all pairs.
    """
    squares, wanted = (data * data).sum(1), min(k, len(data))
    scale = float(max((queries * queries).sum(1).max(), squares.max(), 1.0))
    slack = scale * (1e-12 + 1e-15 * data.shape[1])
    # half the squared distance less half the query's square, by one product
    columns = np.vstack([-data.T, squares / 2])
    rows, cols, dists = [], [], []
    for start in range(0, len(queries), 512):
        block = queries[start:start + 512]
        near = np.column_stack([block, np.ones(len(block))]) @ columns
        loose = np.arange(len(block))
        cut = np.full(len(block), np.inf)
        if reach is not None:
            cut = (reach[start:start + 512] ** 2 + slack - (block * block).sum(1)) / 2
            loose = np.flatnonzero((near <= cut[:, None]).sum(1) > 4 * wanted)
        if len(loose):
            cut[loose] = np.minimum(cut[loose], np.partition(near[loose], wanted - 1, axis=1)[:, wanted - 1] + slack)
        qi, di = np.nonzero(near <= cut[:, None])
        exact = np.sqrt(((block[qi] - data[di]) ** 2).sum(1))
        if reach is not None:
            within = exact <= reach[start + qi]
            qi, di, exact = qi[within], di[within], exact[within]
        order = np.lexsort((ids[di], exact, qi))
        qi, di, exact = qi[order], di[order], exact[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = rank < k
        rows.append(qi[keep] + start), cols.append(di[keep]), dists.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


@dataclass(frozen=True)
class CellIndex:
    """Pivots of the cells, and which of a smaller set of top pivots each cell lies under."""
    pivots: np.ndarray
    tops: np.ndarray
    top_of: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, even: bool = False) -> CellIndex:
        """Top pivots: the first ones, or from all along (``even``), where later pivots lie elsewhere than the first."""
        wanted = max(1, int(np.ceil(np.sqrt(len(pivots)))))
        tops = pivots[np.linspace(0, len(pivots) - 1, wanted).astype(int)] if even else pivots[:wanted]
        return cls(pivots, tops, np.concatenate([_distances(pivots[i:i + 4096], tops).argmin(1) for i in range(0, len(pivots), 4096)]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A close pivot of each point and its distance: the closest one under the point's two closest tops."""
        close = np.argsort(_distances(points, self.tops), axis=1)[:, :2]
        cell, best = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
        for top in np.unique(close):
            at, under = np.flatnonzero((close == top).any(axis=1)), np.flatnonzero(self.top_of == top)
            if len(under):
                d = _distances(points[at], self.pivots[under])
                low = d.argmin(1)
                value = d[np.arange(len(at)), low]
                better = value < best[at]
                cell[at[better]], best[at[better]] = under[low[better]], value[better]
        return cell, best

    def reachable(self, points: np.ndarray, reach: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) wherever the cell's ball comes within the point's reach; tops rule out all their cells at once."""
        slack = 1e-6 * (1.0 + float(np.abs(self.pivots).max()))
        rows, cells = [], []
        for top in range(len(self.tops)):
            under = np.flatnonzero((self.top_of == top) & (radius >= 0))
            if not len(under):
                continue
            outer = (_distances(self.tops[top:top + 1], self.pivots[under])[0] + radius[under]).max()
            at = np.flatnonzero(_distances(points, self.tops[top:top + 1])[:, 0] - outer <= reach + slack)
            for i in range(0, len(at), 1024):
                part = at[i:i + 1024]
                q, c = np.nonzero(_distances(points[part], self.pivots[under]) - radius[under] <= reach[part][:, None] + slack)
                rows.append(part[q]), cells.append(under[c])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def pivots_of(distinct: DataFrame, cell_rows: int) -> np.ndarray:
    """Vectors of lowest hash of the id (_rep, _vec): one per ``cell_rows`` vectors, no more than the square root of their number and ``PIVOT_BYTES``."""
    seen = distinct.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("width")).first()
    width = max(seen["width"] or 1, 1)
    wanted = max(1, min(int(np.sqrt(seen["n"])), seen["n"] // cell_rows, PIVOT_BYTES // (8 * width)))
    rows = distinct.orderBy(F.xxhash64("_rep"), "_rep").limit(wanted).select("_vec").collect()
    return np.array([r["_vec"] for r in rows], dtype=float).reshape(-1, width) if rows else np.zeros((1, width))


def _placed(rows: DataFrame, index: CellIndex) -> DataFrame:
    """Vectors (_rep, _vec) with their cell and how far its pivot is (_cell, _far)."""
    types = dict(rows.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, distance = index.nearest(_stacked(batch["_vec"]))
                yield batch.assign(_cell=cell.astype("int32"), _far=distance)

    return rows.select("_rep", "_vec").mapInPandas(assign, f"_rep {types['_rep']}, _vec {types['_vec']}, _cell int, _far double")


def _blocked(rows: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Vectors of cells with their block in the cell and its visit group (_block, _group)."""
    held_by = F.broadcast(rows.sparkSession.createDataFrame(pd.DataFrame({"_cell": range(len(groups)), "_groups": groups}), "_cell int, _groups array<int>"))
    block = F.pmod(F.xxhash64("_rep"), F.size("_groups")).cast("int")
    return rows.join(held_by, "_cell").select("_rep", "_vec", "_cell", block.alias("_block"), F.get("_groups", block).alias("_group"))


def _with_visits(looked: DataFrame, index: CellIndex, radius: np.ndarray, blocks: np.ndarray, groups: list[list[int]], k: int, sizes: np.ndarray | None = None) -> DataFrame:
    """Own blocks' answers with ``visits``, the cells that may hold closer vectors, and ``groups``, where these lie."""
    low, high = np.array([g[0] for g in groups]), np.array([g[-1] for g in groups])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            points = _stacked(batch["_vec"])
            row, cell = index.reachable(points, _reach(points, batch["far"], k, index, radius, sizes), radius)
            own = batch["_cell"].to_numpy()
            keep = (cell != own[row]) | (blocks[cell] > 1)
            row, cell = row[keep], cell[keep]
            order = np.argsort(row, kind="stable")
            row, cell = row[order], cell[order].astype("int32")
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            where = [np.unique(np.concatenate([low[c], high[c], *[np.arange(low[x] + 1, high[x]) for x in c[high[c] - low[c] > 1]]])).astype("int32")
                     for c in (cell[a:b] for a, b in zip(cut, cut[1:]))]
            yield batch.assign(visits=[cell[a:b] for a, b in zip(cut, cut[1:])], groups=where)

    # the list of cells is made where it is read: written, it would grow faster than the vectors
    return looked.mapInPandas(visit, ", ".join(f"{c} {kind}" for c, kind in looked.dtypes) + ", visits array<int>, groups array<int>")


def _reach(points: np.ndarray, far: pd.Series, k: int, index: CellIndex, radius: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The distance within which a point has k+1 vectors, as far as its own block says.

    Where that has fewer, a ball around any cell of more than ``k`` vectors tells (``sizes``, if known).
    """
    reach = np.array([f[k] if len(f) > k else np.inf for f in far])
    open_, full = np.flatnonzero(np.isinf(reach)), np.flatnonzero(sizes > k) if sizes is not None else []
    if len(full):
        for i in range(0, len(open_), 256):
            part = open_[i:i + 256]
            reach[part] = (_distances(points[part], index.pivots[full]) + radius[full]).min(axis=1)
    return reach


def _visit_groups(index: CellIndex, sizes: np.ndarray, blocks: np.ndarray, row_bytes: int = 0) -> list[list[int]]:
    """The group of every block of every cell: blocks of cells under the same top lie side by side, a cell's own follow each other."""
    width = index.pivots.shape[1]
    room = max(BLOCK_ROWS, min(GROUP_BYTES // (8 * width + row_bytes), -(-int(sizes.sum()) // VISIT_GROUPS)))
    groups, before = [[] for _ in sizes], 0
    for cell in np.argsort(index.top_of, kind="stable"):
        for _ in range(blocks[cell]):
            groups[cell].append(int(before // room))
            before += sizes[cell] / blocks[cell]
    return groups


def own_cells(distinct: DataFrame, k: int, cell_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors in cells, and what each one's own block says.

    Cells: _rep, _vec, _cell, _block and the block's visit group _group. Own blocks: the first four with ``near``, the k+1
    closest of the block (the vector itself among them), their distances ``far``, ``visits``, the cells that may hold
    closer ones (others, and its own where that has more blocks), and ``groups``, where these lie.
    """
    id_type, vec_type = dict(distinct.dtypes)["_rep"], dict(distinct.dtypes)["_vec"]
    index = CellIndex.of(pivots_of(distinct, cell_rows or CELL_ROWS))
    held = settled(_placed(distinct, index), "knn-cells")
    radius, sizes = np.full(len(index.pivots), -1.0), np.zeros(len(index.pivots), dtype=np.int64)
    for row in held.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("radius")).collect():  # a row per cell, as pivots are
        radius[row["_cell"]], sizes[row["_cell"]] = row["radius"], row["n"]
    blocks = np.maximum(-(-sizes // BLOCK_ROWS), 1)
    groups = _visit_groups(index, sizes, blocks)
    cells = _blocked(held, groups)

    def look(group: pd.DataFrame) -> pd.DataFrame:
        points, ids = _stacked(group["_vec"]), group["_rep"].to_numpy()
        q, d, distance = _closest(points, points, ids, k + 1)
        first = np.searchsorted(q, np.arange(len(points) + 1))
        return group.assign(near=[ids[d[a:b]] for a, b in zip(first, first[1:])], far=[distance[a:b] for a, b in zip(first, first[1:])])

    seen = f"_rep {id_type}, _vec {vec_type}, _cell int, _block int, near array<{id_type}>, far array<double>"
    looked = settled(cells.drop("_group").groupBy("_cell", "_block").applyInPandas(look, seen), "knn-own")
    return cells, _with_visits(looked, index, radius, blocks, groups, k)


def _visited(cells: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """What a vector finds in the blocks it visits, besides its own, within the reach of what it has found so far.

    A vector goes to a group of blocks once, however many of them it visits there, and a group to as many chunks of
    visitors, each half as large as a group.
    """
    id_type = dict(own.dtypes)["_rep"]
    asked = settled(own.select("_rep", "_vec", "_cell", "_block", "far", "groups"), "knn-asked")
    members = cells.groupBy("_group").agg(F.count("*").alias("_n"))
    room = members.agg(F.max("_n")).first()[0]
    callers = asked.select(F.explode("groups").alias("_group")).groupBy("_group").agg(F.ceil(2 * F.count("*") / room).cast("int").alias("_chunks"))
    shape = F.broadcast(settled(callers, "knn-shape"))
    chunk = F.pmod(F.xxhash64("_rep"), F.col("_chunks")).cast("int")
    visits = asked.withColumn("_group", F.explode("groups")).drop("groups").join(shape, "_group").withColumn("_chunk", chunk).drop("_chunks")
    data = cells.join(shape, "_group").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        rows, others, distances = [], [], []
        if len(queries) and len(members):
            points, everything, ids = _stacked(queries["_vec"]), _stacked(members["_vec"]), members["_rep"].to_numpy()
            best = np.full((len(points), k + 1), np.inf)  # distances of the closest so far
            for i, far in enumerate(queries["far"]):
                best[i, :len(far)] = far
            home, place = queries["_cell"].to_numpy(), queries["_block"].to_numpy()
            for (cell, block), at in members.groupby(["_cell", "_block"]).indices.items():
                data, centre = everything[at], everything[at].mean(axis=0, keepdims=True)
                spread = _distances(data, centre).max() + 1e-6 * (1.0 + float(np.abs(data).max()))
                away = (home != cell) | (place != block)
                near = np.flatnonzero(away & (_distances(points, centre)[:, 0] - spread <= best[:, k] * (1 + 1e-9)))
                if not len(near):
                    continue
                q, d, distance = _closest(points[near], data, ids[at], k + 1, best[near, k])
                found = np.full((len(near), k + 1), np.inf)
                found[q, np.arange(len(q)) - np.searchsorted(q, q)] = distance
                hit = np.unique(q)
                best[near[hit]] = np.sort(np.concatenate([best[near[hit]], found[hit]], axis=1), axis=1)[:, :k + 1]
                rows.append(near[q]), others.append(at[d]), distances.append(distance)
        if not rows:
            return pd.DataFrame({"_rep": [], "_other": [], "distance": []})
        row, other, distance = np.concatenate(rows), np.concatenate(others), np.concatenate(distances)
        keep = distance <= best[row, k]
        return pd.DataFrame({"_rep": queries["_rep"].to_numpy()[row[keep]], "_other": ids[other[keep]], "distance": distance[keep]})

    keys = ["_group", "_chunk"]
    return visits.groupBy(*keys).cogroup(data.toDF(*data.columns).groupBy(*keys)).applyInPandas(compare, f"_rep {id_type}, _other {id_type}, distance double")


def knn(vectors: DataFrame, k: int = fv.NEIGHBOURS, song: str = "song_id", vector: str = "features", cell_rows: int | None = None) -> DataFrame:
    """Exact ``k`` nearest other songs of every song: ``(song_id, rank, neighbor_id, distance)``.

    Euclidean, closest first, ties by id; min(k, n-1) rows per song, none for a single song.

    1. Songs with the same vector collapse to one, so a third of the library being copies costs nothing.
    2. Distinct vectors belong to cells around pivots, and pivots to top pivots. There are at most as many cells as the
       square root of the vectors, of ``cell_rows`` vectors or more, and no more than ``PIVOT_BYTES`` of pivots.
    3. A vector is compared with its own block first. That bounds its k-th distance, and only cells whose ball comes
       within that reach are visited; top pivots rule out all their cells at once.
    4. Blocks lie in groups: ``VISIT_GROUPS``, or more where one would exceed ``GROUP_BYTES``. A vector is sent to a group
       once and a group to its chunks of visitors, so what is shuffled grows with the vectors and not with their cells.
       Within a group every block narrows the reach for the next ones; a final top-k merges and expands copies.
    """
    kind = dict(vectors.dtypes)[vector]
    # single precision is carried as it is: comparing starts from the same doubles
    given = F.col(vector) if kind == "array<float>" else F.transform(vector, lambda v: v.cast("double"))
    rows = vectors.select(F.col(song).alias("_id"), given.alias("_vec"))
    id_type = dict(rows.dtypes)["_id"]
    # the first k+1 copies are enough to answer for all of them
    first = top_n(rows, ["_vec"], ["_id"], k + 1, "_copy")
    copies = settled(first.groupBy("_vec").agg(F.min("_id").alias("_rep"), F.collect_list("_id").alias("_ids")), "knn-copies")
    if copies.isEmpty():
        return vectors.sparkSession.createDataFrame([], f"{song} {id_type}, rank int, neighbor_id {id_type}, distance double")
    cells, own = own_cells(copies, k, cell_rows)
    pairs = own.select("_rep", F.explode(F.arrays_zip("near", "far")).alias("_n")).select("_rep", F.col("_n.near").alias("_other"), F.col("_n.far").alias("distance"))
    if not own.filter(F.size("visits") > 0).isEmpty():
        pairs = pairs.unionByName(_visited(cells, own, k))
    pairs = top_n(pairs, ["_rep"], ["distance", "_other"], k + 1, "_r").select("_rep", "_other", "distance")

    # answers per distinct vector: the copies of every close vector, k+1 of them (one may be the song itself)
    names = copies.select(F.col("_rep").alias("_other"), F.explode("_ids").alias("neighbor_id"))
    answers = top_n(pairs.join(names, "_other"), ["_rep"], ["distance", "neighbor_id"], k + 1, "_r")
    return _of_songs(rows, copies, answers, k, song)


def _of_songs(rows: DataFrame, vectors: DataFrame, answers: DataFrame, k: int, song: str) -> DataFrame:
    """Answers per distinct vector (_rep, _r, neighbor_id, distance: k+1 of them) for every song (_id, _vec), without itself."""
    lists = answers.groupBy("_rep").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbor_id", "distance"))).alias("_list"))
    per_vector = lists.join(vectors.select("_rep", "_vec"), "_rep").select("_vec", "_list")
    listed = rows.join(per_vector, "_vec").select(F.col("_id"), F.slice(
        F.filter("_list", lambda e: e["neighbor_id"] != F.col("_id")), 1, k).alias("_list"))
    return listed.select(F.col("_id").alias(song), F.posexplode("_list").alias("_pos", "_e")).select(
        song, (F.col("_pos") + 1).alias("rank"), "_e.neighbor_id", "_e.distance")


@dataclass(frozen=True)
class Cells:
    """Stored songs in cells around the pivots of ``index``.

    ``radius``: the farthest song of every cell (-1 where it has none). ``sizes``: its songs. ``read``: the songs (_rep, _vec,
    _cell) of some cells.
    """
    index: CellIndex
    radius: np.ndarray
    sizes: np.ndarray
    read: Callable[[list[int]], DataFrame]


def balls(placed: DataFrame) -> DataFrame:
    """The radius and size of the cells of songs (_cell, _far): _cell, _far, _n."""
    return placed.groupBy("_cell").agg(F.max("_far").alias("_far"), F.count("*").alias("_n"))


def with_balls(rows: DataFrame, radius: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The radius and size of every cell with those of some cells (_cell, _far, _n) besides."""
    radius, sizes = radius.copy(), sizes.copy()
    for row in rows.collect():  # a row per cell, as pivots are, and for each run
        radius[row["_cell"]], sizes[row["_cell"]] = max(radius[row["_cell"]], row["_far"]), sizes[row["_cell"]] + row["_n"]
    return radius, sizes


def stored_cells(index: CellIndex, rows: DataFrame, read: Callable[[list[int]], DataFrame]) -> Cells:
    """Cells by the radius and size of those that hold songs (_cell, _far, _n)."""
    none = len(index.pivots)
    return Cells(index, *with_balls(rows, np.full(none, -1.0), np.zeros(none, dtype=np.int64)), read)


def songs_in_cells(songs: DataFrame, index: CellIndex, song: str = "song_id", vector: str = "features") -> DataFrame:
    """Songs with an id in the cells of an index: (_rep, _vec array<double>, _cell, _far)."""
    given = songs.filter(F.col(song).isNotNull()).select(F.col(song).alias("_rep"), F.col(vector).cast("array<double>").alias("_vec"))
    return _placed(given, index)


def cells_of(library: DataFrame, song: str = "song_id", vector: str = "features", cell_rows: int | None = None) -> Cells:
    """A library put in cells."""
    index = CellIndex.of(pivots_of(library.select(F.col(song).alias("_rep"), F.col(vector).alias("_vec")), cell_rows or CELL_ROWS))
    held = settled(songs_in_cells(library, index, song, vector), "library-cells")
    return stored_cells(index, balls(held), lambda cells: held.filter(F.col("_cell").isin(cells)).drop("_far"))


def new_in_cells(mine: DataFrame, library: Cells, k: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """New songs (_rep, _vec, _cell, _far), what their own blocks say and the stored and new songs that they may visit.

    Asked vectors: _rep, _vec, _cell. Own blocks: as of :func:`own_cells`, for the asked vectors. Cells: as there, with the first
    k+1 songs of every vector, from the cells that new songs fall into and those that come within the reach found there.
    """
    index, width = library.index, library.index.pivots.shape[1]
    asked = settled(mine.groupBy("_vec").agg(F.min("_rep").alias("_rep"), F.min("_cell").alias("_cell")), "asked-vectors")
    own = sorted(r["_cell"] for r in asked.select("_cell").distinct().collect())
    if not own:
        return None
    (radius, songs), sizes = with_balls(balls(mine), library.radius, library.sizes), np.zeros(len(index.pivots), dtype=np.int64)
    id_type, room = dict(mine.dtypes)["_rep"], max(1, min(block_rows, block_bytes // (8 * width)))

    def first_of_vectors(cells: list[int]) -> DataFrame:
        rows = library.read(cells).unionByName(mine.filter(F.col("_cell").isin(cells)).drop("_far"))
        first = settled(top_n(rows, ["_cell", "_vec"], ["_rep"], k + 1, "_copy").drop("_copy"), "near-cells")
        for row in first.groupBy("_cell").count().collect():
            sizes[row["_cell"]] = row["count"]
        return first

    def look(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            nothing = pd.Series([[]] * len(queries), index=queries.index, dtype=object)
            return queries.assign(near=nothing, far=nothing)
        ids = members["_rep"].to_numpy()
        q, d, distance = _closest(_stacked(queries["_vec"]), _stacked(members["_vec"]), ids, k + 1)
        first = np.searchsorted(q, np.arange(len(queries) + 1))
        return queries.assign(near=[ids[d[a:b]] for a, b in zip(first, first[1:])], far=[distance[a:b] for a, b in zip(first, first[1:])])

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = _stacked(batch["_vec"])
                cells = index.reachable(points, _reach(points, batch["far"], k, index, radius, songs), radius)[1]
                yield pd.DataFrame({"_cell": np.unique(cells).astype("int32")})

    held = first_of_vectors(own)
    blocks = np.maximum(-(-sizes // room), 1)
    places, keys = [[0] * b for b in blocks], ["_cell", "_block"]
    at, there = _blocked(asked, places).drop("_group"), _blocked(held, places).drop("_group")
    seen = f"_rep {id_type}, _vec array<double>, _cell int, _block int, near array<{id_type}>, far array<double>"
    looked = settled(at.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(look, seen), "near-own")
    more = sorted({r["_cell"] for r in looked.mapInPandas(reachable, "_cell int").distinct().collect()} - set(own))
    if more:
        held = held.unionByName(first_of_vectors(more))
    blocks = np.maximum(-(-sizes // room), 1)  # those of the new songs' own cells stay
    groups = _visit_groups(index, sizes, blocks, ROW_BYTES)
    return asked, _blocked(held, groups), _with_visits(looked, index, radius, blocks, groups, k, songs)


def knn_of_new(
    new: DataFrame, library: DataFrame | Cells, k: int = fv.NEIGHBOURS, song: str = "song_id", vector: str = "features",
    block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Neighbours of new songs among the library plus themselves, as of :func:`knn`; a song without an id is no neighbour.

    ``library``: a table or songs stored in cells. Equal new vectors are asked for once, and of equal stored ones the
    first k+1 songs answer. A vector is compared with a block of its own cell first (``block_rows``, ``block_bytes``), and then
    only with cells within the reach found there; cells that no vector may reach are not read.
    """
    cells = cells_of(library, song, vector) if isinstance(library, DataFrame) else library
    mine = settled(songs_in_cells(new, cells.index, song, vector), "asked-songs")
    found = new_in_cells(mine, cells, k, block_rows, block_bytes)
    if found is None:
        id_type = dict(mine.dtypes)["_rep"]
        return new.sparkSession.createDataFrame([], f"{song} {id_type}, rank int, neighbor_id {id_type}, distance double")
    asked, held, own = found
    pairs = own.select("_rep", F.explode(F.arrays_zip("near", "far")).alias("_n")).select("_rep", F.col("_n.near").alias("_other"), F.col("_n.far").alias("distance"))
    if not own.filter(F.size("visits") > 0).isEmpty():
        pairs = pairs.unionByName(_visited(held, own, k))
    answers = top_n(pairs.withColumnRenamed("_other", "neighbor_id"), ["_rep"], ["distance", "neighbor_id"], k + 1, "_r")
    return _of_songs(mine.select(F.col("_rep").alias("_id"), "_vec"), asked, answers, k, song)


def fit_map(features: DataFrame, dimensions: int, vector: str = "features") -> dict:
    """Centre and two main axes of standardised vectors, fitted from one distributed moment matrix.

    The result is the stored model: ``dimensions``-sized lists only. The sign of an axis is fixed by its
    largest loading. Fewer than three songs give no map.
    """
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, np.zeros(dimensions), np.zeros((dimensions, dimensions))
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(float)
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dimensions), dimensions), "j": np.tile(np.arange(dimensions), dimensions),
                            "n": float(n), "si": np.repeat(s, dimensions), "p": p.ravel()})

    sums = features.select(vector).mapInPandas(moments, "i int, j int, n double, si double, p double").groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("si").alias("si"), F.sum("p").alias("p")).collect()
    n = sums[0]["n"] if sums else 0
    if n < 3:
        raise ValueError("a map needs at least three songs")
    mean, product = np.zeros(dimensions), np.zeros((dimensions, dimensions))
    for row in sums:
        mean[row["i"]] = row["si"] / n
        product[row["i"], row["j"]] = row["p"] / n
    values, axes = np.linalg.eigh(product - np.outer(mean, mean))
    axes = axes[:, np.argsort(values)[::-1][:2]].T
    axes = [a * (1.0 if a[np.abs(a).argmax()] >= 0 else -1.0) for a in axes]
    while len(axes) < 2:
        axes.append(np.zeros(dimensions))
    return {"mean": mean.tolist(), "axes": [a.tolist() for a in axes]}


def apply_map(features: DataFrame, model: dict, song: str = "song_id", vector: str = "features") -> DataFrame:
    """``(song_id, x, y)`` of vectors under a stored map; plain array expressions."""
    mean = F.array(*[F.lit(m) for m in model["mean"]])
    centred = F.zip_with(F.transform(vector, lambda v: v.cast("double")), mean, lambda v, m: v - m)

    def along(axis: list[float]) -> Column:
        terms = F.zip_with(centred, F.array(*[F.lit(a) for a in axis]), lambda v, a: v * a)
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return features.select(song, along(model["axes"][0]).alias("x"), along(model["axes"][1]).alias("y"))


def project_2d(songs: DataFrame, keys: list[str], known: list[str] = fv.MAP_FEATURES, song: str = "song_id") -> DataFrame:
    """2-D map over the known ones of ``keys`` (their order does not matter): principal axes of the z-scores."""
    used = [k for k in known if k in keys]
    if not used:
        raise ValueError("no known feature chosen")
    z = standardise(songs, used, song=song)
    return apply_map(z, fit_map(z, len(used)), song)


def add_songs(new: DataFrame, known: DataFrame, statistics: DataFrame, model: dict, keys: list[str], song: str = "song_id") -> DataFrame:
    """Unknown new songs placed by the stored statistics and axes; gaps take the stored means."""
    fresh = new.join(known.select(song), song, "left_anti").dropDuplicates([song])
    return apply_map(standardise(fresh, keys, statistics, song=song), model, song)


def neighbour_songs(edges: DataFrame, songs: DataFrame, seeds: DataFrame | None = None, song: str = "song_id", attributes: tuple[str, ...] = ("key", "top_genre", "dominant_mood")) -> DataFrame:
    """Neighbours in rank order with a same-value flag per attribute against their seed."""
    chosen = edges if seeds is None else edges.join(seeds.select(song), song, "left_semi")
    seed = songs.select(F.col(song), *[F.col(a).alias(f"_seed_{a}") for a in attributes])
    found = songs.select(F.col(song).alias("neighbor_id"), *[F.col(a).alias(f"_found_{a}") for a in attributes])
    return chosen.join(seed, song).join(found, "neighbor_id").select(
        song, "rank", "neighbor_id", "distance",
        *[F.col(f"_seed_{a}").eqNullSafe(F.col(f"_found_{a}")).alias(f"same_{a}") for a in attributes])
