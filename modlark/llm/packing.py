"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt by a hash into cells of about ``CELL`` pieces.  Each cell is
solved on ``ISLANDS`` islands, which are groups of their own in a shuffle:
every island evolves its population, sends its elite to the next one, and
evolves on with what it got; the fittest elite of a cell packs it.  Where best
fit decreasing, one of the founders, already meets the lower bound of a cell,
there is nothing to evolve.  Pieces of
ill-filled sequences leave their cell and are packed again in fewer cells,
until one cell is left or a level hardly lowers the number of cells; the cells
of that level settle all their sequences.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import grouping
from modlark.llm.scratch import Scratch
from modlark.llm.tokens import encode

CELL = 8192
ISLANDS = 2
FOUNDERS = 3
#: Of each island before and after migration; it evolves no further where its bins can't be fewer.
GENERATIONS = 48
END = np.asarray([1], "<u4").tobytes()
#: Cells other than the last give up sequences filled below this share.
WELL_FILLED = 0.98
#: A level with more than this share of the cells before it is the last: its pieces can't fill sequences well.
FEWER = 0.75
_ITEM = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text, path) + END
                for k, begin in enumerate(range(0, len(ids), width)):
                    part = ids[begin : begin + width]
                    row.append(at)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id 1, cut after every ``capacity`` ids."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _labels(bins: grouping.Bins, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, one in enumerate(bins):
        out[one] = b
    return out.tobytes()


def _bins(labels: bytes) -> grouping.Bins:
    of = np.frombuffer(labels, np.int32)
    order = np.argsort(of, kind="stable")
    return [one.tolist() for one in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def _sorted(table: pa.Table) -> pa.Table:
    """A cell's pieces in the order that labels refer to."""
    return table.sort_by("uid")


_STATE = "cell long, island int, bins int, fill double, elites array<binary>"


def _state(cell: int, island: int, population: list[grouping.Bins], size: list[int], capacity: int) -> pa.Table:
    worst, fill = grouping.fitness(population[0], size, capacity)
    elites = [_labels(p, len(size)) for p in population]
    return pa.table({"cell": pa.array([cell], pa.int64()), "island": pa.array([island], pa.int32()), "bins": pa.array([-worst], pa.int32()), "fill": [fill], "elites": pa.array([elites], pa.list_(pa.binary()))})


def _founded(capacity: int):
    def found(table: pa.Table) -> pa.Table:
        cell, island = table.column("cell")[0].as_py(), table.column("island")[0].as_py()
        size = _sorted(table).column("length").to_pylist()
        rng = random.Random(f"{cell}/{island}")
        population = grouping.founders(size, capacity, FOUNDERS, rng) if not island else grouping.founders(size, capacity, FOUNDERS + 1, rng)[1:]
        return _state(cell, island, grouping.evolve(population, size, capacity, GENERATIONS, rng), size, capacity)

    return found


def _evolved(capacity: int):
    def go_on(table: pa.Table, states: pa.Table) -> pa.Table:
        cell, island = table.column("cell")[0].as_py(), table.column("island")[0].as_py()
        size = _sorted(table).column("length").to_pylist()
        population = [_bins(e) for e in states.column("elites")[0].as_py()] + [_bins(states.column("migrant")[0].as_py())]
        rng = random.Random(f"{cell}/{island}/migrated")
        return _state(cell, island, grouping.evolve(population, size, capacity, GENERATIONS, rng)[:1], size, capacity)

    return go_on


def _placed(capacity: int, level: int, last: bool):
    def place(table: pa.Table, states: pa.Table) -> pa.Table:
        table = _sorted(table)
        of = np.frombuffer(states.column("best")[0].as_py(), np.int32)
        length = table.column("length").to_numpy()
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(length[order])
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        before = np.repeat(np.append(0, ends)[first], np.diff(np.append(first, len(of))))
        offset = np.empty(len(of), np.int64)
        offset[order] = ends - length[order] - before
        fill = np.bincount(of, length)
        settled = (fill[of] >= WELL_FILLED * capacity) | last
        base = (level << 56) | (table.column("cell")[0].as_py() << 24)
        return table.drop_columns(["cell"]).append_column("sequence_id", pa.array(base + of.astype(np.int64))).append_column("offset", pa.array(offset)).append_column("settled", pa.array(settled))

    return place


def _solve(items: DataFrame, cells: int, capacity: int, level: int, last: bool) -> DataFrame:
    """Items with ``sequence_id``, ``offset`` and whether their sequence stays."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(cells)).cast("long"))
    narrow = dealt.select("cell", "uid", "length").withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    states = narrow.groupBy("cell", "island").applyInArrow(_founded(capacity), _STATE)
    elite = states.select("cell", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.col("elites")[0].alias("migrant"))
    given = states.join(elite, ["cell", "island"]).select("cell", "island", "elites", "migrant")
    states = narrow.groupBy("cell", "island").cogroup(given.groupBy("cell", "island")).applyInArrow(_evolved(capacity), _STATE)
    best = states.groupBy("cell").agg(F.min_by(F.col("elites")[0], F.struct("bins", -F.col("fill"), "island")).alias("best"))
    return dealt.groupBy("cell").cogroup(best.groupBy("cell")).applyInArrow(_placed(capacity, level, last), f"{_ITEM}, sequence_id long, offset long, settled boolean")


def pack(docs: DataFrame, path: str, capacity: int = 4096, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` token ids.

    ``path`` is a vocabulary file whose id 1 ends a document.  Returns per
    piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Longer documents alone are cut, into full sequences and a rest.

    * Null or empty text: the end id alone, a piece of length 1.
    * Null ids and repeated rows: packed like any other; a piece is known by
      its row, not by its id.
    * Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    items = scratch.keep(pieces(docs, path, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    alone = items.where(F.col("length") == capacity).select(*_COLUMNS[:5], F.expr("uid | (1L << 62)").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, before, done = items.where(F.col("length") < capacity), 0, 0, [alone]
    while True:
        cells = -(-rest.count() // cell)
        if not cells:
            break
        level += 1
        last = cells == 1 or (level > 1 and cells > FEWER * before)
        solved = scratch.keep(_solve(rest.select("uid", *_COLUMNS[:5]), cells, capacity, level, last), f"level{level}")
        done.append(solved.where("settled").select(*_COLUMNS))
        if last:
            break
        rest, before = solved.where("not settled"), cells
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
