"""Near-duplicate documents by HyperMinHash registers.

1. Every text becomes the set of hashes of its 5-word shingles, and the set a
   row of 128 16-bit registers (`hyperminhash`).  Texts with equal sets are one
   class from here on, however many copies there are.
2. Registers are banded, 25 bands of 5.  At a similarity of 0.85 a pair
   shares no band with a chance below 1e-6; at 0.2 it shares one in 130 cases.
3. Classes that share a band are compared in blocks of at most 2 x ``BLOCK``
   of them, and only in the first band that a pair shares.  A band that more
   than ``CROWDED`` classes share, as texts of one template do, is banded once
   more before: over as many more registers as its size asks for, in so many
   tables that a pair at the threshold is missed with a chance below 1e-6.
   Blocks then grow with a power of the group's size well below two, unless
   its texts are alike indeed.  Pairs whose
   collision-corrected estimate is five standard errors below the threshold
   are left.
4. The remaining pairs are confirmed on the full sets, made again from the
   whole texts.  Links only need to tell which classes belong together, so a
   block skips pairs that it has already joined and returns at most one link
   for each of its classes, never all pairs of a group.
5. Links are contracted to components (`components`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import hyperminhash, words
from modlark.llm.components import components
from modlark.llm.scratch import Scratch

BAND = 5
#: Classes of a shared band are compared in blocks of twice as many at most.
BLOCK = 512
#: A band that more classes share is banded again.
CROWDED = 1 << 16
MISSED = 1e-6
#: Rows of blocks that go to a task together.
PACK_ROWS = 20_000
PACK_TEXTS = 3_000
#: Shingles of texts that go to a task together, about, and a block's at least.
PACK_SHINGLES = 2_000_000
#: Texts whose words are numbered together.
GROUP = 2_000
#: Blocks with more pairs than this for each of their texts are counted at once, so many shingles at a time.
MANY = 8
COLUMNS = 4096


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words than
    ``size`` has one shingle, a text without words none."""
    ids, counts, vocabulary = words.numbered(texts)
    hashed, at = words.hashes(vocabulary)[ids], words.starts(counts)
    return [np.unique(words.windows(hashed[i:j], min(size, max(1, j - i)))) for i, j in zip(at[:-1], at[1:])]


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                n = np.asarray([len(s) for s in sets], np.int64)
                regs = hyperminhash.registers(np.concatenate(sets), np.repeat(np.arange(len(n)), n), len(n))
                some = [bool(k) for k in n]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array([_digest(s) if k else None for s, k in zip(sets, some)], pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(regs, some)], pa.binary())],
                    names=["id", "text_key", "n_shingles", "digest", "registers"],
                )

    return sign


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hyperminhash.BUCKETS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = hyperminhash.bands(_registers(batch.column(1)), BAND)
            band = np.broadcast_to(np.arange(keys.shape[1], dtype=np.int32), keys.shape)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "band", "node"])


def tables_for(n: int, percent: int) -> tuple[int, int]:
    """Registers of a key, and tables of such keys, for a band of ``n`` classes:
    half-alike classes share a key with about ``BLOCK`` others, and pairs at
    the threshold share none with a chance of ``MISSED`` at most."""
    registers = max(1, math.ceil(math.log2(n / BLOCK)))
    return registers, math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** registers))


def _rebanded(percent: int):
    """New keys of the members of crowded bands; such keys are of no band."""

    def band_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for n in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == n))
                regs, old, node = _registers(rows.column(2)), rows.column(0).to_numpy().view(np.uint64), rows.column(1)
                k, many = tables_for(n, percent)
                rng = np.random.default_rng(k)
                for t in range(many):
                    key = old + np.uint64(t + 1)
                    for column in rng.choice(hyperminhash.BUCKETS, min(k, hyperminhash.BUCKETS), replace=False):
                        key = words.mix(key * hyperminhash.PRIME + regs[:, column].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), np.int32)), node], names=["key", "band", "node"])

    return band_again


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows of each block of a task's table, and its two chunk numbers."""
    key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
    order = np.lexsort((table.column("node").to_numpy(), j, i, key))
    new = np.flatnonzero((np.diff(key[order], prepend=0) != 0) | (np.diff(i[order], prepend=-1) != 0) | (np.diff(j[order], prepend=-1) != 0))
    for rows in np.split(order, new[1:] if len(new) and new[0] == 0 else new):
        if len(rows):
            yield rows, int(i[rows[0]]), int(j[rows[0]])


def _pairs(regs: np.ndarray, n: np.ndarray, chunk: np.ndarray, band: int, across: bool, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block whose estimate reaches ``cut``, highest first.

    A pair counts in the first band that it shares, and between two chunks
    only if it has one side in either.  Keys of band 0 count every pair.
    """
    a, b = np.triu_indices(len(regs), 1)
    if across:
        apart = chunk[a] != chunk[b]
        a, b = a[apart], b[apart]
    keys = hyperminhash.bands(regs, BAND)
    out = []
    for at in range(0, len(a), 20_000):
        x, y = a[at : at + 20_000], b[at : at + 20_000]
        first = (keys[x, :band] != keys[y, :band]).all(axis=1)
        x, y = x[first], y[first]
        near = hyperminhash.similarity(regs[x], regs[y], n[x], n[y])
        out.append(np.stack([x, y, near])[:, near >= cut])
    found = np.concatenate(out, axis=1) if out else np.empty((3, 0))
    found = found[:, np.argsort(-found[2], kind="stable")]
    return found[0].astype(int), found[1].astype(int), found[2]


def _met(cut: float):
    """Members that have a partner in their block."""

    def meet(table: pa.Table) -> pa.Table:
        regs, n = _registers(table.column("registers")), table.column("n_shingles").to_numpy()
        chunk, band = table.column("chunk").to_numpy(), table.column("band").to_numpy()
        kept = []
        for rows, i, j in _blocks(table):
            a, b, _ = _pairs(regs[rows], n[rows], chunk[rows], int(band[rows[0]]), i != j, cut)
            kept.append(rows[np.unique(np.concatenate([a, b]))])
        return table.select(["key", "band", "i", "j", "chunk", "node"]).take(pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)))

    return meet


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two sets of a block share, by products of columns
    of the table of which set has which shingle."""
    n, flat = len(sets), np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    new = np.diff(flat[order], prepend=flat[order[0]] ^ np.uint64(1)) != 0
    shingle = np.cumsum(new) - 1
    often = np.bincount(shingle)[shingle] > 1
    column, row = np.unique(shingle[often], return_inverse=True)[1], of[order][often]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        table = np.zeros((n, COLUMNS), np.float32)
        table[row[inside], column[inside] - at] = 1
        out += table @ table.T
    return out


def _confirmed(size: int, percent: int, cut: float):
    """Links of the blocks' members, confirmed on the full sets."""

    def confirm(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        known: dict[int, np.ndarray] = {}
        texts, digests = table.column("text"), table.column("digest")
        right = np.zeros(len(node), bool)
        for at in range(0, len(node), GROUP):
            for k, s in enumerate(shingle_sets(texts.slice(at, GROUP).to_pylist(), size)):
                right[at + k] = _digest(s) == digests[at + k].as_py()
                if right[at + k]:
                    known[int(node[at + k])] = s
        regs, n = _registers(table.column("registers")), table.column("n_shingles").to_numpy()
        chunk, band = table.column("chunk").to_numpy(), table.column("band").to_numpy()
        links = []
        for rows, i, j in _blocks(table):
            rows = rows[right[rows]]
            rows = rows[np.unique(node[rows], return_index=True)[1]]
            root = list(range(len(rows)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            a, b, _ = _pairs(regs[rows], n[rows], chunk[rows], int(band[rows[0]]) if len(rows) else 0, i != j, cut)
            sets = [known[x] for x in node[rows].tolist()]
            shared = _common(sets) if len(a) > MANY * len(sets) else None
            for x, y in zip(a.tolist(), b.tolist()):
                if (p := top(x)) != (q := top(y)):
                    s, t = sets[x], sets[y]
                    both = int(shared[x, y]) if shared is not None else len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        root[p] = q
                        links.append((int(node[rows[x]]), int(node[rows[y]])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return confirm


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """Group documents whose shingle sets are alike.

    Two documents are linked if 100 x intersection >= ``percent`` x union of
    their sets of ``size``-word shingles (A-Z lower-cased).  Returns per row of
    ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    that links lead to, its own included), ``kept`` (the id is that smallest)
    ``group_key`` (the same for all rows of a component; null if empty) and
    ``text_key`` (a hash of the text).

    * Null or wordless text: no shingles, linked with nothing, kept.
    * Null id: takes part in its component, whose id is the smallest of the
      others; kept only if there is none.  Rows that repeat an id and a text
      are both returned, with the same values.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = percent / 100 - 5 * (percent * (100 - percent) / 1e4 / hyperminhash.BUCKETS) ** 0.5
    given = given.withColumn("text_key", F.xxhash64("text"))
    signed = scratch.keep(given.mapInArrow(_signed(size), "id long, text_key long, n_shingles long, digest binary, registers binary"), "signed")
    alike = signed.where("digest is not null").withColumn("id_text", F.coalesce(F.col("id").cast("string"), F.lit(""))).groupBy("digest")
    classes = alike.agg(F.min("id").alias("least"), F.min(F.struct("id_text", "text_key")).alias("shown"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = scratch.keep(classes.select("node", "registers").mapInArrow(_banded, "key long, band int, node long"), "banded")

    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = banded.join(shared, "key")
    if not (many := shared.where(F.col("n") > crowded)).isEmpty():
        many = banded.join(many, "key").join(classes.select("node", "registers"), "node").select("key", "node", "registers", "n")
        again = scratch.keep(many.mapInArrow(_rebanded(percent), "key long, band int, node long"), "again")
        met = met.where(F.col("n") <= crowded).unionByName(again.join(again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    member = met.withColumn("c", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn("chunk", F.expr("cast(pmod(xxhash64(node), c) as int)"))
    member = member.select("key", "band", "node", "chunk", F.explode(F.expr("sequence(0, c - 1)")).alias("other"))
    member = scratch.keep(member.select("key", "band", "node", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")), "member")
    scratch.drop("banded", "again")

    def packed(df: DataFrame, n: int):
        return df.withColumn("pack", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n))).groupBy("pack")

    cells = "key long, band int, i int, j int, chunk int, node long"
    sized = member.join(classes.select("node", "n_shingles", "registers"), "node")
    met = scratch.keep(packed(sized, 1 + member.count() // PACK_ROWS).applyInArrow(_met(cut), cells), "met")
    need = classes.join(met.select("node").distinct(), "node", "left_semi")
    shown = need.select("shown.*", "node", "n_shingles", "registers", "digest")
    named = given.withColumn("id_text", F.coalesce(F.col("id").cast("string"), F.lit(""))).select("id_text", "text_key", "text")
    texts = named.join(shown.select("id_text", "text_key"), ["id_text", "text_key"], "left_semi").groupBy("id_text", "text_key").agg(F.first("text").alias("text"))
    texts = shown.join(texts, ["id_text", "text_key"]).drop("id_text", "text_key")
    rows, shingles = met.join(classes.select("node", "n_shingles"), "node").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    links = packed(met.join(texts, "node"), 1 + max(rows // PACK_TEXTS, shingles // PACK_SHINGLES)).applyInArrow(_confirmed(size, percent, cut), "a long, b long")
    roots = scratch.keep(components(links, scratch), "roots")
    scratch.drop("member", "met")

    rooted = classes.select("digest", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("digest", "root", "component_id")
    out = signed.select("id", "text_key", "n_shingles", "digest").join(found, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), F.col("root").alias("group_key"), "text_key")


def keep_one(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if each group of near-duplicates keeps one.

    Of a group the row with the smallest id stays; of rows that share this id,
    and of those that repeat an id and a text, one.  Texts without words are
    no duplicates of others.  All columns are returned as they are.
    """
    found = near_duplicates(docs, percent, size, id_col, text_col).where("kept").select("doc_id", "text_key", "group_key")
    named = F.struct("doc_id", "text_key")
    grouped = found.where("group_key is not null").groupBy("group_key").agg(F.min(named).alias("k")).select("k.*")
    stay = grouped.unionByName(found.where("group_key is null").select("doc_id", "text_key").distinct())
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    given = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own_key"))
    met = given.join(stay, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key")), "left_semi")
    return met.dropDuplicates(["own_id", "own_key"]).select("row.*")
