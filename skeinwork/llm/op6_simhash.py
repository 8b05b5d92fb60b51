"""Near duplicates by SimHash fingerprints, compared exactly tile by tile."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text, fresh, stage
from skeinwork.llm.components import connected_components

BITS = 64


def fingerprint_of(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits as a signed number: a bit is 1 if it is set in more than half of the hashes of the word shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    hashed = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashed[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(column: Column, words: int = 3, seed: int = 42) -> Column:
    """Fingerprint of a text column as a long; null and blank texts have fingerprint 0."""
    return by_text(lambda: lambda t: fingerprint_of(t, words, seed), "long", pa.int64())(column)


def _deltas(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius; of a difference and its opposite the one with a positive start."""
    every = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in every if d > (0,) * parts]


class Tile:
    """Fingerprints of one tile block and a forest of the links among them and with the guests that pass by."""

    def __init__(self, homes: np.ndarray, radius: int):
        self.homes, self.radius = homes, radius
        self.label = np.arange(len(homes))

    def link(self, guests: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One link per guest that has any; homes that meet through a guest get one label. ``first``: guests are homes from there."""
        found_h, found_g = [], []
        for h in range(0, len(self.homes), 1024):
            for g in range(0, len(guests), 4096):
                near = np.bitwise_count(self.homes[h : h + 1024, None] ^ guests[None, g : g + 4096]) <= self.radius
                i, j = np.nonzero(near)
                i, j = i + h, j + g
                if first is not None:
                    before = i < j + first
                    i, j = i[before], j[before]
                if len(i):
                    found_h.append(i)
                    found_g.append(j)
                    # Dense groups: keep what is needed to join labels, not every pair.
                    if sum(map(len, found_h)) > 1 << 20:
                        found_h, found_g = self._join(found_h, found_g, len(guests))
        if not found_h:
            return guests[:0], guests[:0]
        found_h, found_g = self._join(found_h, found_g, len(guests))
        return guests[found_g[0]], self.homes[found_h[0]]

    def _join(self, found_h: list, found_g: list, guests: int) -> tuple[list, list]:
        """Join labels of homes with a common guest; returns one pair per guest."""
        i, j = np.concatenate(found_h), np.concatenate(found_g)
        least = np.full(guests, len(self.homes))
        while True:
            np.minimum.at(least, j, self.label[i])
            old = self.label.copy()
            np.minimum.at(self.label, i, least[j])
            np.minimum.at(self.label, old[i], least[j])
            self.label = self.label[self.label]
            if np.array_equal(old, self.label):
                break
        _, at = np.unique(j, return_index=True)
        return [i[at]], [j[at]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = self.label != np.arange(len(self.homes))
        return self.homes[moved], self.homes[self.label[moved]]


def _compare(radius: int):
    """Rows (tile, block, role, fp) sorted by tile, block and role; role 0 rows are the homes of a block, role 1 its guests."""

    def run(batches):
        key, homes, tile = None, [], None
        out_u, out_v = [], []

        def emit(pair):
            u, v = pair
            if len(u):
                out_u.append(u.view(np.int64))
                out_v.append(v.view(np.int64))

        def open_tile():
            nonlocal tile
            if tile is None:
                tile = Tile(np.concatenate(homes) if homes else np.zeros(0, np.uint64), radius)
                for k in range(0, len(tile.homes), 1 << 13):
                    emit(tile.link(tile.homes[k : k + (1 << 13)], first=k))
            return tile

        def close():
            if key is not None:
                emit(open_tile().links())

        def flush():
            nonlocal out_u, out_v
            u, v = np.concatenate(out_u), np.concatenate(out_v)
            out_u, out_v = [], []
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            tiles, blocks, roles = (batch.column(k).to_numpy() for k in range(3))
            fps = batch.column(3).to_numpy().view(np.uint64)
            change = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
            cuts = [0, *change.tolist(), len(fps)] if len(fps) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (tiles[a], blocks[a]) != key:
                    close()
                    key, homes, tile = (tiles[a], blocks[a]), [], None
                if roles[a] == 0:
                    homes.append(fps[a:b])
                else:
                    emit(open_tile().link(fps[a:b]))
            if sum(map(len, out_u)) > 1 << 16:
                yield flush()
        close()
        if out_u:
            yield flush()

    return run


def fingerprint_links(fps: DataFrame, radius: int = 2, parts: int = 4, tile_rows: int = 1 << 16) -> DataFrame:
    """Links (u, v) whose components are those of "at most ``radius`` bits differ" over the distinct longs of column ``fp``.

    A tile holds the fingerprints with the same population counts of their ``parts`` parts. Two fingerprints within the
    radius lie in tiles whose counts differ by no more than the radius in sum; other tile pairs are skipped. A tile's rows
    visit the later one of each remaining pair and are compared there with numpy exclusive-or and bit counts, all with all.
    Tiles of more than ``tile_rows`` rows are cut into blocks by hash; guests stream past a block, so memory is bounded by a
    block and a batch. Tile sizes are a table of at most (64 / parts + 1) ** parts rows, which is broadcast.

    Comparisons are n^2 x (pairs of tiles kept): 4 parts leave about 1 of 200, 8 parts 1 of 9,000 at 73 instead of 21 rows per
    fingerprint. Use 4 up to some hundred million distinct fingerprints and 8 beyond.
    """
    if BITS % parts:
        raise ValueError("parts must divide 64")
    width = BITS // parts
    side = width + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1))) for k in range(parts)]
    own = fps.select("fp", *[c.alias(f"p{k}") for k, c in enumerate(count)])
    weight = [side**k for k in range(parts)]
    tile = lambda d: reduce(lambda a, b: a + b, [(F.col(f"p{k}") + d[k]) * weight[k] for k in range(parts)]).cast("int")
    inside = lambda d: reduce(lambda a, b: a & b, [(F.col(f"p{k}") + d[k]).between(0, width) for k in range(parts)])
    zero = (0,) * parts
    own = own.withColumn("own", tile(zero))
    sizes = own.groupBy("own").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("blocks")).withColumnRenamed("own", "tile")
    visits = F.filter(F.array(*[F.when(inside(d), tile(d)) for d in [zero, *_deltas(parts, radius)]]), lambda t: t.isNotNull())
    seats = own.select("fp", "own", F.explode(visits).alias("tile")).join(F.broadcast(sizes), "tile")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # In its own tile a row is at home in its block and a guest of the later blocks; elsewhere it is a guest of every block.
    from_ = F.when(F.col("tile") == F.col("own"), mine).otherwise(F.lit(0))
    placed = seats.select("tile", "fp", F.explode(F.sequence(from_, F.col("blocks") - 1)).alias("block"), mine.alias("mine"), (F.col("tile") == F.col("own")).alias("at_home"))
    rows = placed.select("tile", "block", F.when(F.col("at_home") & (F.col("block") == F.col("mine")), 0).otherwise(1).alias("role"), "fp")
    return rows.repartition("tile", "block").sortWithinPartitions("tile", "block", "role").mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(marked: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = 2, parts: int = 4, tile_rows: int = 1 << 16) -> DataFrame:
    """``fp``, ``root`` (names the component) and ``component_id``: the smallest id among the documents that ``fp`` reaches over links of at most ``radius`` bits.

    Copies count once: documents are aggregated by fingerprint before anything is compared. ``marked`` is read twice and
    should be a staged table. A component whose ids are all null has component id null.
    """
    distinct = marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    distinct = stage(distinct, "fingerprints")
    links = stage(fingerprint_links(distinct.select("fp"), radius, parts, tile_rows), "links")
    roots = connected_components(links)
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def dedup_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, parts: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed 64-bit fingerprint), ``component_id``.

    A-Z are lower-cased, words are separated by ASCII white space, shingles have ``words`` words and count as often as they
    occur. Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows all come back. Rows
    with a null id take part and come back with a null ``doc_id``. Other columns are not read; an empty table gives no rows.
    """
    marked = stage(df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string"), words).alias("fp")), "simhash")
    return marked.join(near_duplicates(marked, radius=radius, parts=parts), "fp").select("doc_id", "fp", "component_id")


def keep_least(df: DataFrame, classes: DataFrame, hashed: Column, id_: Column) -> DataFrame:
    """One row of ``df`` for each ``root`` of ``classes`` (``doc_id``, ``hash``, ``root``, ``component_id``), chosen as ``keep_one`` says."""
    key, rank = fresh(df.columns, "row_hash"), fresh(df.columns, "row_rank")
    chosen = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("hash").alias(key)).select(key)
    found = df.withColumn(key, hashed).join(chosen, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key, id_).orderBy(key))
    return found.withColumn(rank, first).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, parts: int = 4) -> DataFrame:
    """The rows of ``df`` with one row of each component: one with the smallest id, of several such the one with the least hash.

    Components are found on ids, fingerprints and hashes of id and text; full rows are shuffled once, to be met with the
    chosen hashes. Of rows that repeat id and text one stays, of a component without ids one row, too.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    hashed = F.xxhash64(id_, text)
    marked = stage(df.select(id_.alias("doc_id"), hashed.alias("hash"), fingerprint(text, words).alias("fp")), "simhash")
    return keep_least(df, marked.join(near_duplicates(marked, radius=radius, parts=parts), "fp"), hashed, id_)
