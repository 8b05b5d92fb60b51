"""Near copies by exact Jaccard similarity of word shingles, on candidates of a SimHash class (``op6_simhash``) or a MinHash band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import Scratch, by_text, held, stage
from skeinwork.llm.components import connected_components
from skeinwork.llm.op4_decontamination import _shingle_hashes, _word_hashes
from skeinwork.llm.op6_simhash import fingerprint_of, keep_least, near_duplicates

# At a similarity of 0.8 two texts share none of the bands with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, BAND_ROWS = 32, 4
# Minima that screen pairs, a byte each.
SCREENED = 64
_RNG = np.random.default_rng(6)
_FACTOR, _SHIFT = (_RNG.integers(0, 2**63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BAND_FACTOR = _RNG.integers(0, 2**63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle. Words as in ``op6_simhash.fingerprint_of``."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(1, np.uint64)
    return np.unique(_shingle_hashes(_word_hashes(tokens), min(words, len(tokens))))


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """Least value of the shingles under each function."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1 << 12):
        np.minimum(least, (shingles[k : k + (1 << 12)] * _FACTOR + _SHIFT).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """A key per band: band number and ``BAND_ROWS`` of the minima."""
    mixed = (least ^ (least >> np.uint64(32))).reshape(BANDS, BAND_ROWS) * _BAND_FACTOR
    keys = mixed.sum(axis=1, dtype=np.uint64) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _marks(words: int):
    held("near-copies", dict)  # what an earlier stage kept gives way

    def of(text: str) -> dict:
        shingles = shingle_set(text, words)
        least = minima_of(shingles)
        sig = int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))
        return {"sig": sig, "fp": fingerprint_of(text, words), "bands": bands_of(least), "minima": least[:SCREENED].astype(np.uint8).tobytes()}

    return of


_MARKS = pa.struct([("sig", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("minima", pa.binary())])


def agreeing(threshold: float) -> int:
    """Minima that two texts of similarity ``threshold`` share at least: six standard deviations below the mean, so a pair at
    the threshold is screened out with probability 1e-9."""
    n = SCREENED
    return int(max(0, np.floor(n * threshold - 6 * np.sqrt(n * threshold * (1 - threshold)))))


def _screen(least: int):
    """Seats (key, block, role, sig, root, minima) sorted by key, block and role -> those with a member of another component in
    the block that shares ``least`` minima or more."""
    names = ["key", "block", "role", "sig", "root"]

    def run(batches):
        seat, homes, roots, wanted = None, [], [], set()
        minima = np.empty((64, SCREENED), np.uint8)

        def flush():
            return [homes[k] for k in sorted(wanted)]

        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if row[:2] != seat:
                    out += flush()
                    seat, homes, roots, wanted = row[:2], [], [], set()
                n, mine = len(homes), np.frombuffer(row[5].as_buffer(), np.uint8)
                near = np.flatnonzero((np.count_nonzero(minima[:n] == mine, axis=1) >= least) & (np.array(roots, np.int64) != row[4]))
                wanted.update(int(k) for k in near)
                if row[2] == 1:
                    if len(near):
                        out.append(row[:5])
                    continue
                if len(near):
                    wanted.add(n)
                if n == len(minima):
                    minima = np.concatenate([minima, np.empty_like(minima)])
                minima[n] = mine
                homes.append(row[:5])
                roots.append(row[4])
            yield _seats(out)
        yield _seats(flush())

    def _seats(rows):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run, "key long, block int, role int, sig long, root long"


class Block:
    """Members of a block by component; tells which components a passing text is similar to."""

    def __init__(self, threshold: float):
        self.threshold, self.sets, self.sigs, self.roots, self.parent = threshold, [], [], [], {}

    def find(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            self.parent[root] = root = self.parent.get(up, up)
        return root

    def add(self, sig: int, root: int, shingles: np.ndarray) -> None:
        self.sigs.append(sig)
        self.roots.append(root)
        self.sets.append(shingles)

    def link(self, sig: int, root: int, shingles: np.ndarray) -> list[int]:
        """One similar member of each component that has any and is not the text's own, compared exactly; these become one."""
        mine, n = self.find(root), len(shingles)
        others = [k for k, s in enumerate(self.sets) if min(n, len(s)) >= self.threshold * max(n, len(s)) - 1e-9 and self.find(self.roots[k]) != mine]
        if not others:
            return []
        sizes = np.array([len(self.sets[k]) for k in others])
        every = np.concatenate([self.sets[k] for k in others])
        hit = shingles[np.minimum(np.searchsorted(shingles, every), n - 1)] == every
        shared = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
        found = []
        for k in np.flatnonzero(shared >= self.threshold * (sizes + n - shared) - 1e-9).tolist():
            theirs = self.find(self.roots[others[k]])
            if theirs != self.find(root):
                self.parent[theirs] = self.find(root)
                found.append(self.sigs[others[k]])
        return found


def _once(batches):
    """Rows (key, block, role, sig, root, text) without those that a batch has already: rows that repeat in the table."""
    for batch in batches:
        table = pa.table({c: batch.column(c) for c in ("key", "block", "role", "sig")}).append_column("at", pa.array(range(batch.num_rows), pa.int64()))
        yield batch.take(table.group_by(["key", "block", "role", "sig"]).aggregate([("at", "min")])["at_min"].combine_chunks())


def _compare(threshold: float, words: int):
    """Rows (key, block, role, sig, root, text) sorted by key, block, role and sig; role 0 rows are at home in a block, role 1
    its guests."""

    def run(batches):
        key, block, last = None, None, None
        for batch in batches:
            out_u, out_v = [], []
            keys, blocks, roles, sigs, roots = (batch.column(k).to_pylist() for k in range(5))
            for i, (k, b, role, sig, root) in enumerate(zip(keys, blocks, roles, sigs, roots, strict=True)):
                if (k, b, role, sig) == last:
                    continue
                last = k, b, role, sig
                if (k, b) != key:
                    key, block = (k, b), Block(threshold)
                shingles = shingle_set(batch.column(5)[i].as_py() or "", words)
                for v in block.link(sig, root, shingles):
                    out_u.append(sig)
                    out_v.append(v)
                if role == 0:
                    block.add(sig, root, shingles)
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return run


def _seated(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "role", "sig")


def _links(seats: DataFrame, distinct: DataFrame, texts: DataFrame, words: int, threshold: float, scratch: Scratch, purpose: str) -> DataFrame:
    """Links of the seats' blocks. Seats are screened by their minima (64 bytes); only the texts of those that may have a
    partner are moved, once per seat, and become sets where they are compared."""
    screen, columns = _screen(agreeing(threshold))
    asked = _seated(seats.join(distinct.select("sig", "minima"), "sig").select("key", "block", "role", "sig", "root", "minima"))
    near = scratch.stage(asked.mapInArrow(screen, columns), f"{purpose}_near")
    placed = scratch.stage(near.join(distinct.select("sig", "hash"), "sig").select("key", "block", "role", "sig", "root", "hash"), f"{purpose}_placed")
    rows = texts.join(placed, "hash").select("key", "block", "role", "sig", "root", "text").mapInArrow(_once, f"{columns}, text string")
    found = scratch.stage(_seated(rows).mapInArrow(_compare(threshold, words), "u long, v long"), purpose)
    scratch.drop(near, placed)
    return found


def similar_links(distinct: DataFrame, texts: DataFrame, scratch: Scratch, words: int = 5, threshold: float = 0.8, block_rows: int = 512) -> DataFrame:
    """Links (u, v) whose components are those of "similarity ``threshold`` or more" over rows (``sig``, ``hash``, ``fp``,
    ``bands``, ``minima``) with a sig each; ``texts`` has the ``text`` of a ``hash``.

    Texts of a SimHash class (their fingerprints reach each other over links of two bits, as ``op6_simhash`` finds them) meet
    in its bucket, and so do texts that share a band, which finds the similar ones whose fingerprints lie farther apart.
    Buckets with the same members count once. First every member is compared
    with the least one of its bucket, which settles the buckets of one dense group; then all members with all in the buckets
    that still hold several components, cut into blocks of ``block_rows`` that the members of later blocks pass by. No pair is
    a row, and a component's own pairs are not compared again. ``sets_of(sigs)`` gives ``sig`` and ``set`` of the sigs asked for.
    """
    classes = near_duplicates(distinct.select("sig", "fp"), id_col="sig").select("fp", F.col("root").alias("key"))
    placed = distinct.select("sig", F.explode("bands").alias("key")).unionByName(distinct.select("sig", "fp").join(classes, "fp").select("sig", "key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("sig").alias("center"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    buckets = scratch.stage(buckets.groupBy("n", "center", "sum").agg(F.min("key").alias("key")).select("key", "n", "center"), "buckets")
    members = scratch.stage(placed.join(buckets, "key"), "members")
    stars = members.where("sig <> center").select("sig", "center").distinct()
    sizes = scratch.stage(stars.groupBy("center").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "stars")
    rays = stars.join(sizes, "center").select(F.col("center").alias("key"), F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "sig", F.col("sig").alias("root"))
    hubs = sizes.select(F.col("center").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("center").alias("sig"), F.col("center").alias("root"))
    first = _links(rays.unionByName(hubs), distinct, texts, words, threshold, scratch, "star_links")

    roots = scratch.stage(connected_components(first), "star_roots")
    rooted = members.where("n > 2").join(roots, members["sig"] == roots["node"], "left").select("key", "n", "sig", F.coalesce("root", "sig").alias("root"))
    rooted = scratch.stage(rooted, "rooted")
    scratch.drop(buckets, members, sizes, roots)
    several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    mine = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    open_ = rooted.join(several, "key", "left_semi").select("key", "sig", "root", mine.alias("mine"), F.explode(F.sequence(mine, blocks - 1)).alias("block"))
    seats = open_.select("key", "block", F.when(F.col("block") == F.col("mine"), 0).otherwise(1).alias("role"), "sig", "root")
    return first.union(_links(seats, distinct, texts, words, threshold, scratch, "links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, block_rows: int = 512) -> DataFrame:
    """The rows of ``df`` with one row of each component of texts that share ``threshold`` or more of their ``words``-word shingles.

    Candidates are the SimHash classes of ``op6_simhash`` and, for what differs in more bits, MinHash bands. Similarity is the
    exact Jaccard similarity of the sets of shingles, whichever found a pair; components and the row that stays are as in
    ``op6_simhash.keep_one``. Texts with the same shingles count once before anything is compared. Null, blank and empty texts
    have the same (empty) shingle and so are copies of one another, of which one stays. An empty table gives no row. What is
    written on the way is removed, but for ids and roots, which the result reads.
    """
    id_, text, scratch = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), Scratch()
    hashed = F.xxhash64(id_, text)
    marks = by_text(lambda: _marks(words), "struct<sig:bigint,fp:bigint,bands:array<bigint>,minima:binary>", _MARKS)
    marked = scratch.stage(df.select(id_.alias("doc_id"), hashed.alias("hash"), marks(text).alias("m")).select("doc_id", "hash", "m.*"), "shingle_bands")
    least = F.min(F.struct("hash", "fp", "bands", "minima")).alias("l")
    distinct = scratch.stage(marked.groupBy("sig").agg(F.min("doc_id").alias("least"), least).select("sig", "least", "l.*"), "signatures")
    ids = stage(marked.select("doc_id", "hash", "sig"), "near_copy_ids")
    scratch.drop(marked)
    texts = df.select(hashed.alias("hash"), text.alias("text"))
    links = similar_links(distinct.select("sig", "hash", "fp", "bands", "minima"), texts, scratch, words, threshold, block_rows)
    roots = connected_components(links)
    named = distinct.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = stage(named, "roots")
    scratch.drop_all()
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = ids.join(named.join(least, "root").select("sig", "root", "component_id"), "sig")
    return keep_least(df, classes, hashed, id_)
