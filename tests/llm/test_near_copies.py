"""Near copies of the pipeline stage: exact five-word Jaccard similarity against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from skeinwork.llm import near_copies, op6_simhash
from skeinwork.llm.common import Scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def least_of_groups(rows, threshold=0.8):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= threshold * large - 1e-9:
                both = len(sets[a] & sets[b])
                if both >= threshold * (small + large - both) - 1e-9:
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


@pytest.mark.parametrize("block_rows", [512, 3])
def test_edited_copies_and_chains(spark, block_rows):
    rng, rows = np.random.default_rng(7), []
    for g in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for _ in range(9):  # each a little further from the first
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in rng.integers(0, 120, 1 + g % 3).tolist():
                words[at] = f"x{rng.integers(0, 10**6)}"
    rows += [(1000, None), (1001, ""), (1002, "Two words"), (1003, "two  words"), (1004, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in near_copies.keep_one(df, block_rows=block_rows).collect())
    assert got == least_of_groups(rows)


def test_stage_keeps_no_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())
    assert got == least_of_groups(rows)


def test_simhash_classes_are_candidates_and_checked(spark):
    """Without bands, texts of a SimHash class are linked if they are similar, and only then."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join([*words, "end"]), " ".join(f"v{k}" for k in range(400))]
    marks = [near_copies._marks(5)(t) for t in texts]
    fps = [m["fp"] for m in marks]
    assert fps == [op6_simhash.fingerprint_of(t, 5) for t in texts]
    assert all((fps[0] ^ fp).bit_count() <= 2 for fp in fps[1:3])
    # The last text gets the first one's fingerprint: a class is no proof.
    rows = [(m["sig"], k, fp, [], bytes(m["minima"])) for k, (m, fp) in enumerate(zip(marks, [*fps[:3], fps[0]]))]
    distinct = spark.createDataFrame(rows, "sig long, hash long, fp long, bands array<bigint>, minima binary")
    scratch = Scratch()
    found = near_copies.similar_links(distinct, spark.createDataFrame(list(enumerate(texts)), "hash long, text string"), scratch)
    linked = {frozenset(r) for r in found.collect()}
    ends = {s for pair in linked for s in pair}
    assert ends == {m["sig"] for m in marks[:3]} and len(linked) >= 2
    scratch.drop_all()
