"""Operators that look at many documents together: outliers, near duplicates, toxicity; and the pipeline."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skeinwork.llm import op2_quality, op6_simhash, op8_toxicity, queries
from skeinwork.llm.common import stage
from skeinwork.llm.components import connected_components

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# Quality -------------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    lines, copies = [], 0
    for line in (text or "").split("\n"):
        copies += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
        lines.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), copies, len(covered)


def test_statistics_are_those_of_brute_force(spark):
    odd = ["", None, " ", "\n\n", "a", "a b c d e f g h a b c d e f g h", "a " * 30, "x y  z", "l1\nl1\n \n \nl1 ", "#$ <tag> & ü|", "1 2 3 4 5 6 7 8 9 " * 3, "w " * 7 + "\n" + "w " * 9]
    texts = odd + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.select("id", op2_quality.statistics(F.col("text")).alias("s")).collect():
        s = r.s
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_statistics(texts[r.id]), texts[r.id]


def test_repeats_in_a_very_long_text():
    words = [str(k) for k in range(30_000)]
    assert op2_quality.repeated_words(words) == 0
    assert op2_quality.repeated_words(words + words[100:110]) == 20
    assert op2_quality.repeated_words(["a"] * 9) == 9 and op2_quality.repeated_words(["a"] * 8) == 0


def test_chi_square_quantiles():
    assert op2_quality.chi_square_quantile(0.5, 2) == pytest.approx(2 * np.log(2), rel=1e-6)
    assert op2_quality.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, rel=1e-4)


def brute_mcd(x, share, starts=200):
    """Least covariance determinant over random starts, with the operator's floors."""
    rng, best = np.random.default_rng(0), None
    h = int(np.ceil(share * len(x)))
    f = op2_quality.FLOORS
    for _ in range(starts):
        part = x[rng.choice(len(x), op2_quality.P + 1, replace=False)]
        for _ in range(25):
            mean, cov = part.mean(axis=0), np.cov(part.T, bias=True)
            w, det = op2_quality._whiten(cov)
            d = (((x - mean) @ np.array(w).reshape(op2_quality.P, -1).T) ** 2).sum(axis=1)
            part = x[np.argsort(d, kind="stable")[:h]]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best


def test_estimates_are_near_those_of_random_starts(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(6, 6)) + 2 * np.eye(6)
    clean = rng.normal(size=(1600, 6)) @ mix.T + 5
    junk = rng.normal(size=(400, 6)) * 0.3 + 40
    x = np.vstack([clean, junk])
    rows = spark.createDataFrame([("k", r.tolist()) for r in x], "key string, x array<double>").repartition(5)
    fit = op2_quality.fit(rows).collect()[0]
    w = np.array(fit.whiten).reshape(6, 6)
    d = (((x - np.array(fit.center)) @ w.T) ** 2).sum(axis=1)
    assert np.abs(np.array(fit.center) - clean.mean(axis=0)).max() < 0.35
    assert (d[:1600] <= op2_quality.chi_square_quantile(1 - 1e-6)).all() and d[1600:].min() > 100
    _, mean, _ = brute_mcd(x, 0.75, 20)
    assert np.abs(mean - np.array(fit.center)).max() < 0.5


def test_quality_judges_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op2_quality.judge(docs, names=("s", "kept")).join(labels, "doc_id").where("not s.base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.995
    assert n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0)) > 0.95


def test_quality_cases(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, long, None, None, 1), (3, long, None, None, 1), (None, long, "en", "b", 1), (4, "few words", "en", "b", 1), (5, "x " * 100_000, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Quality int")
    got = op2_quality.judge(df, names=("quality", "kept"))
    assert got.columns == [*df.columns, "_quality", "kept"]
    assert sorted((str(r.doc_id), r.kept) for r in got.collect()) == sorted([("1", False), ("2", False), ("3", True), ("3", True), ("None", True), ("4", False), ("5", False)])
    assert op2_quality.judge(df.limit(0)).count() == 0


# Near duplicates -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def roots_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    odd = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "One"), (10_004, "one"), (10_005, "one two"), (10_006, "É a É b"), (10_007, "é a é b"), (10_008, "long text " * 20_000), (10_008, "long text " * 20_000)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    rng, near = np.random.default_rng(1), []
    for k, (_, t) in enumerate(docs[:60]):
        words = t.split(" ")
        words[int(rng.integers(0, len(words)))] = "altered"
        near.append((20_000 + k, " ".join(words)))
    rows = docs + odd + near
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = op6_simhash.dedup_ids(df).collect()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[k], ids[k + 1 + j]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2)]
    roots = roots_of(ids, pairs)
    assert any(prints[a] != prints[b] for a, b in pairs)
    for r in got:
        assert (r.fp % 2**64, r.component_id) == (prints[r.doc_id], roots[r.doc_id])
    kept = op6_simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots.values()))
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp"}


@pytest.mark.parametrize("parts,tile_rows", [(4, 1 << 16), (4, 7), (8, 5), (2, 50)])
def test_links_are_those_of_all_pairs(spark, parts, tile_rows):
    rng = np.random.default_rng(parts * 100 + tile_rows)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    fps = [0, 2**64 - 1, 1, 3, 7, 15, 31, *base.tolist()]
    for b in base.tolist()[:80]:  # chains and dense clusters around each
        for _ in range(int(rng.integers(1, 12))):
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                b ^= 1 << bit
            fps.append(b)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    got = [(r.u, r.v) for r in op6_simhash.fingerprint_links(df, 2, parts, tile_rows).collect()]
    values = np.array(fps, np.int64).view(np.uint64)
    want = [(fps[k], fps[k + 1 + j]) for k in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2)]
    assert roots_of(fps, got) == roots_of(fps, want)
    assert len(got) < 25 * len(fps)


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    loose = [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (400, 2))]
    links = [*chain, *star, *loose, (5000, 5000), (3, 2), (2, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert got == roots_of(sorted({n for p in links for n in p}), links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_cases(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "q r s t"), (5, "q r s t"), (5, "zz yy xx ww"), (6, "q r s t"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in op6_simhash.keep_one(df).collect())
    assert kept == sorted([("None", "a b c"), ("5", "q r s t"), ("5", "zz yy xx ww"), ("7", None)], key=str)
    assert op6_simhash.dedup_ids(df.limit(0)).count() == 0 and op6_simhash.keep_one(df.limit(0)).count() == 0


# Toxicity ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer(spark):
    return op8_toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_toxicity_on_held_out_labels(spark, scorer):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = docs.select("doc_id", op8_toxicity.score(F.col("text"), scorer, spark).alias("p")).join(labels, "doc_id")
    n = {(r.toxic, r.hit): r["count"] for r in scored.where(op8_toxicity.held_out(F.col("doc_id"))).groupBy("toxic", (F.col("p") >= 0.3).alias("hit")).count().collect()}
    # Some labels of these tables are on texts without any such word, and some clean texts have one by chance.
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.92
    assert n[(0, False)] / (n[(0, False)] + n.get((0, True), 0)) > 0.94


def test_obfuscated_words_are_restored(scorer):
    model = scorer.log_probs()
    for written, word in {
        "1d10t": "idiot", "i d i o t": "idiot", "s.c.u.m": "scum", "l0s3r": "loser", "stuuupid": "stupid", "$tupid": "stupid", "m 0 r 0 n": "moron", "iiddiioott": "idiot",
        "p4thet1c": "pathetic", "w.o.r.t.h.l.e.s.s": "worthless", "cl0wn!!": "clown", "tr@sh": "trash", "D-i-s-g-u-s-t-i-n-g": "disgusting",
    }.items():
        text = f"the and {written} of the"
        assert word in scorer.words_of(text), (written, op8_toxicity.restore(text, model))
        assert scorer.score(text) >= 0.3 > scorer.score("the and of the")
    plain = "The price was 25 or 30, mail a.b@example.com at 10:45 (see x2). Über 1.000 €!"
    assert scorer.score(plain) < 0.3
    assert op8_toxicity.restore("no marks here", model) == "no marks here"


def brute_decode(span, model):
    """Best of all paths through the lattice."""
    paths = [((0, 0), 0.0, "")]
    for choices in op8_toxicity.lattice(span):
        after = []
        for (a, b), score, text in paths:
            for symbol, letter, cost in choices:
                if symbol is None:
                    after.append(((a, b), score + cost, text))
                else:
                    after.append(((b, symbol), score + cost + model[(a * 64 + b) * 64 + symbol], text + letter))
        paths = after
    return max(s + model[(a * 64 + b) * 64] for (a, b), s, _ in paths)


def path_score(span, text, model):
    return max((s for t, s in _all_texts(span, model) if t == text))


def _all_texts(span, model):
    paths = [((0, 0), 0.0, "")]
    for choices in op8_toxicity.lattice(span):
        paths = [
            ((a, b), s + c, t) if y is None else ((b, y), s + c + model[(a * 64 + b) * 64 + y], t + x) for (a, b), s, t in paths for y, x, c in choices
        ]
    return [(t, s + model[(a * 64 + b) * 64]) for (a, b), s, t in paths]


def test_viterbi_finds_the_best_path(scorer):
    model = scorer.log_probs()
    for span in ("1d10t", "i d 1 o t", "aa11ss", "s.c.u.m", "x@y", "ooo", "t3eest", "é1é", "7", "a-b-c"):
        assert path_score(span, op8_toxicity.decode(span, model), model) == pytest.approx(brute_decode(span, model), abs=1e-6)


def test_trigrams_cover_all_texts(spark):
    df = spark.createDataFrame([(1, "Ab a"), (2, None), (3, ""), (4, "ab")], "doc_id long, text string").repartition(3)
    got = {r.code: r.n for r in op8_toxicity.trigram_counts(df).collect()}
    code = lambda a, b, c: (a * 64 + b) * 64 + c
    assert got == {code(0, 0, 1): 2, code(0, 1, 2): 2, code(1, 2, 0): 2, code(2, 0, 1): 1, code(0, 1, 0): 1}


def test_toxicity_cases(spark):
    rows = [(1, "fine words"), (2, None), (3, ""), (None, "no id"), (1, "fine words"), (4, "x" * 200_000), (5, "1" * 50_000), (6, "a b " * 20_000), (7, "퟿\U0001f600 ok")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, toxicity int")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (2, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = op8_toxicity.score_all(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = op8_toxicity.keep_clean(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert op8_toxicity.score_all(docs, labels.limit(0)).count() == len(rows)
    assert op8_toxicity.score_all(docs.limit(0), labels).count() == 0


# Pipeline ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    rows, out = spark.read.parquet(f"{MIDDLE}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        before = rows
        rows = stage(function(spark, rows, MIDDLE), name)
        out.append((name, before, rows))
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert after.count() < before.count() and after.exceptAll(before).count() == 0


def five_words(text):
    words = text.encode().lower().split()
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))]


def test_stages_decide_as_their_operators(spark, stages):
    by = {name: (b, a) for name, b, a in stages}
    before, after = by["near_duplicates"]
    rows = [(r.doc_id, set(five_words(r.text))) for r in before.select("doc_id", "text").collect()]
    pairs = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(set(roots_of([i for i, _ in rows], pairs).values()))
    before, after = by["toxicity"]
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    left = after.join(labels, "doc_id").agg(F.sum("toxic"), F.count("*")).first()
    assert left[0] <= 14 and left[1] >= 330
    before, after = by["quality"]
    assert after.join(labels, "doc_id").agg(F.avg("quality")).first()[0] > 0.98


def test_packing_holds_every_document(stages):
    _, before, after = stages[-1]
    assert after.select("doc_id").distinct().count() == before.count()
    total = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m")
    assert total.count() == 0


def test_run_is_the_stages_in_turn(spark, stages):
    cols = ["doc_id", "start", "length", "doc_tokens"]
    got = corpus_pipeline.run(spark, MIDDLE).groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = stages[-1][2].groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert set(cols) <= set(stages[-1][2].columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stages_take_empty_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("Score", F.lit(1))
    for rows in (docs.limit(0), docs.limit(30)):
        for _, function in corpus_pipeline.STAGES[:-1]:
            rows = stage(function(spark, rows, SMALL), "extra")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() >= 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
