"""Operators that judge documents one by one: tokens, token files, packing, licenses, containment, urls, shards."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skeinwork.llm import op1_licenses, op3_packing, op4_decontamination, op5_shards, op7_token_counts, op9_urls, op10_token_files
from skeinwork.llm.encode import ChunkEncoder

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, Rank long, start string, fp string, tokens string"
ODD = [
    "", " ", "\n", "a", "plain words here", "two  spaces and\ttab", "line\nline\n\nline", " leading", "trailing ", "don't we'll it's",
    "<|endoftext|> special", "Größe: 12,5 km² über Ñandú, çà et là!", "東京 テスト 한국어", "\u2581 mark", "a\u00a0b \u00a0c", "x\n y \nz", "\ufb01 ligature", "\0nul \0 x",
    "word " * 3000 + "end", "nospace" * 3000, "<s> not special </s>", "emoji 😀😀 \U0001f469\u200d\U0001f469", "A.B,C;D (e) [f]", "\r\n windows\r\nlines",
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "f", "t") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null text, a null id, and a repeated row; other columns have the operators' own names."""
    return table(spark, [*enumerate(ODD), (100, None), (None, "no id"), (3, "a"), (3, "a")])


def library_ids(text, end):
    return np.array([*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_chunks_are_the_library(spark):
    enc, lib = ChunkEncoder(BPE, cache_words=3), Tokenizer.from_file(BPE)
    texts = [*ODD, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_piece_counts_are_the_library(spark, odd):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = op7_token_counts.counts(odd, PIECES, limit=2, table_size=3).collect()
    assert len(got) == odd.count()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2) for r in got)
    assert op7_token_counts.counts(odd.limit(0), PIECES).count() == 0


def test_frequent_words_are_counted_over_all_texts(spark):
    df = table(spark, [(k, "a a\na" + " b" * (k == 0)) for k in range(10)]).repartition(4)
    assert [(r.word, r.n) for r in op7_token_counts.frequent_pre_tokens(df, size=2).collect()] == [("a", 20), ("\na", 10)]


def check_pieces(rows, docs, size):
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 > 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(seen[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    return sequences


def test_packing_whole_and_without_padding(spark, odd):
    rows = op3_packing.pack(odd.where("doc_id is null or doc_id <> 3"), BPE, size=64).collect()
    docs = {r.doc_id: library_ids(r.text, 1) for r in odd.where("doc_id is null or doc_id <> 3").collect()}
    check_pieces(rows, docs, 64)
    repeats = op3_packing.pack(odd.where("doc_id = 3"), BPE).collect()
    assert sum(r.length for r in repeats) == 3 * 2
    assert op3_packing.pack(odd.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        op3_packing.pack(odd, BPE, size=100)


def brute_level(counts, size, length):
    """Level whose choice minimises the sum of squared counts, the fullest of equal ones."""
    best = None
    for level in range(size - length, -1, -1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + length < size:
            after[level + length] += 1
        value = sum(x * x for x in after[1:size])
        if best is None or value < best[0]:
            best = (value, level, after)
    return best[1], best[2]


def test_sum_of_squares_choices():
    rng = np.random.default_rng(5)
    packer, counts = op3_packing.SumOfSquares(32), [0] * 33
    for length in rng.integers(1, 32, 400).tolist():
        level, counts = brute_level(counts, 32, length)
        assert packer.place(length)[1] == level
        assert packer.counts[1:32].tolist() == counts[1:32]


def test_token_files_round_trip(spark, odd):
    path = op10_token_files.work_dir(spark, "tokens-test")
    op10_token_files.write_tokens(odd, path, BPE)
    files = op10_token_files.TokenFiles(spark, path)
    got = files.digest().collect()
    assert len(got) == odd.count()
    docs = sorted(((-1 if r.doc_id is None else r.doc_id, library_ids(r.text, 0)) for r in odd.collect()), key=lambda x: x[0])
    at, want = 0, []
    for doc, ids in docs:
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert sorted(r.start for r in files.metadata().collect()) == sorted(w[1] for w in want)
    one = files.tokens(ids=[11]).collect()
    assert [r.tokens for r in one] == [library_ids(ODD[11], 0).tolist()]
    assert {r.doc_id for r in files.tokens(first=5, last=7).collect()} == {5, 6, 7}
    span = files.spans(spark.createDataFrame([(11, 2, 3)], "doc_id long, start long, length long")).collect()
    assert span[0].tokens == library_ids(ODD[11], 0).tolist()[2:5]
    plan = files.metadata()._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    assert op10_token_files.write_and_read(odd.limit(0), BPE).count() == 0


def test_token_files_layout(spark):
    import glob

    import pyarrow.parquet as pq

    path = op10_token_files.work_dir(spark, "tokens-layout")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    op10_token_files.write_tokens(docs.repartition(4), path, BPE, row_group_bytes=1 << 18)
    ranges = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            ids, tokens = meta.row_group(g).column(0), meta.row_group(g).column(2)
            assert "DELTA_BINARY_PACKED" in ids.encodings and "RLE_DICTIONARY" in tokens.encodings
            assert ids.has_column_index and ids.has_offset_index
            ranges.append((ids.statistics.min, ids.statistics.max))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_patience_alignment():
    assert op1_licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    text, template = "x the a b y the c z".split(), "the a b the c".split()
    assert op1_licenses.align(text, template) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([f"w{k}" for k in rng.integers(0, 12, n)] for n in rng.integers(0, 15, 2))
        pairs = op1_licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_license_scan(spark):
    mit = op1_licenses.TEMPLATES["mit"]
    changed = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    rows = [
        (1, f"some text {mit} more text"), (2, f"{'filler word ' * 5000}{changed}"), (3, "All rights reserved. x All rights reserved."),
        (4, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (5, "nothing here"), (6, None), (7, ""), (None, "ALL RIGHTS RESERVED"),
        (8, "rights " * 3000), (5, "all   rights\nreserved!"),
    ]
    got = sorted((str(r.doc_id), r.license, r.start) for r in op1_licenses.scan(table(spark, rows)).collect())
    assert got == sorted([
        ("1", "mit", 2), ("2", "mit", got[1][2]), ("3", "all-rights-reserved", 0), ("3", "all-rights-reserved", 4), ("4", "apache-notice", 0),
        ("4", "cc-by-nc-notice", 8), ("5", "all-rights-reserved", 0), ("None", "all-rights-reserved", 0)])
    assert op1_licenses.scan(table(spark, rows).limit(0)).count() == 0


def test_license_scan_finds_what_exhaustive_windows_find(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    scanner = op1_licenses.Scanner(op1_licenses.TEMPLATES, 0.8)
    short = [t for t in scanner.templates if len(t.words) < 15]
    for text in docs:
        words = op1_licenses.words_of(text)
        want = {t.name for t in short for k in range(len(words)) if set(words[k : k + len(t.words) + 2]) >= set(t.words) and len(op1_licenses.align(words[k : k + len(t.words) + 2], t.words)) == len(t.words)}
        # Notices that are a part of a longer one give way to it.
        assert want <= {f["license"] for f in scanner.scan(text)} | {"apache-notice", "cc-by-notice"}


def brute_contained(docs, items, threshold=0.8):
    def shingles(t):
        w = op4_decontamination.words_of(t or "")
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in dict.fromkeys(items)]
    return sorted((str(d), i, len(s & shingles(t)), len(s)) for d, t in docs for i, s in sets if s and len(s & shingles(t)) >= threshold * len(s) - 1e-9)


def test_containment_is_that_of_brute_force(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 4000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 7, 8, 12, 16, 20, 33, 64, 100, 150] * 4)]
    docs = []
    for d in range(150):
        words = [word() for _ in range(int(rng.integers(0, 1500)))]
        for _ in range(int(rng.integers(0, 3))):
            part = items[int(rng.integers(0, len(items)))][1].split()
            part = [w if rng.random() > 0.02 else "changed" for w in part]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = part
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words)))
    docs += [(900, None), (901, ""), (902, "w1 w2"), (None, items[8][1]), (903, items[8][1] + " " + items[8][1]), (904, items[3][1]), (904, items[3][1])]
    items += [(500, None), (501, "too short here"), (502, ""), items[0], (0, items[1][1])]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.n_shared, r.n_shingles) for r in op4_decontamination.find_contained(table(spark, docs), item_df).collect())
    assert got == brute_contained(docs, items)
    kept = op4_decontamination.drop_contaminated(table(spark, docs), item_df)
    bad = {r[0] for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if str(d) not in bad)
    assert kept.columns == table(spark, docs[:1]).columns
    assert op4_decontamination.find_contained(table(spark, docs), item_df.limit(0)).count() == 0
    assert op4_decontamination.find_contained(table(spark, docs).limit(0), item_df).count() == 0


def test_containment_in_blocks(spark):
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(20)], "item_id long, text string")
    blocks = op4_decontamination.item_blocks(items, block_bytes=100)
    assert len(blocks) > 1 and sorted(i for b in blocks for _, i, _ in b) == list(range(20))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [h + p for h, p, _ in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules_and_parts(spark):
    urls = [
        None, "", "abc", "http://A.Example.COM/en/71?x#y", "https://example.com/en/8", "https://notexample.com/en/7", "ftp://com/en/", "http://x.net/de/8", "http://example.net/de/81",
        "http://b.example.net?de/8", "x://y.org#/es/", "x://y.org/es/?q://z.com/en/", "http://ÀB.com/en/ü", "http://user:pw@h.com:80/en/1\n2", "http://", "://a.com/en/",
        *(r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()),
    ]
    df = spark.createDataFrame([(k, u, 0.5, "x") for k, u in enumerate(urls)] + [(None, "http://a.com/en/", 0.1, "y")], "page_id long, url string, score double, features string")
    got = op9_urls.judge(df, RULES, op9_urls.UrlModel(op9_urls.labelled_table(spark))).collect()
    assert len(got) == len(urls) + 1
    verdicts = {h + p: v for h, p, v in RULES}
    for r in got:
        host, path, rule = brute_url(urls[r.page_id] if r.page_id is not None else "http://a.com/en/")
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdicts[rule] if rule else "block" if r.score >= 0.5 else "allow")


def test_url_model_on_hosts_it_has_not_seen(spark):
    bad = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = op9_urls.judge(pages, [], op9_urls.UrlModel(op9_urls.labelled_table(spark))).collect()
    right = sum((r.verdict == "block") == any(b in r.host for b in bad) for r in got)
    assert right / len(got) > 0.99
    with pytest.raises(ValueError):
        op9_urls.rule_for(None, None, [("a", "/", "allow")] * 2)


def test_url_plan_is_native(spark):
    df = op9_urls.judge(spark.createDataFrame([(1, "http://a.com")], "page_id long, url string"), RULES, op9_urls.UrlModel(op9_urls.labelled_table(spark)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_shard_table():
    names = [f"s{k}" for k in range(40)]
    owner = op5_shards.fill_table(names, 4001)
    sizes = np.bincount(owner)
    assert sizes.min() > 0 and sizes.max() - sizes.min() <= 1
    fewer = op5_shards.fill_table(names[:-1], 4001)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 39)
    assert moved < 0.1 * 4001
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            op5_shards.fill_table(bad, 11)
    with pytest.raises(ValueError):
        op5_shards.fill_table(["a"], 10)


def test_shard_table_by_turns():
    """The definition itself, with whole preference lists."""
    import hashlib

    names, slots = ["b", "a", "c"], 13
    lists = {}
    for n in names:
        d = hashlib.md5(n.encode()).hexdigest()
        first, step = int(d[:15], 16) % slots, int(d[15:30], 16) % (slots - 1) + 1
        lists[n] = [(first + k * step) % slots for k in range(slots)]
    owner: dict = {}
    while len(owner) < slots:
        for n in sorted(names):
            free = [s for s in lists[n] if s not in owner]
            if free:
                owner[free[0]] = n
    assert [names[k] for k in op5_shards.fill_table(names, slots)] == [owner[s] for s in range(slots)]


def test_shard_placement(spark):
    rows = [(k, "t") for k in range(500)] + [(None, "x"), (None, "y"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1, "old") for i, t in rows], "doc_id long, text string, slot int, Shard string")
    got = op5_shards.place(df, "doc_id", ["a", "b", "c"], slots=101).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "slot", "shard"}
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values()) and {r.shard for r in got} == {"a", "b", "c"}
    assert op5_shards.place(df.limit(0), "doc_id", ["a"], slots=2).count() == 0
