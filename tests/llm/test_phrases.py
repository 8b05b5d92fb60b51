"""Phrase collocations against counts of all n-grams."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import op12_phrases as op

MIDDLE = "/root/testdata/sf0.01"


def brute(rows, longest, least, top, share=100):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    out = []
    for lang in totals:
        found = []
        phrases = {w: a for (g, w), a in counts.items() if g == lang and a >= least and len(w) > 1}
        for w, a in phrases.items():
            cuts = [(1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if any(len(v) > len(w) and 100 * b >= share * a and any(v[j : j + len(w)] == w for j in range(len(v) - len(w) + 1)) for v, b in phrases.items()):
                continue
            found.append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(df, **kwargs):
    found = op.collocations(df, **kwargs)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = brute(rows, 5, 100, 2000)
    assert want and got(docs) == want


@pytest.mark.parametrize("longest,least,top,share", [(5, 3, 50, 100), (3, 2, 10, 60), (2, 2, 1000, 100), (6, 4, 7, 80)])
def test_odd_texts(spark, longest, least, top, share):
    rng = random.Random(3)
    words = ["a", "B", "É", "x-1", "the", "　", "zz"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", ";"]) for _ in range(40))) for _ in range(60)]
    rows += [(None, None), ("en", ""), ("en", " . , "), ("fr", "a a a a a a a a a a"), ("en", rows[0][1]), ("xx", "one two")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n long")
    assert got(df, longest=longest, least=least, top=top, share=share) == brute(rows, longest, least, top, share)


def test_a_very_long_text_and_a_common_pair(spark):
    rows = [("en", "very common words " * 30_000), ("en", "very common " * 1000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(df, least=100, top=20) == brute(rows, 5, 100, 20)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "lang string, text string")) == []


def test_scores_beyond_64_bits(spark):
    row = dict(a=10**12 + 7, n=9 * 10**15 + 1, l=10**14 + 3, r=10**13 + 9)
    expr = "bigint(1000 * (cast(a AS decimal(17,0)) * cast(n AS decimal(17,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0))))"
    df = spark.createDataFrame([tuple(row.values())], "a long, n long, l long, r long")
    assert df.select(F.expr(expr)).first()[0] == 1000 * row["a"] * row["n"] // (row["l"] * row["r"])
