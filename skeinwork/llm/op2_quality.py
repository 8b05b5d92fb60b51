"""Quality rules: text statistics, fixed base rules, and robust outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import by_text, fresh, null_safe_key, stage

STATISTICS = ["log_words", "log_word_length", "log_symbols", "upper_share", "log_marks", "log_distinct"]
P = len(STATISTICS)
# Standard deviations below these count as these: what a statistic can differ by without meaning anything.
FLOORS = np.array([0.25, 0.05, 0.5, 0.05, 0.25, 0.01])
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_RESULT = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("x", pa.list_(pa.float64()))])
_RETURNS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,x:array<double>>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_MARK = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS])
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
# Odd multipliers of the window hash; windows that it calls equal are compared by their words.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words which the text has twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += mixed[k : k + n] * _FACTORS[k]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    found = Counter(tuple(ids[i : i + window].tolist()) for i in at.tolist())
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if found[tuple(ids[i : i + window].tolist())] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics_of(text: str) -> dict:
    """Base counts and the transformed statistic vector of a text; a text without words has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, copies = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            copies += bool(line.strip())
        else:
            seen.add(line)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(words)
    chars = int(count.sum() - count[_SPACE].sum() - count[0x80:0xC0].sum())
    symbols, upper, lower = int(count[_SYMBOL].sum()), int(count[65:91].sum()), int(count[97:123].sum())
    x = [0.0] * P
    if n:
        x = [
            float(np.log1p(n)), float(np.log(max(chars, 1) / n)), float(np.log1p(100 * symbols / n)), float(np.arcsin(np.sqrt(upper / max(1, upper + lower)))),
            float(np.log1p(100 * count[_MARK].sum() / n)), float(np.log(len(set(words))) / np.log(n)) if n > 1 else 1.0,
        ]
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": copies, "n_repeat_words": repeated_words(words), "x": x}


def statistics(column: Column) -> Column:
    """Struct of base counts and vector ``x`` of a text column; null is the empty text."""
    return by_text(lambda: statistics_of, _RETURNS, _RESULT)(column)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def chi_square_quantile(q: float, df: int = P) -> float:
    """By bisection on the series of the incomplete gamma function."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, h = df / 2, x / 2
        term = total = 1 / a
        k = 1
        while term > total * 1e-15:
            term *= h / (a + k)
            total, k = total + term, k + 1
        return total * exp(-h + a * log(h) - lgamma(a))

    low, high = 1e-9, 1e4
    while high - low > 1e-9 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return high


def _distance(x: str, center: str, whiten: str) -> Column:
    """Squared Mahalanobis distance: the squared length of ``whiten`` (rows behind each other) times (x - center)."""
    rows = []
    for i in range(P):
        row = sum(((F.col(x)[j] - F.col(center)[j]) * F.col(whiten)[i * P + j] for j in range(P)), F.lit(0.0))
        rows.append(row * row)
    return sum(rows, F.lit(0.0))


def _whiten(cov: np.ndarray) -> tuple[list[float], float]:
    """Rows w with |w (x - c)|^2 the squared distance under ``cov``, floored, and the log determinant."""
    scaled = cov / np.outer(FLOORS, FLOORS)
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    values = np.maximum(values, 1.0)
    return (vectors / np.sqrt(values)).T.dot(np.diag(1 / FLOORS)).ravel().tolist(), float(np.log(values).sum())


def _moments(prefix: str = "x") -> list[Column]:
    first = F.array(*[F.sum(F.col(prefix)[i]) for i in range(P)]).alias("s1")
    second = F.array(*[F.sum(F.col(prefix)[i] * F.col(prefix)[j]) for i in range(P) for j in range(i, P)]).alias("s2")
    return [F.count("*").alias("n"), first, second]


def _mean_cov(n: int, s1: list, s2: list) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = np.array(s1) / n, np.zeros((P, P))
    cov[np.triu_indices(P)] = np.array(s2) / n
    cov = cov + np.triu(cov, 1).T
    return mean, cov - np.outer(mean, mean)


_FIT = "key string, start int, center array<double>, whiten array<double>, log_det double"


def _estimate(moments: DataFrame) -> DataFrame:
    """Center, whitening and log determinant from a row of moments per key and start."""

    def run(frames):
        for f in frames:
            out = f[["key", "start"]].copy()
            fits = [(m, *_whiten(c)) for m, c in (_mean_cov(*r) for r in zip(f["n"], f["s1"], f["s2"], strict=True))]
            out["center"], out["whiten"], out["log_det"] = [m.tolist() for m, _, _ in fits], [w for _, w, _ in fits], [d for _, _, d in fits]
            yield out

    return moments.mapInPandas(run, _FIT)


def _initial(rows: DataFrame) -> DataFrame:
    """Three deterministic starts per key around the medians: by median deviations alone, by correlations of the hyperbolic
    tangents, and by the covariance of the signs (directions)."""
    key = ["key"]
    median = rows.groupBy("key").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 10_000) for i in range(P)]).alias("median"))
    away = rows.join(stage(median, "medians"), key).select("key", "median", *[F.abs(F.col("x")[i] - F.col("median")[i]).alias(f"a{i}") for i in range(P)], "x")
    spread = away.groupBy("key", "median").agg(F.array(*[F.greatest(1.4826 * F.percentile_approx(f"a{i}", 0.5, 10_000), F.lit(float(FLOORS[i]))) for i in range(P)]).alias("spread"))
    spread = stage(spread, "spreads")
    z = rows.join(spread, key).select("key", "median", "spread", F.array(*[(F.col("x")[i] - F.col("median")[i]) / F.col("spread")[i] for i in range(P)]).alias("z"))
    length = F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(P)), F.lit(0.0)))
    both = F.array(F.struct(F.lit(1).alias("start"), F.array(*[F.tanh(F.col("z")[i]) for i in range(P)]).alias("x")),
                   F.struct(F.lit(2).alias("start"), F.array(*[F.col("z")[i] / F.greatest(length, F.lit(1e-9)) for i in range(P)]).alias("x")))
    parts = z.select("key", "median", "spread", F.inline(both))
    moments = parts.groupBy("key", "start").agg(F.first("median").alias("median"), F.first("spread").alias("spread"), *_moments())

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for key, start, median, spread, n, s1, s2 in f[["key", "start", "median", "spread", "n", "s1", "s2"]].itertuples(index=False):
                spread, cov = np.array(spread), _mean_cov(n, s1, s2)[1] + 1e-6 * np.eye(P)
                corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
                for s, c in ((start, corr), *([(0, np.eye(P))] if start == 1 else [])):
                    out.append((key, s, list(median), *_whiten(c * np.outer(spread, spread))))
            yield pd.DataFrame(out, columns=["key", "start", "center", "whiten", "log_det"])

    return moments.mapInPandas(run, _FIT)


def _concentrate(rows: DataFrame, fits: DataFrame, share: float) -> DataFrame:
    """A C-step: estimates from the ``share`` of each key's rows that are nearest under the last estimates."""
    near = rows.join(fits, "key").select("key", "start", _distance("x", "center", "whiten").alias("d"))
    limits = near.groupBy("key", "start").agg(F.percentile_approx("d", share, 10_000).alias("limit"))
    # Written, so that Spark knows the size of what meets the rows: they are not shuffled while it can be broadcast.
    bounded = stage(fits.join(limits, ["key", "start"]), "limits")
    inner = rows.join(bounded, "key").where(_distance("x", "center", "whiten") <= F.col("limit")).select("key", "start", "x")
    return stage(_estimate(inner.groupBy("key", "start").agg(*_moments())), "mcd")


def fit(rows: DataFrame, share: float = 0.75, steps: int = 3, inlier: float = 0.975) -> DataFrame:
    """``key``, ``center``, ``whiten`` of each key of ``rows`` (``key``, vector ``x``).

    All rows of a key take part. Two C-steps from three starts, the least determinant goes on for ``steps`` more. The scatter
    is scaled so that the median distance is that of the normal distribution, the rows within its ``inlier`` quantile give the
    estimates once more (reweighting), and these are scaled the same way. Each step is an aggregation with partial sums in
    front of the shuffle; hot keys are not gathered anywhere. Quantiles are sketches of bounded size with a rank error of
    1/10,000. Estimates are a row per key, written to the shared folder after every step.
    """
    fits = stage(_initial(rows), "mcd")
    for _ in range(2):
        fits = _concentrate(rows, fits, share)
    best = fits.groupBy("key").agg(F.min_by(F.struct("start", "center", "whiten", "log_det"), F.struct("log_det", "start")).alias("b")).select("key", "b.*")
    for _ in range(steps):
        best = _concentrate(rows, best, share)
    middle, edge = chi_square_quantile(0.5), chi_square_quantile(inlier)

    def scaled(fits: DataFrame) -> DataFrame:
        near = rows.join(fits, "key").select("key", _distance("x", "center", "whiten").alias("d"))
        size = near.groupBy("key").agg(F.greatest(F.percentile_approx("d", 0.5, 10_000) / middle, F.lit(1e-6)).alias("size"))
        wide = F.transform("whiten", lambda w: w / F.sqrt(F.greatest(F.col("size"), F.lit(1.0))))
        return fits.join(size, "key").select("key", "start", "center", wide.alias("whiten"), "log_det")

    best = stage(scaled(best), "mcd")
    inner = rows.join(best, "key").where(_distance("x", "center", "whiten") <= edge).select("key", "start", "x")
    best = stage(_estimate(inner.groupBy("key", "start").agg(*_moments())), "mcd")
    return stage(scaled(best), "mcd").select("key", "center", "whiten")


def judge(df: DataFrame, text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), certainty: float = 1 - 1e-9, least_rows: int = 200, names: tuple[str, str] = ("quality", "kept"), keep_text: bool = True) -> DataFrame:
    """``df`` with a struct of statistics (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``x``,
    ``base_failed``, ``distance``) and a boolean: neither the base rules nor the distance reject the row.

    Distances are to the estimates of the row's language and source, over all rows that pass the base rules. Sources with
    fewer than ``least_rows`` such rows are pooled per language, languages with fewer in all; a table with fewer has one pool.
    A row is rejected when its squared distance is beyond the ``certainty`` quantile of the chi-square distribution. Nulls in
    the group columns are groups of their own; null and blank texts have zero counts and fail the base rules. Rows keep their
    columns, repeats and order of columns; an empty table gives no rows. The statistics are computed once and staged with
    the row in the shared folder; without ``keep_text`` the text is neither staged nor returned.
    """
    stats, kept, group, lang = fresh(df.columns, names[0]), fresh(df.columns, names[1]), fresh(df.columns, "mcd_group"), fresh(df.columns, "mcd_lang")
    staged = df.withColumn(stats, statistics(F.col(f"`{text_col}`").cast("string")))
    staged = staged.withColumns({group: null_safe_key(*[f"`{c}`" for c in group_cols]), lang: null_safe_key(f"`{group_cols[0]}`")})
    if not keep_text:
        staged = staged.drop(text_col)
    staged = stage(staged, "statistics")
    failed = base_failed(F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words"))
    fine = staged.where(~failed).select(group, lang, F.col(f"{stats}.x").alias("x"))

    groups = staged.groupBy(group, lang).agg(F.count(F.when(~failed, 1)).alias("n"))
    groups = stage(groups, "groups")
    small = groups.where(F.col("n") < least_rows).groupBy(lang).agg(F.sum("n").alias("pooled"))
    keys = groups.join(small, lang, "left").select(
        F.col(group), F.when(F.col("n") >= least_rows, F.concat(F.lit("g"), group)).when(F.col("pooled") >= least_rows, F.concat(F.lit("l"), lang)).otherwise(F.lit("a")).alias("key"))
    keys = stage(keys, "keys")
    rows = fine.join(keys, group).select("key", "x")
    fits = fit(rows)
    by_group = stage(keys.join(fits, "key", "left").select(F.col(group).alias("_group"), "center", "whiten"), "fits")
    limit = chi_square_quantile(certainty)
    out = staged.join(by_group, F.col(group) == F.col("_group"), "left")
    distance = _distance(f"{stats}.x", "center", "whiten")
    out = out.withColumn(stats, F.col(stats).withField("base_failed", failed).withField("distance", distance))
    out = out.withColumn(kept, ~failed & (F.coalesce(distance, F.lit(0.0)) <= limit))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if keep_text or c != text_col], stats, kept)
