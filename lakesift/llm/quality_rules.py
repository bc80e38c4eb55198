"""Document statistics, base rules, and robust multivariate outliers for each language and source."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import fresh, store, working_on

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct")
_SYMBOLS = b"#*$%&|<>"
_UPPER = string.ascii_uppercase.encode()
_MARKS = string.punctuation.encode()

# Transformed statistics: all vary in ordinary text, so that their covariance is regular without help.
FEATURES = (
    "ln(n_words + 1D)",
    "ln((word_chars + 1D) / (n_words + 1D))",
    "sqrt((n_marks + 0.375D) / (word_chars + 1D))",  # symbols are marks too
    "ln((n_distinct + 1D) / (n_words + 1D))",  # falls with every repeated word
    "sqrt((n_upper + 0.375D) / (word_chars + 1D))",
)
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SHARE = 0.75  # of a group's rows that the estimate is made from
STEPS = 6  # concentration steps of each start
RIDGE = 1e-3  # of the variance over all rows, added to each variance
SHRINK_MEAN, SHRINK_COV = 5, 20  # rows that the estimate of the next wider group counts for
SHELLS = 16  # shells of distance to an octave
CELLS = 512  # cells to one unit of a feature, for medians


def text_statistics(text: bytes | None) -> tuple[int, ...]:
    """``STATS`` of one text in UTF-8; zeros for null."""
    if not text:
        return (0,) * len(STATS)
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - (len(text) - sum(map(len, words)))
    symbols = sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        marked = bytearray(n)
        for i, window in enumerate(windows):
            if times[window] > 1:
                marked[i : i + 3] = b"\1\1\1"
        repeated = sum(marked)
    upper = len(text) - len(text.translate(None, _UPPER))
    marks = len(text) - len(text.translate(None, _MARKS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, upper, marks, len(set(words))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the statistics of each whole text."""
    names = [c for c in keep if c not in STATS]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("quality_rules")
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                rows = np.array([text_statistics(t) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *(pa.array(rows[:, j]) for j in range(len(STATS)))], [*names, *STATS])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"{c} bigint" for c in STATS)])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").cast("binary").alias("__text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2(x: float, dof: int) -> float:
    """Distribution function of chi-square."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    while term > 1e-17 * total:
        a += 1
        term *= x / a
        total += term
    return min(1.0, total)


def chi2_quantile(share: float, dof: int = P) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, dof) < share else (low, middle)
    return high


def _square(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for value, (i, j) in zip(flat, PAIRS):
        out[i, j] = out[j, i] = value
    return out


def _start(mean: np.ndarray, cov: np.ndarray, ridge: np.ndarray) -> dict:
    """Estimate with what turns a vector into one of uncorrelated parts: the inverse of the Cholesky factor."""
    full = cov + np.diag(ridge)
    whiten = np.linalg.inv(np.linalg.cholesky(full))
    return {"det": float(np.linalg.slogdet(full)[1]), "mean": mean.tolist(), "cov": [float(cov[i, j]) for i, j in PAIRS], "whiten": [float(whiten[i, j]) for i, j in PAIRS]}


def concentrate(shell: np.ndarray, count: np.ndarray, sums: np.ndarray, products: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest ``share`` of rows, from sums over shells of distance; the last shell counts in part."""
    order = np.argsort(shell, kind="stable")
    n, need = count[order].astype(float), math.ceil(share * count.sum())
    weight = np.clip((need - (np.cumsum(n) - n)) / n, 0, 1)
    mean = weight @ sums[order] / need
    return mean, _square(weight @ products[order] / need) - np.outer(mean, mean)


_START = "det double, mean array<double>, cov array<double>, whiten array<double>"
_FIT = f"at string, n bigint, starts array<struct<{_START}>>"


def _vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics ``x`` of the rows that pass the base rules, once for each group ``at`` they belong to.

    Groups are the (lang, source), the language and all rows, written as JSON, which tells null from any text.
    """
    at = [F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.to_json(F.struct(F.lit(2).alias("level")))]
    return stats.filter(~base_failed()).select(F.explode(F.array(*at)).alias("at"), *(F.expr(f).alias(f"x{j}") for j, f in enumerate(FEATURES)))


def _moments(weight: Column | None = None) -> list[Column]:
    x = [F.col(f"x{j}") for j in range(P)]
    products = [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in PAIRS]
    if weight is not None:
        return [F.sum((x[i] - F.element_at("centre", i + 1)) * (x[j] - F.element_at("centre", j + 1)) * weight).alias(f"w{i}_{j}") for i, j in PAIRS]
    return [F.count("*").alias("n"), *(F.sum(v).alias(f"s{j}") for j, v in enumerate(x)), *products]


def _distance(mean: str, whiten: str) -> Column:
    """Squared Mahalanobis distance."""
    y = [F.col(f"x{j}") - F.element_at(mean, j + 1) for j in range(P)]
    parts = [sum((F.element_at(whiten, at + 1) * y[j] for at, (k, j) in enumerate(PAIRS) if k == i), F.lit(0.0)) for i in range(P)]
    return sum((v * v for v in parts), F.lit(0.0))


def _middles(cells: pa.Table) -> pa.Table:
    """Medians and spreads (of the median deviation) of one group's features from its counts by cell."""

    def median(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    centre, spread, (feature, cell, count) = [], [], (cells.column(c).to_numpy() for c in ("j", "cell", "n"))
    for j in range(P):
        x, n = (cell[feature == j] + 0.5) / CELLS, count[feature == j]
        centre.append(median(x, n))
        spread.append(1.4826 * median(np.abs(x - centre[-1]), n) + 1 / CELLS)
    return pa.table({"at": pa.array([cells.column("at")[0].as_py()]), "centre": pa.array([centre]), "spread": pa.array([spread])})


def fit(stats: DataFrame) -> DataFrame:
    """``at``, ``n``, ``mean`` and ``cov`` (with the ridge) of each group by its minimum covariance determinant.

    Every group has three starts, all made without chance: mean and covariance; medians with median deviations; medians
    with the covariance of directions from them. A concentration step is one aggregation: rows are dealt to
    shells by their distance from the start's estimate, each shell's count, sums and products are added up before
    the shuffle, and the nearest shells that hold ``SHARE`` of the rows give the next estimate. So no group is gathered,
    however many rows it has; its shells and cells are some thousands at most. After ``STEPS`` steps the
    start with the least determinant counts. Estimates are as narrow as three quarters of the rows, which a factor makes good.
    """
    rows = store(_vectors(stats))
    cells = rows.select("at", F.posexplode(F.array(*(F.floor(F.col(f"x{j}") * CELLS).cast("int") for j in range(P)))).alias("j", "cell"))
    middles = store(cells.groupBy("at", "j", "cell").agg(F.count("*").alias("n")).groupBy("at").applyInArrow(_middles, "at string, centre array<double>, spread array<double>"))
    away = sum((((F.col(f"x{j}") - F.element_at("centre", j + 1)) / F.element_at("spread", j + 1)) ** 2 for j in range(P)), F.lit(1e-9))
    first = rows.join(middles, "at").groupBy("at").agg(F.first("centre").alias("centre"), F.first("spread").alias("spread"), *_moments(), *_moments(1 / away))
    first = store(first)
    names = [f"q{j}_{j}" for j in range(P)] + [f"s{j}" for j in range(P)]
    whole = first.filter(F.col("at") == '{"level":2}').select("n", *names).first()
    ridge = np.array([max(1e-12, RIDGE * (whole[f"q{j}_{j}"] / whole.n - (whole[f"s{j}"] / whole.n) ** 2)) for j in range(P)]) if whole else np.ones(P)
    factor = SHARE / chi2(chi2_quantile(SHARE), P + 2)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = []
            for r in batch.to_dict("records"):
                mean = np.array([r[f"s{j}"] for j in range(P)]) / r["n"]
                classical = _square([r[f"q{i}_{j}"] / r["n"] for i, j in PAIRS]) - np.outer(mean, mean)
                centre, spread = np.array(r["centre"]), np.array(r["spread"])
                directions = _square([r[f"w{i}_{j}"] / r["n"] for i, j in PAIRS])
                starts.append([_start(mean, classical, ridge), _start(centre, np.diag(spread**2), ridge), _start(centre, directions, ridge)])
            yield pd.DataFrame({"at": batch["at"], "n": batch["n"], "starts": starts})

    def step(shells: pa.Table) -> pa.Table:
        start, shell, n, *moments = (shells.column(c).to_numpy() for c in ("start", "shell", "n", *(f"s{j}" for j in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)))
        sums, products = np.column_stack(moments[:P]), np.column_stack(moments[P:])
        own = [np.flatnonzero(start == k) for k in range(start.max() + 1)]
        starts = [_start(*concentrate(shell[k], n[k], sums[k], products[k]), ridge) for k in own]
        return pa.Table.from_pylist([{"at": shells.column("at")[0].as_py(), "n": int(n[own[0]].sum()), "starts": starts}], schema)

    one = pa.struct([("det", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("mean", "cov", "whiten"))])
    schema = pa.schema([("at", pa.string()), ("n", pa.int64()), ("starts", pa.list_(one))])
    known = store(first.mapInPandas(begin, _FIT))
    for _ in range(STEPS):
        near = rows.join(known.select("at", F.posexplode("starts").alias("start", "e")).select("at", "start", "e.mean", "e.whiten"), "at")
        near = near.withColumn("shell", F.floor(SHELLS * F.log2(_distance("mean", "whiten") + 1e-9)).cast("int"))
        shells = near.groupBy("at", "start", "shell").agg(*_moments())
        known = store(shells.groupBy("at").applyInArrow(step, _FIT))
    best = F.array_min("starts")  # by determinant, then mean
    cov = [F.element_at("e.cov", k + 1) * factor + F.lit(float(ridge[i]) if i == j else 0.0) for k, (i, j) in enumerate(PAIRS)]
    return known.select("at", "n", best.alias("e")).select("at", "n", F.col("e.mean").alias("mean"), F.array(*cov).alias("cov"))


def estimates(stats: DataFrame) -> DataFrame:
    """One row for each (lang, source): ``fit_rows`` (rows it was fitted on) and its estimate.

    Every (lang, source) with rows to fit is fitted on them. Few rows give a poor covariance, so the estimate of its
    language counts as ``SHRINK_COV`` rows more (``SHRINK_MEAN`` for the mean), as that of all rows does for a language.
    """
    fitted = store(fit(stats), 1)
    groups = stats.select("lang", "source").distinct()
    keys = [F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.lit('{"level":2}')]
    g = groups.select("lang", "source", *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    for i in range(3):
        g = g.join(fitted.select(*(F.col(c).alias(f"{c}{i}") for c in ("at", "n", "mean", "cov"))), F.col(f"k{i}") == F.col(f"at{i}"), "left")

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means, whitens = [], []
            for r in batch.to_dict("records"):
                mean, cov = None, None
                for i in (2, 1, 0):
                    if r[f"mean{i}"] is None:
                        continue
                    n, own_mean, own_cov = r[f"n{i}"], np.array(r[f"mean{i}"]), _square(r[f"cov{i}"])
                    mean = own_mean if mean is None else (n * own_mean + SHRINK_MEAN * mean) / (n + SHRINK_MEAN)
                    cov = own_cov if cov is None else (n * own_cov + SHRINK_COV * cov) / (n + SHRINK_COV)
                means.append(None if mean is None else mean.tolist())
                whitens.append(None if cov is None else _start(mean, cov, np.zeros(P))["whiten"])
            rows = batch["n0"].fillna(0).astype("int64")
            yield pd.DataFrame({"__lang": batch["lang"], "__source": batch["source"], "fit_rows": rows, "__mean": means, "__whiten": whitens})

    return store(g.mapInPandas(shrink, "__lang string, __source string, fit_rows bigint, __mean array<double>, __whiten array<double>"), 1)


def quality_rules(docs: DataFrame, *, keep: list[str] | None = None, text: str = "text", cutoff: float = 1 - 1e-12) -> DataFrame:
    """``keep`` (default: all columns), the statistics, ``base_failed``, ``distance``, ``fit_rows`` and ``kept``.

    The base rules reject texts of under 50 words and those with over half of their words in repeated
    3-word windows. Of the rest, the squared Mahalanobis distance of the transformed statistics from the
    robust estimate of the document's language and source must not exceed the ``cutoff`` quantile of
    chi-square; that is set far out, since the tails of real text are longer than normal ones.

    Null and empty texts have zero statistics and fail the base rules; texts are read whole, however long. Null languages
    and sources form groups of their own. With no rows to fit at all, the base rules alone decide. Repeated rows count each
    time and get equal results; an empty table gives no rows. Columns of the names made here are replaced.
    """
    made = (*STATS, "base_failed", "distance", "fit_rows", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    group = [c for c in ("lang", "source") if c in docs.columns]
    if len(group) < 2:
        raise ValueError("quality_rules needs the columns lang and source")
    wanted = list(dict.fromkeys([*names, *group]))
    if text in names:
        stats = statistics(docs, wanted, text)  # a second pass over the texts costs less than shuffling them
        params = estimates(store(statistics(docs, group, text)))
    else:
        stats = store(statistics(docs, wanted, text))
        params = estimates(stats)
    own = fresh(stats.columns, "lang", "source", "mean", "whiten")
    params = params.toDF(*own[:2], "fit_rows", *own[2:])
    out = stats.join(params, F.col("lang").eqNullSafe(F.col(own[0])) & F.col("source").eqNullSafe(F.col(own[1])), "left")
    y = [F.expr(f) - F.element_at(own[2], j + 1) for j, f in enumerate(FEATURES)]
    parts = [sum((F.element_at(own[3], at + 1) * y[j] for at, (k, j) in enumerate(PAIRS) if k == i), F.lit(0.0)) for i in range(P)]
    out = out.withColumn("base_failed", base_failed()).withColumn("distance", sum((v * v for v in parts), F.lit(0.0)))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(cutoff), F.lit(True)))
    return out.select(*(F.col(f"`{c}`") for c in names), *made)


#: DuckDB: the statistics and verdict of the base rules.
BASE = r"""
WITH words AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 2] AS x FROM words, LATERAL unnest(range(1, len(w) - 1)) t(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
  coalesce(m.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(w) AS base_failed
FROM words w LEFT JOIN marked m USING (doc_id) LEFT JOIN lines l USING (doc_id)
"""
