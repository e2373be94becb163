"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure exceeds a cutoff. Labelled documents are the holdout, halved by a hash
of their key. One half of a stratum proposes a path of ever stricter sets of cutoffs: from none at all, each step tightens
the rule that rejects most bad documents for its cost in good ones. The other half certifies: along the path the
hypothesis "more than `risk` of the good documents are rejected by any of the rules" is tested with the exact binomial
tail, and the first one that isn't refuted ends the walk. Tests in a fixed order need no correction among
themselves; over strata delta is divided (Bonferroni). So with probability 1 - delta no stratum loses more than
`risk` of its good documents, whichever certified set is picked. Of those, the one that rejects most bad documents at
the least cost in good ones is taken, the most lenient on ties; a stratum in which none is certified, or none helps,
has only the base rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.llm.common import ROW_ID, SPACES, by_row, in_arrow, materialize, picked, position, slices, with_row_id

BROADCAST_STRATA = 50_000
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: rule: (measure as SQL over the columns of measure(), cutoffs from strict to lenient); above the cutoff rejects.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)),
    "duplicate_line_share": ("n_dup_lines / greatest(n_lines, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    "mean_word_chars": ("word_chars / greatest(n_words, 1)", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "inverse_word_chars": ("n_words / greatest(word_chars, 1)", (0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.33, 0.4, 0.5, 0.7)),
}


@dataclass(frozen=True)
class Risk:
    """risk: share of good documents of a stratum that all rules together may reject; delta: chance that this fails
    anywhere; price: bad documents that one good document is worth; min_words, max_repeat_percent: the base rule."""

    risk: float = 0.05
    delta: float = 0.05
    price: float = 20.0
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, many = set(), set()
    for w in windows:
        (many if w in seen else seen).add(w)
    total, end = 0, 0  # words before `end` are counted already
    for i, w in enumerate(windows):
        if w in many:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; all 0 for null."""
    text = text or ""
    words = text.encode().split()
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with MEASURES (long) of every whole text, in place of columns of those names."""
    keep = [c for c in docs.columns if c not in MEASURES]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType(), False) for c in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keep.index(text)):
            found = [measures(x.as_py()) for x in batch.column(keep.index(text))]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return in_arrow(docs.select(*keep), run, schema)


def base_failed(p: Risk) -> F.Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly but for rounding; terms are summed from the largest down."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return float(k >= n)
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if k > n * p:  # sum the upper side, which falls from k + 1 on
        term = math.exp(log) * (n - k) / (k + 1) * p / (1 - p)
        total, i = 0.0, k + 1
        while term > 1e-18 * (total or 1) and i <= n:
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        return max(0.0, 1 - total)
    term, total, i = 1.0, 0.0, k
    while i >= 0 and term > 1e-18:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, math.exp(log) * total)


LEVELS = tuple(f"passed_{rule}" for rule in RULES)


def holdout_counts(measured: DataFrame, labels: DataFrame, p: Risk) -> DataFrame:
    """(stratum, proposes, good, a level for each rule, n): labelled documents that the base keeps, by how many cutoffs
    of each rule they exceed. Rows are bounded by the grid of cutoffs, not by the labels.

    measured has doc_key and stratum; labels has doc_key and quality. A document with several labels is bad if one says
    so; labels without key or verdict are ignored.
    """
    truth = labels.filter("doc_key is not null and quality is not null").groupBy("doc_key").agg(F.min("quality").alias("good"))
    held = measured.filter(~base_failed(p)).join(truth, "doc_key")
    levels = [sum(F.when(F.expr(sql) > c, 1).otherwise(0) for c in cuts).alias(name) for (sql, cuts), name in zip(RULES.values(), LEVELS, strict=True)]
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_key").cast("string")), F.lit(2)) == 0
    return held.select("stratum", half.alias("proposes"), (F.col("good") == 1).alias("good"), *levels).groupBy("stratum", "proposes", "good", *LEVELS).agg(F.count("*").alias("n"))


def propose(levels: np.ndarray, good: np.ndarray, n: np.ndarray, price: float) -> list[tuple[int, ...]]:
    """Path of sets of cutoffs, one number for each rule: documents that exceed at least so many cutoffs are rejected.
    Every step tightens one rule by as many cutoffs as pays best; it ends where no tightening rejects anything more."""
    sizes = [len(cuts) for _, cuts in RULES.values()]
    state, path, left = [size + 1 for size in sizes], [], np.ones(len(n), bool)
    while True:
        best = None
        for r in range(len(sizes)):
            for to in range(state[r] - 1, 0, -1):
                hit = left & (levels[:, r] >= to)
                bad, cost = int(n[hit & ~good].sum()), int(n[hit & good].sum())
                if bad + cost and (best is None or (bad + 1) / (price * cost + 1) > best[0]):
                    best = ((bad + 1) / (price * cost + 1), r, to)
        if best is None:
            return path
        _, r, to = best
        state[r] = to
        left &= levels[:, r] < to
        path.append(tuple(state))


def choose(cells: pd.DataFrame, strata: int, p: Risk) -> tuple[int, ...] | None:
    """The certified set of cutoffs of one stratum, from its rows of holdout_counts(); None if there is none."""
    levels, good, n, first = cells[list(LEVELS)].to_numpy(), cells["good"].to_numpy(bool), cells["n"].to_numpy(), cells["proposes"].to_numpy(bool)
    total, best, chosen = int(n[~first & good].sum()), 0.0, None
    for state in propose(levels[first], good[first], n[first], p.price):
        hit = (levels >= np.array(state)).any(axis=1)
        if binomial_tail(int(n[hit & ~first & good].sum()), total, p.risk) > p.delta / max(1, strata):
            break
        worth = int(n[hit & ~good].sum()) - p.price * int(n[hit & good].sum())
        if worth > best:
            best, chosen = worth, state
    return chosen


def cutoffs(measured: DataFrame, labels: DataFrame, p: Risk) -> DataFrame:
    """(stratum, known, a cutoff for each rule): a row for each stratum with a certified set; a rule that stays silent has
    null. Strata are chosen for one by one in tasks, and come back as a written table."""
    counts = materialize(holdout_counts(measured, labels, p), "holdout")
    strata = counts.select("stratum").distinct().count()
    kind = counts.schema["stratum"].dataType.simpleString()

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        state = choose(cells, strata, p)
        cuts = {rule: [values[at - 1] if at <= len(values) else None] for (rule, (_, values)), at in zip(RULES.items(), state or (), strict=False)}
        made = pd.DataFrame({"stratum": [cells["stratum"].iloc[0]], "known": [True], **{r: pd.Series(v, dtype="float64") for r, v in cuts.items()}})
        return made if state else made.iloc[:0].reindex(columns=["stratum", "known", *RULES])

    return materialize(counts.groupBy("stratum").applyInPandas(run, f"stratum {kind}, known boolean, {', '.join(f'{r} double' for r in RULES)}"), "cutoffs")


def judged(measured: DataFrame, labels: DataFrame, p: Risk) -> DataFrame:
    """measured (with doc_key and stratum) with base_failed and kept. Cutoffs meet their rows by a join on stratum,
    broadcast if there are at most BROADCAST_STRATA of them."""
    table = cutoffs(measured, labels, p).withColumnsRenamed({"stratum": "_stratum", **{r: f"_{r}" for r in RULES}}).drop("known")
    small = table.count() <= BROADCAST_STRATA
    rows = measured.join(F.broadcast(table) if small else table, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    over = [F.coalesce(F.expr(sql) > F.col(f"_{rule}"), F.lit(False)) for rule, (sql, _) in RULES.items()]
    failed = base_failed(p)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~reduce(lambda a, b: a | b, over)}).drop("_stratum", *[f"_{r}" for r in RULES])


def _label_rows(labels: DataFrame, key: str) -> DataFrame:
    return picked(labels, doc_key=key, quality="quality")


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text", p: Risk = Risk()) -> DataFrame:
    """key, stratum, MEASURES, base_failed, kept for every row of docs; texts are read once.

    Strata are values of `stratum` (null is one); a stratum without labels has no certified cutoff, so only the base
    rule holds there. Null and empty texts have no word and fail the base. Repeated rows each get their verdict. Empty
    tables: empty result. Columns other than key, stratum and text are ignored, whatever they are called.
    """
    measured = materialize(measure(picked(docs, doc_key=key, stratum=stratum, body=text), "body").drop("body"), "quality")
    found = judged(measured, _label_rows(labels, key), p)
    return found.select("doc_key", "stratum", *MEASURES, "base_failed", "kept").toDF(key, stratum, *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text", p: Risk = Risk()) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged; no join by key, so repeated keys do no harm.

    Texts are measured once; rows that go meet theirs by row identity. The other cases as for assess().
    """
    rows = with_row_id(docs, "quality")
    c = lambda name: F.col(f"c{position(docs, name)}")
    named = rows.select(*ROW_ID, c(key).alias("doc_key"), c(stratum).alias("stratum"), c(text).alias("body"))
    measured = materialize(measure(named, "body").drop("body"), "quality")
    goes = materialize(judged(measured, _label_rows(labels, key), p).filter("not kept").select(*ROW_ID), "goes", measured)
    return by_row(rows, goes, "left_anti").drop(*ROW_ID).toDF(*docs.columns)
