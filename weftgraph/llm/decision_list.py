"""Quality rules: a learned decision list over counted text statistics.

Statistics are counted over every whole text. A bounded sample of the labelled
documents (the ``MAX_LABELS`` smallest hashes of their ids) trains the list by
sequential covering: a rule is a conjunction of thresholds, grown by
information gain on two thirds of the sample, pruned on the rest, kept while it
is right often enough, and the documents it covers leave the sample. The list
becomes one ordered Spark conditional expression that rejects what a rule covers.

Null or empty text has no words; documents under ten words or with too many
repeated words fail the base rule; a very long text is counted in stretches of
bounded size; repeated rows get the same verdict each; of rows that share a
labelled id the least in their statistics is learned from; of rules, tests and
thresholds of equal worth the first in order of name, direction and value wins;
without labels of both kinds the list is empty and only the base rule rejects;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .texthash import STRETCH, windows, word_hashes

# Characters counted as symbols, window length, base limits.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

MAX_LABELS = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """Words in an ``n``-word window that occurs at least twice, the first included."""
    h = windows(words, n)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The values of ``STATS`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = word_hashes(raw)
    b = np.frombuffer(raw, dtype=np.uint8)
    counts = sum(np.bincount(b[i : i + STRETCH], minlength=256) for i in range(0, max(1, len(b)), STRETCH))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    spaces = int(counts[32] + counts[9:14].sum())
    return (
        len(words), len(text) - spaces, int(sum(counts[ord(c)] for c in SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), int(counts[65:91].sum()), int(counts[33] + counts[63]), int(counts[48:58].sum()), len(lines),
    )


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(1).to_pylist()]
            cols = np.array(rows, dtype=np.int64).reshape(len(rows), len(STATS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names=[id_col, *STATS])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS)
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def features(prefix: str = "") -> dict[str, Column]:
    """Ratios that rules test, from the counts (all 0 without words)."""
    c = {s: F.col(f"{prefix}{s}").cast("double") for s in STATS}
    words, chars, lines = (F.greatest(c[s], F.lit(1.0)) for s in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_per_word": c["n_symbols"] / words,
        "marks_per_word": c["n_marks"] / words,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "repeat_share": c["n_repeat_words"] / words,
        "dup_line_share": c["n_dup_lines"] / lines,
        "word_length": c["word_chars"] / words,
    }


FEATURES = ("symbols_per_word", "marks_per_word", "upper_share", "digit_share", "repeat_share", "dup_line_share", "word_length")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for t in rule:
        out &= (x[t.feature] >= t.limit) if t.above else (x[t.feature] <= t.limit)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int, thresholds: int) -> Rule:
    """Add the test of the highest information gain until no good row is covered."""
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < max_tests:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not n0 or not p0:
            break
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for name in sorted(x):
            v = x[name]
            cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, thresholds), method="lower"))
            for above in (True, False):
                for limit in cuts:
                    m = inside & ((v >= limit) if above else (v <= limit))
                    p = int((bad & m).sum())
                    n = int(m.sum()) - p
                    if p:
                        gain = p * (np.log2(p / (p + n)) - base)
                        if gain > best[0]:
                            best = (gain, Test(name, above, float(limit)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers((best[1],), x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    m = covers(rule, x)
    p, n = int((bad & m).sum()), int((~bad & m).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune_set: np.ndarray, min_precision: float = 0.97, min_cover: int = 3,
          max_rules: int = 12, max_tests: int = 4, thresholds: int = 24) -> list[Rule]:
    """Ordered rules that cover bad rows; every array has a value per sampled row."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and (bad & left).any():
        grow, prune = left & ~prune_set, left & prune_set
        if not (bad & grow).any():
            break
        gx, px = ({k: v[m] for k, v in x.items()} for m in (grow, prune))
        rule = _grow(gx, bad[grow], max_tests, thresholds)
        if not rule:
            break
        best = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: (_worth(r, px, bad[prune])[0], len(r)))
        lx = {k: v[left] for k, v in x.items()}
        _, p, n = _worth(best, lx, bad[left])
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(best)
        left &= ~covers(best, x)
    return rules


def to_column(rules: list[Rule], feats: dict[str, Column], rejected, passed) -> Column:
    """The rules as one ordered conditional expression."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            f = feats[t.feature]
            test = test & ((f >= F.lit(t.limit)) if t.above else (f <= F.lit(t.limit)))
        out = F.when(test, F.lit(rejected)) if out is None else out.when(test, F.lit(rejected))
    return F.lit(passed) if out is None else out.otherwise(F.lit(passed))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def sample_ids(labels: DataFrame, id_col: str, label_col: str, max_labels: int) -> DataFrame:
    """At most ``max_labels`` labelled ids, those of the smallest hash."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = known.groupBy(id_col).agg(F.min(label_col).alias("__wg_label"))
    return one.withColumn("__wg_h", F.xxhash64(id_col)).orderBy("__wg_h", id_col).limit(max_labels)


def train(counted: DataFrame, sample: DataFrame, id_col: str = "doc_id") -> list[Rule]:
    """Learn from counted rows joined with a bounded sample of labels."""
    rows = (
        counted.join(F.broadcast(sample), id_col)
        .select("__wg_h", (F.col("__wg_label") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()])
        # Of rows that share a labelled id the least counts, whatever their order.
        .groupBy("__wg_h").agg(F.min(F.struct("bad", *FEATURES)).alias("m")).select("__wg_h", "m.*").orderBy("__wg_h").toPandas()
    )
    bad = rows["bad"].to_numpy(dtype=bool)
    if not bad.any() or bad.all():
        return []
    x = {f: rows[f].to_numpy(dtype=float) for f in FEATURES}
    prune = (rows["__wg_h"].to_numpy(dtype=np.int64) % 3) == 0
    return learn(x, bad, prune)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: counts, base verdict and the list's verdict."""
    counted = materialize(stats(docs, id_col, text_col), "text-stats")
    rules = train(counted, sample_ids(labels, id_col, label_col, max_labels), id_col)
    verdict = F.when(base_failed(), F.lit(False)).otherwise(to_column(rules, features(), False, True))
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps. The sample is
    counted first; then one pass counts and filters, with no join."""
    sample = sample_ids(labels, id_col, label_col, max_labels)
    counted = stats(docs.join(F.broadcast(sample.select(id_col)), id_col, "left_semi"), id_col, text_col)
    rules = train(counted, sample, id_col)

    @F.pandas_udf(", ".join(f"{s} long" for s in STATS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS))

    inner = "__wg_stats"
    failed = F.expr(
        f"{inner}.n_words < {MIN_WORDS} or {inner}.n_repeat_words * 100 > {inner}.n_words * {MAX_REPEAT_PERCENT}"
    )
    verdict = F.when(failed, F.lit(False)).otherwise(to_column(rules, features(f"{inner}."), False, True))
    return docs.withColumn(inner, count(text_or_empty(text_col))).filter(verdict).select(*[F.col(f"`{c}`") for c in docs.columns])
