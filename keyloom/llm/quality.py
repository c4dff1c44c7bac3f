"""Quality rules: text statistics as expressions, and a decision list learned from labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

WINDOW = 5
#: Most labelled documents that rules are learned from, the first by a hash of doc_id. Rules have a handful of
#: thresholds, so more labels would not move them; it also bounds what the driver holds (about 100 bytes a row).
MAX_LABELLED = 20_000
CUTS = 48
FEATURES = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_word": lambda c: F.try_divide(c("word_chars"), c("n_words")),
    "symbols_per_word": lambda c: F.try_divide(c("n_symbols"), c("n_words")),
    "dup_line_share": lambda c: F.try_divide(c("n_dup_lines"), c("n_lines")),
    "repeat_share": lambda c: F.try_divide(c("n_repeat_words"), c("n_words")),
    "capitals_per_word": lambda c: F.try_divide(c("n_capitals"), c("n_words")),
    "exclaims_per_word": lambda c: F.try_divide(c("n_exclaims"), c("n_words")),
    "digits_per_word": lambda c: F.try_divide(c("n_digits"), c("n_words")),
}


def _repeated(hashes: Column) -> Column:
    """Number of positions covered by windows of 5 that occur twice or more, from the array of word hashes.

    Most texts have no such window, which a set decides; the others sort (window, position) pairs, keep those beside an
    equal one, and add up what each further window covers, so the work is n log n in the length of the text.
    """

    def covered(windows: Column) -> Column:
        beside = lambda s: lambda e, k: e["h"].eqNullSafe(F.get(s, k - 1)["h"]) | e["h"].eqNullSafe(F.get(s, k + 1)["h"])
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, beside(s)), lambda e: e["i"])))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.aggregate(places, start, add)["n"])

    def of_words(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, covered))

    return let(hashes, of_words)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds to a table (row, text) the columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_capitals, n_exclaims, n_digits (long) and base_failed. A null text counts as empty, whose statistics are 0.

    One pass without a shuffle. Repeated windows are compared by 64-bit hashes of their words.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    with_word = lambda x: x.rlike(WORD)
    lines = F.filter(F.split(text, "\n", -1), with_word)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return (
        docs.withColumn("words", words)
        .withColumn("lines", lines)
        .select(
            *docs.columns,
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated(F.transform("words", lambda w: F.xxhash64(w))).cast("long").alias("n_repeat_words"),
            count(r"\p{Lu}").alias("n_capitals"),
            count("!").alias("n_exclaims"),
            count("[0-9]").alias("n_digits"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """A conjunction of (feature, sign, threshold), each chosen by information gain, until it covers no negative."""
    inside, rule = np.ones(len(y), bool), []
    while (~y & inside).any() and len(rule) < 6:
        p, n = (y & inside).sum(), (~y & inside).sum()
        best = (1e-9, None)
        for f, values in enumerate(cuts):
            for cut in values:
                above = inside & (x[:, f] > cut)
                for sign, took in ((">", above), ("<=", inside & ~above)):
                    p1, n1 = (y & took).sum(), (~y & took).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, sign, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, [best[1]])
    return rule


def _holds(x: np.ndarray, rule: list[tuple]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, cut in rule:
        out &= (x[:, f] > cut) if sign == ">" else (x[:, f] <= cut)
    return out


def learn_rules(x: np.ndarray, junk: np.ndarray, min_precision: float = 0.95, min_cover: int = 2, max_rules: int = 12) -> list[list[tuple]]:
    """Sequential covering: ordered conjunctions that reject, each grown on two thirds of what is left and pruned on
    the rest. A rule must reach min_precision on both parts together; the first that doesn't ends the list."""
    rules, left = [], np.ones(len(junk), bool)
    part = np.arange(len(junk)) % 3 < 2
    cuts = [np.unique(np.quantile(np.concatenate([x[:, f], x[junk, f]]), np.linspace(0, 1, CUTS))) for f in range(x.shape[1])] if len(x) and junk.any() else []
    while len(rules) < max_rules and (junk & left).sum() >= min_cover:
        grow, prune = left & part, left & ~part
        if not (junk & grow).any():
            break
        rule = _grow(x[grow], junk[grow], cuts)
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            took = _holds(x[prune], rule[:k])
            p, n = (junk[prune] & took).sum(), (~junk[prune] & took).sum()
            worth.append(((p - n) / max(1, p + n), k))
        rule = rule[: max(worth, key=lambda w: w[0])[1]]
        took = left & _holds(x, rule)
        if (junk & took).sum() < min_cover or (junk & took).sum() < min_precision * took.sum():
            break
        rules.append(rule)
        left &= ~took
    return rules


def _features() -> dict[str, Column]:
    return {k: F.coalesce(f(F.col), F.lit(0.0)).cast("double") for k, f in FEATURES.items()}


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[list[tuple]]:
    """Rules learned from labels (doc_id, quality: 0 is junk; nulls are ignored; the lowest of several counts).

    A bounded sample: the first max_labelled labels by a hash of doc_id. Only their texts are measured. Documents that
    fail the base rules are left out, as those rules decide them. Without labels of both kinds there are no rules.
    """
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most 16 bytes x max_labelled to broadcast
    measured = text_statistics(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "quality", "text"))
    # Filtered here, as a condition on the texts alone would be evaluated before the join, for all of them.
    got = [r for r in measured.select("quality", F.xxhash64("doc_id").alias("h"), F.array(*_features().values()).alias("x"), "base_failed").collect() if not r.base_failed]
    got.sort(key=lambda r: (r.h, r.x))
    x = np.array([r.x for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return learn_rules(x, np.array([r.quality == 0 for r in got], dtype=bool), **options)


def verdict(rules: list[list[tuple]]) -> Column:
    """The decision list as one ordered conditional over the statistics: true to keep. A share of nothing is 0."""
    features, names = _features(), list(FEATURES)
    out = None
    for rule in rules:
        holds = F.lit(True)
        for f, sign, cut in rule:
            holds = holds & (features[names[f]] > cut if sign == ">" else features[names[f]] <= cut)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """text_statistics() of every whole text, and kept: false if the base rules fail, else the learned list's verdict.

    docs has doc_id, text and whatever else; its rows come back in the struct column row, so no name can clash.
    """
    rules = fit(docs, labels, **options)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return text_statistics(rows).drop("text").withColumn("kept", ~F.col("base_failed") & verdict(rules))
