"""Quality rules by weak supervision (DataFrame operations only).

Every rule votes good, bad or abstains. Accuracies of the rules are not given:
expectation-maximisation over the counts of vote patterns estimates them
together with the share of good documents, and the posterior probability that
a document is good replaces passing all rules.

The number of patterns is at most 3 ** len(RULES) whatever the input size, so
the pattern counts, and only they, go to the driver.

Cases: null, empty and blank texts have no words and fail the base rules;
repeated rows get equal rows; an empty table gives an empty result; other
columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ASCII_SPACE, WORD, cut, fresh

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are conditions over the features; neither: abstain."""

    name: str
    good: str
    bad: str


#: Conditions over n_words, word_chars, n_symbols, n_lines, n_dup_lines,
#: n_repeat_words, n_upper (letters A-Z), n_exclaims, n_symbol_runs (two symbols in
#: a row, or one alone between spaces) and n_distinct (distinct words).
RULES = (
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule("symbols", "100 * n_symbols <= word_chars", "100 * n_symbols > 4 * word_chars"),
    Rule("symbol_words", "50 * n_symbols <= n_words", "8 * n_symbols > n_words"),
    Rule("symbol_runs", "50 * n_symbol_runs <= n_words", "8 * n_symbol_runs > n_words"),
    Rule("repeats", "100 * n_repeat_words <= 25 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("line_repeats", "n_dup_lines = 0", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines"),
    Rule("capitals", "100 * n_upper <= 8 * word_chars", "100 * n_upper > 30 * word_chars"),
    # distinct words grow with the square root of the length, so the same bound holds for texts of all lengths
    Rule("variety", "n_distinct * n_distinct > 9 * n_words", "n_distinct * n_distinct < 4 * n_words"),
    Rule("exclaims", "10 * n_exclaims <= n_words", "3 * n_exclaims > n_words"),
)


def _dropped(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """The columns ``keep`` and the features that the rules read, all bigint."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, t.alias("__t"))
    base = base.select(*keep, "__t", F.filter(F.split("__t", f"[{ASCII_SPACE}]+"), lambda w: w != "").alias("__w"), F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]")).alias("__l"))
    # a window of eight words from two of four, those from two of two: three passes over hashes
    pairs = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.size(c)), lambda x, y: F.xxhash64(x, y))
    base = base.withColumn("__1", F.when(F.size("__w") > WINDOW, F.transform("__w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    for k in (1, 2, 4):
        base = base.withColumn(f"__{2 * k}", pairs(F.col(f"__{k}"), k))
    base = base.withColumn("__h", F.slice("__8", 1, F.greatest(F.lit(0), F.size("__8") - (WINDOW - 1))))
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    marked = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("__m", F.when(repeated, marked))
    twice = lambda x, i: ((i > 0) & (F.element_at("__m", F.greatest(i, F.lit(1)))["h"] == x["h"])) | (
        (i < F.size("__m") - 1) & (F.element_at("__m", F.least(i + 2, F.size("__m")))["h"] == x["h"])
    )
    at = F.array_sort(F.transform(F.filter("__m", twice), lambda x: x["i"]))
    base = base.withColumn("__a", F.when(F.col("__m").isNotNull(), at))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p"))
    covered = F.aggregate("__a", start, lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["p"])).alias("n"), x.alias("p")), lambda s: s["n"])
    n = F.size("__w").cast("long")
    chars = F.length(F.array_join("__w", "")).cast("long")
    return base.select(
        *keep,
        n.alias("n_words"),
        chars.alias("word_chars"),
        (F.length("__t") - F.length(_dropped(F.col("__t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("__t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]{2,}|\s[#*$%&|<>]\s")).cast("long").alias("n_symbol_runs"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
    )


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def votes(rules: Iterable[Rule] = RULES) -> Column:
    """One number a document: base 3, a digit a rule (0 abstain, 1 good, 2 bad)."""
    out = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        out = out + F.when(F.expr(r.bad), 2).when(F.expr(r.good), 1).otherwise(0) * (3**k)
    return out


def digits(pattern: int, n: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(n)]


@dataclass(frozen=True)
class Model:
    """P(good) and, for each rule, P(vote | class) for votes 0, 1, 2."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def log_odds(self, rule: int, vote: int) -> float:
        return math.log(self.good[rule][vote] / self.bad[rule][vote])

    def posterior(self, pattern: int) -> float:
        s = math.log(self.prior / (1 - self.prior)) + sum(self.log_odds(k, v) for k, v in enumerate(digits(pattern, len(self.good))))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, s))))


def fit(counts: dict[int, int], n_rules: int, rounds: int = 200, prior: float = 0.85, accuracy: float = 0.9, strength: float = 0.05) -> Model:
    """Expectation-maximisation over pattern counts.

    Starts from rules right with ``accuracy`` when they vote; a bad document
    breaks one rule in ``n_rules`` and passes the others as a good one does. The
    start counts as a share ``strength`` of the documents in every estimate, and a
    vote never counts against its own meaning: its log odds keep their sign, so
    that the classes cannot swap.
    """
    known = sorted(counts.items())
    total = sum(counts.values())
    wrong = (1 - accuracy) / n_rules
    breaks = 1 / n_rules
    good = (0.1, 0.9 - wrong, wrong)
    bad = (0.1, 0.9 - breaks, breaks)
    m = Model(prior, (good,) * n_rules, (bad,) * n_rules)
    weight = (prior * strength * total + 1, (1 - prior) * strength * total + 1)
    for _ in range(rounds if known else 0):
        mass = [0.0, 0.0]
        seen = [[[weight[y] * x for x in (good, bad)[y]] for _ in range(n_rules)] for y in (0, 1)]
        for pattern, c in known:
            p = m.posterior(pattern)
            for y, share in ((0, p * c), (1, (1 - p) * c)):
                mass[y] += share
                for k, v in enumerate(digits(pattern, n_rules)):
                    seen[y][k][v] += share
        rate = [[[x / sum(row) for x in row] for row in seen[y]] for y in (0, 1)]
        for k in range(n_rules):
            for v, better in ((1, 0), (2, 1)):
                if rate[better][k][v] < rate[1 - better][k][v]:
                    rate[0][k][v] = rate[1][k][v] = (rate[0][k][v] + rate[1][k][v]) / 2
        new = Model((mass[0] + weight[0]) / (sum(mass) + sum(weight)), tuple(map(tuple, rate[0])), tuple(map(tuple, rate[1])))
        moved, m = abs(new.prior - m.prior), new
        if moved < 1e-9:
            break
    return m


def posterior(model: Model, rules: Iterable[Rule] = RULES) -> Column:
    """The same posterior as a column expression over the features."""
    s = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, r in enumerate(rules):
        lo = [model.log_odds(k, v) for v in (0, 1, 2)]
        s = s + F.when(F.expr(r.bad), lo[2]).when(F.expr(r.good), lo[1]).otherwise(lo[0])
    return 1 / (1 + F.exp(-s))


def fit_on(feats: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Fit on all rows of a feature table; the driver gets pattern counts only."""
    seen = feats.groupBy(votes(rules).alias("pattern")).count().collect()
    return fit({r["pattern"]: r["count"] for r in seen}, len(rules))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good."""
    feats = cut(features(docs, text, keep=(id_col,)))
    p = posterior(fit_on(feats))
    failed = F.expr(BASE_FAILED)
    return feats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p >= threshold)).alias("kept"), p.alias("p_good"),
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they came.

    Rows are written once with their features, so that the model is fitted and the
    rows are judged without computing a feature twice; texts are never shuffled.
    """
    own = fresh(docs, "row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(own), F.col(f"`{text}`").alias("__text"))
    feats = cut(features(whole, "__text", keep=(own,)))
    kept = ~F.expr(BASE_FAILED) & (posterior(fit_on(feats)) >= threshold)
    return feats.filter(kept).select(*(F.col(f"{own}.`{c}`").alias(c) for c in docs.columns))


__all__ = ["RULES", "WORD", "Model", "Rule", "features", "fit", "fit_on", "judge", "keep_good", "posterior", "votes"]
